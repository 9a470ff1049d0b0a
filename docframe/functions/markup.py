"""Column functions on WordprocessingML kept as text, so that bytes outside an edit survive.

A block runs from an opening tag to the first closing tag of that name: nested blocks end early and a
self-closing element is swallowed together with the next one. Block numbers count these blocks.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.text import nullif_empty, squeeze
from docframe.session import arrow_schema, batched


def blocks(xml: Column, tag: str) -> Column:
    """All blocks of a tag such as ``w:p``, in order; null gives null."""
    return F.regexp_extract_all(xml, F.lit(rf"(<{tag}\b[\s\S]*?</{tag}>)"), F.lit(1))


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("xml", T.StringType())])


@F.pandas_udf(T.ArrayType(_SPAN))
def _spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, tags in batches:
        tag = re.escape(tags.iloc[0]) if len(tags) else ""
        pattern = re.compile(rf"<{tag}\b[\s\S]*?</{tag}>", re.ASCII)
        yield texts.map(lambda t: None if t is None else [{"start": m.start(), "stop": m.end(), "xml": m[0]} for m in pattern.finditer(t)])


def block_spans(xml: Column, tag: str) -> Column:
    """``array<struct<start, stop, xml>>`` of the blocks, 0-based, stop exclusive.

    Native functions give no offsets, and a fold over the blocks copies its array for each of them, so
    this is one pass per document in an Arrow batch.
    """
    return _spans(xml, F.lit(tag))


_PLACED = T.StructType([*_SPAN.fields, T.StructField("inside", T.BooleanType())])


@F.pandas_udf(T.ArrayType(_PLACED))
def _placed_spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def find(text: str | None, pattern: re.Pattern, outer: re.Pattern) -> list[dict] | None:
        if text is None:
            return None
        ranges = [m.span() for m in outer.finditer(text)]
        starts = [a for a, _ in ranges]
        out = []
        for m in pattern.finditer(text):
            at = bisect_right(starts, m.start()) - 1
            out.append({"start": m.start(), "stop": m.end(), "xml": m[0], "inside": at >= 0 and m.start() < ranges[at][1]})
        return out

    for texts, tags, outers in batches:
        pattern, outer = (re.compile(rf"<{t}\b[\s\S]*?</{t}>", re.ASCII) for t in (re.escape(x.iloc[0]) if len(x) else "" for x in (tags, outers)))
        yield texts.map(lambda t, pattern=pattern, outer=outer: find(t, pattern, outer))


def placed_spans(xml: Column, tag: str, outer: str) -> Column:
    """:func:`block_spans` with ``inside``: whether the block starts in a block of ``outer``."""
    return _placed_spans(xml, F.lit(tag), F.lit(outer))


_TEXT = re.compile(r"<w:t\b[^>]*>([\s\S]*?)</w:t>", re.ASCII)
_BLANKS = re.compile(r"\s+", re.ASCII)
_VALUES = {t: re.compile(rf'<{t}\b[^>]*\sw:val="([^"]+)"', re.ASCII) for t in ("w:pStyle", "w:numId")}


def _value(block: str, tag: str) -> str | None:
    got = _VALUES[tag].search(block) if f"<{tag}" in block else None
    return got[1] if got else None


def paragraph_rows(documents: DataFrame, with_xml: bool = True) -> DataFrame:
    """``file_key, paragraph_index, in_table, raw_text, p_style, num_id`` and the block as ``xml`` of the paragraphs without a section break.

    What :func:`placed_spans`, :func:`block_text` and :func:`attribute` give, in one pass over each document:
    each pattern in the columns is a scan of its own, and a Python function among them gets every text.
    """
    pattern, outer = (re.compile(rf"<{t}\b[\s\S]*?</{t}>", re.ASCII) for t in ("w:p", "w:tbl"))

    def rows(key: str, xml: str) -> Iterator[tuple]:
        ranges = [m.span() for m in outer.finditer(xml)]
        starts = [a for a, _ in ranges]
        for i, m in enumerate(pattern.finditer(xml)):
            block = m[0]
            if "<w:sectPr" in block:
                continue
            at = bisect_right(starts, m.start()) - 1
            seen = html.unescape("".join(_TEXT.findall(block)))
            yield key, i, at >= 0 and m.start() < ranges[at][1], _BLANKS.sub(" ", seen).strip(" "), _value(block, "w:pStyle"), _value(block, "w:numId"), *((block,) if with_xml else ())

    schema = "file_key string, paragraph_index int, in_table boolean, raw_text string, p_style string, num_id string" + (", xml string" if with_xml else "")
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((row for batch in batches for key, xml in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in rows(key, xml)), shape)

    return documents.where("xml is not null").select("file_key", "xml").mapInArrow(run, schema)


def explode_blocks(df: DataFrame, column: str, tag: str, index: str = "idx", block: str = "block") -> DataFrame:
    """One row per block with its 0-based number; rows without blocks give none."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(blocks(F.col(column), tag)).alias(index, block))


@F.pandas_udf(T.StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else html.unescape(t))


def unescape(text: Column) -> Column:
    """Character references resolved once; texts without an ampersand stay in the JVM's hands untouched."""
    return F.when(F.instr(text, "&") > 0, _unescape(text)).otherwise(text)


def unescape_basic(text: Column) -> Column:
    """The five XML entities resolved natively, the ampersand last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def escape_attribute(text: Column) -> Column:
    """A text as an attribute value, the ampersand first."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def raw_text(block: Column) -> Column:
    """The text nodes of a block joined, still escaped."""
    return F.array_join(F.regexp_extract_all(block, F.lit(r"<w:t\b[^>]*>([\s\S]*?)</w:t>"), F.lit(1)), "")


def block_text(block: Column) -> Column:
    """Visible text: text nodes joined, references resolved once, white space squeezed."""
    return squeeze(unescape(raw_text(block)))


def attribute(xml: Column, tag: str, name: str = "w:val") -> Column:
    """First value of an attribute of a tag; null if there is none."""
    return nullif_empty(F.regexp_extract(xml, rf'<{tag}\b[^>]*\s{name}="([^"]+)"', 1))


def on_off(xml: Column, tag: str) -> Column:
    """Tri-state switch: null without the element, false for false, 0, off and none, else true."""
    there = F.regexp_extract(xml, rf"(<{tag}(\s[^>]*)?/?>)", 1)
    value = F.lower(F.trim(F.regexp_extract(there, r'w:val\s*=\s*"([^"]+)"', 1)))
    return F.when(there != "", ~value.isin("false", "0", "off", "none"))


def numbering(block: Column) -> Column:
    """``struct<numId, ilvl>`` of a paragraph, null if it has neither."""
    num, level = attribute(block, "w:numId"), attribute(block, "w:ilvl")
    return F.when(num.isNotNull() | level.isNotNull(), F.struct(num.alias("numId"), level.alias("ilvl")))


def layout_hints(block: Column) -> Column:
    """``struct<jc, ind<left,right,firstLine,hanging>, spacing<before,after,line>>`` as strings."""
    ind = F.struct(*(attribute(block, "w:ind", f"w:{k}").alias(k) for k in ("left", "right", "firstLine", "hanging")))
    spacing = F.struct(*(attribute(block, "w:spacing", f"w:{k}").alias(k) for k in ("before", "after", "line")))
    return F.struct(attribute(block, "w:jc").alias("jc"), ind.alias("ind"), spacing.alias("spacing"))


def run_hints(block: Column) -> Column:
    """``struct<bold, italic, underline>``, tri-state."""
    return F.struct(on_off(block, "w:b").alias("bold"), on_off(block, "w:i").alias("italic"), on_off(block, "w:u").alias("underline"))


def has_section_break(block: Column) -> Column:
    return F.contains(block, F.lit("<w:sectPr"))


def tag_block(xml: Column, tag: str) -> Column:
    """First block of a tag, a self-closing one before a paired one; null if there is none."""
    one = nullif_empty(F.regexp_extract(xml, rf"(<{tag}\b[^>]*/>)", 1))
    return F.coalesce(one, nullif_empty(F.regexp_extract(xml, rf"(<{tag}\b[^>]*>[\s\S]*?</{tag}>)", 1)))


def without_tag(xml: Column, tag: str) -> Column:
    """``xml`` without all blocks of a tag."""
    return F.regexp_replace(F.regexp_replace(xml, rf"<{tag}\b[^>]*/>", ""), rf"<{tag}\b[^>]*>[\s\S]*?</{tag}>", "")


# What an edit may change in a paragraph.
EDITABLE = ["w:pStyle", "w:numPr", "w:jc", "w:ind", "w:spacing", "w:rFonts", "w:sz", "w:szCs"]


def contract_form(block: Column) -> Column:
    """A paragraph without everything an edit may change and without shells that this empties."""
    for tag in EDITABLE:
        block = without_tag(block, tag)
    for shell in ("w:rPr", "w:pPr"):
        block = F.regexp_replace(F.regexp_replace(block, rf"<{shell}>\s*</{shell}>", ""), rf"<{shell}\s*/>", "")
    return block


_WITHOUT = {t: [re.compile(p, re.ASCII) for p in (rf"<{t}\b[^>]*/>", rf"<{t}\b[^>]*>[\s\S]*?</{t}>")] for t in EDITABLE}
_SHELLS = {t: [re.compile(p, re.ASCII) for p in (rf"<{t}>\s*</{t}>", rf"<{t}\s*/>")] for t in ("w:rPr", "w:pPr")}


def contract_form_of(block: str) -> str:
    """:func:`contract_form` of one text, for Python that has it at hand."""
    for tag, patterns in (_WITHOUT | _SHELLS).items():
        if f"<{tag}" in block:
            for pattern in patterns:
                block = pattern.sub("", block)
    return block


# Section properties that are managed by the template.
MANAGED_SECTION = ["pgSz", "pgMar", "cols", "docGrid", "type", "pgNumType", "vAlign", "textDirection", "bidi", "rtlGutter", "lnNumType", "pgBorders", "paperSrc", "formProt", "noEndnote"]
# Order of the children of section properties.
SECTION_ORDER = [
    "headerReference", "footerReference", "type", "pgSz", "pgMar", "paperSrc", "pgBorders", "lnNumType", "pgNumType", "cols", "formProt", "vAlign",
    "noEndnote", "titlePg", "textDirection", "bidi", "rtlGutter", "docGrid", "printerSettings", "sectPrChange",
]


def section_form(xml: Column) -> Column:
    """Section properties without managed tags and header or footer references, tags close together."""
    for tag in [*MANAGED_SECTION, "headerReference", "footerReference", "titlePg"]:
        xml = without_tag(xml, f"w:{tag}")
    return F.trim(F.regexp_replace(xml, r">\s+<", "><"))


def run_form(xml: Column) -> Column:
    """Run properties without fonts and sizes, white space squeezed."""
    for tag in ("w:rFonts", "w:sz", "w:szCs"):
        xml = without_tag(xml, tag)
    return squeeze(F.regexp_replace(xml, r">\s+<", "><"))


def margins(xml: Column) -> Column:
    """The six page margins as strings."""
    block = F.coalesce(tag_block(xml, "w:pgMar"), F.lit(""))
    return F.struct(*(attribute(block, "w:pgMar", f"w:{k}").alias(k) for k in ("top", "right", "bottom", "left", "header", "footer")))


def fragment_error(xml: Column, tag: str) -> Column:
    """Message if a fragment is not one element of that name; null for blank and sound ones."""
    text = F.trim(F.coalesce(xml, F.lit("")))
    sound = text.rlike(rf"^<{tag}\b[^>]*/>$") | (text.rlike(rf"^<{tag}[\s>]") & text.endswith(f"</{tag}>"))
    return F.when((text != "") & ~sound, F.format_string("expected <%s>: %s", F.lit(tag), F.substring(text, 1, 60)))


def header_footer_relationships(rels: Column) -> Column:
    """The relationships to headers and footers, sorted."""
    every = F.regexp_extract_all(rels, F.lit(r"(<Relationship\b[^>]*>)"), F.lit(1))
    return F.array_sort(F.filter(every, lambda r: r.rlike(r'\sType="[^"]*/relationships/(header|footer)"')))
