"""Style sheets as text: lookups, dependencies, inheritance, hardening and import."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import edit, markup
from docframe.functions.text import squeeze

# Styles that exist without a definition, and run properties an imported style must name itself.
IMPLICIT = {"Normal", "DefaultParagraphFont", "TableNormal", "NoList"}
HARDENED = ("w:rFonts", "w:sz", "w:szCs", "w:lang")
MAX_HOPS = 50
#: Hardened blocks that a sheet remembers; numbered ones differ from package to package.
MAX_MADE = 1000


def style_blocks(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pos, style_id, xml`` of all style blocks of ``sheets(keys, xml)`` in order; blocks without id are left out."""
    rows = sheets.select(*keys, F.posexplode(markup.blocks(F.col("xml"), "w:style")).alias("pos", "xml"))
    return rows.select(*keys, "pos", markup.attribute(F.col("xml"), "w:style", "w:styleId").alias("style_id"), "xml").where("style_id is not null")


def first_and_last(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, style_id, first_xml, last_xml``: the block of an id that wins as a definition, and the one that wins in a map."""
    return blocks.groupBy(*keys, "style_id").agg(F.min_by("xml", "pos").alias("first_xml"), F.max_by("xml", "pos").alias("last_xml"))


def brings_layout(xml: Column) -> Column:
    """Whether a style brings its own paragraph layout."""
    return F.coalesce(xml.rlike("<w:(spacing|ind|jc|numPr)"), F.lit(False))


def renumbered(xml: Column, old: Column, new: Column) -> Column:
    """A style block with one number in place of another."""
    return F.regexp_replace(xml, F.concat(F.lit(r'(<w:numId\s+w:val=")'), old.cast("string"), F.lit('"')), F.concat(F.lit("$1"), new.cast("string"), F.lit('"')))


def same_form(a: Column, b: Column) -> Column:
    """Whether two blocks differ in white space only."""
    return squeeze(a).eqNullSafe(squeeze(b))


@dataclass
class Sheet:
    """A style sheet with its blocks by id; the first block of an id is the one that counts."""

    xml: str
    first: dict[str, str] = field(default_factory=dict)
    last: dict[str, str] = field(default_factory=dict)
    made: dict[tuple[str, str], str] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        for at in edit.find_all(self.xml, "w:style"):
            block = edit.outer(self.xml, at)
            if style_id := edit.attr(edit.opening_tag(self.xml, at), "w:styleId"):
                self.first.setdefault(style_id, block)
                self.last[style_id] = block

    def reference(self, style_id: str, kind: str) -> str | None:
        block = self.first.get(style_id, "")
        at = edit.find(block, f"w:{kind}")
        return edit.attr(edit.opening_tag(block, at), "w:val") if at else None

    def dependencies(self, wanted: list[str]) -> set[str]:
        """The wanted styles and all they reach by basedOn, link and next; unknown ones stay in the set."""
        seen: set[str] = set()
        todo = list(wanted)
        while todo:
            style_id = todo.pop()
            if style_id not in seen:
                seen.add(style_id)
                todo += [x for kind in ("basedOn", "link", "next") if (x := self.reference(style_id, kind))]
        return seen

    def ancestors(self, style_id: str) -> list[str]:
        """Blocks of the style and its ancestors, nearest first; circles and long chains end."""
        out, seen, at = [], set(), style_id
        while at and at not in seen and at in self.first and len(out) < MAX_HOPS:
            seen.add(at)
            out.append(self.first[at])
            at = self.reference(at, "basedOn")
        return out

    def default(self, tag: str) -> str:
        """Content of the default run or paragraph properties."""
        whole = edit.find(self.xml, "w:docDefaults")
        got = whole and edit.find(self.xml, tag, whole.start, whole.stop)
        return edit.inner(self.xml, got).strip() if got else ""

    def effective_runs(self, style_id: str) -> dict[str, str]:
        """Each hardened run property from the nearest ancestor that has it, else from the defaults."""
        contents = [_content(b, "w:rPr") for b in self.ancestors(style_id)] + [self.default("w:rPr")]
        found = {tag: next((edit.outer(c, at) for c in contents if (at := edit.find(c, tag))), None) for tag in HARDENED}
        return {tag: xml for tag, xml in found.items() if xml}

    def effective_paragraph(self, style_id: str) -> str:
        """The first non-empty paragraph properties up the chain as a whole, else the defaults; never styles or numbering."""
        contents = [_content(b, "w:pPr") for b in self.ancestors(style_id)] + [self.default("w:pPr")]
        return next((c for x in contents if (c := edit.without(x, "w:pStyle", "w:numPr").strip())), "")

    def numbering(self, style_id: str) -> str | None:
        """Numbering properties of the nearest ancestor that has any."""
        for block in self.ancestors(style_id):
            if at := edit.find(block, "w:numPr"):
                return edit.outer(block, at)
        return None

    def used_numbers(self) -> dict[str, int]:
        """Style id to the number it uses itself."""
        out = {}
        for style_id, block in self.last.items():
            if (at := edit.find(block, "w:numId")) and re.fullmatch("[0-9]+", n := edit.attr(edit.opening_tag(block, at), "w:val") or ""):
                out[style_id] = int(n)
        return out

    def hardened(self, style_id: str, block: str) -> str:
        """The block with what it inherits written out: paragraph properties if it has none, missing run properties."""
        if len(self.made) > MAX_MADE:
            self.made.clear()
        if (style_id, block) not in self.made:
            self.made[style_id, block] = self._hardened(style_id, block)
        return self.made[style_id, block]

    def _hardened(self, style_id: str, block: str) -> str:
        kind = edit.attr(block[: block.index(">") + 1], "w:type")
        if kind == "paragraph" and not edit.find(block, "w:pPr") and (content := self.effective_paragraph(style_id)):
            block = edit.before_close(block, "w:style", f"\n  <w:pPr>{content}</w:pPr>\n") or block
        runs = self.effective_runs(style_id)
        at = edit.find(block, "w:rPr")
        if not at:
            return (edit.before_close(block, "w:style", f"\n  <w:rPr>{''.join(runs.values())}</w:rPr>\n") or block) if runs else block
        content = edit.inner(block, at)
        missing = "".join(x for tag, x in runs.items() if not edit.find(content, tag))
        return edit.put(block, at, f"{edit.opening_tag(block, at).rstrip('/>').rstrip()}>{content}{missing}</w:rPr>") if missing else block


def _content(block: str, tag: str) -> str:
    at = edit.find(block, tag)
    return edit.inner(block, at) if at else ""


def has_layout(block: str) -> bool:
    """Whether a style brings its own paragraph layout."""
    return any(mark in block for mark in ("<w:spacing", "<w:ind", "<w:jc", "<w:numPr"))


def same(a: str, b: str) -> bool:
    return " ".join(a.split()) == " ".join(b.split())


def with_number(block: str, old: int, new: int) -> str:
    return re.sub(rf'(<w:numId\s+w:val="){old}"', lambda m: f'{m[1]}{new}"', block)


def import_styles(target_xml: str, template: Sheet, wanted: list[str], numbers: dict[str, tuple[int, int]] | None = None) -> tuple[str, dict[str, str]]:
    """The target sheet with the wanted styles and all they need, and what was done per style.

    A style that is equal is skipped, one that differs replaced, one that is absent inserted. A style
    with numbering needs its entry (old, new) in ``numbers``; a needed style without definition is
    an error unless it exists implicitly. Running twice changes nothing.
    """
    target, done, fresh, missing, xml = Sheet(target_xml), {}, [], [], target_xml
    for style_id in sorted(template.dependencies(wanted)):
        block = template.first.get(style_id)
        if block is None:
            if style_id in IMPLICIT:
                done[style_id] = "implicit"
            else:
                missing.append(style_id)
            continue
        if "<w:numPr" in block:
            if style_id not in (numbers or {}):
                raise ValueError(f"style {style_id} is numbered but its number was not imported")
            block = with_number(block, *numbers[style_id])
        block = template.hardened(style_id, block)
        have = target.first.get(style_id)
        if have is None:
            done[style_id] = "insert"
            fresh.append(block)
        elif same(have, block):
            done[style_id] = "skip"
        else:
            done[style_id] = "replace"
            xml = xml.replace(have, block, 1)
    if missing:
        raise ValueError(f"the template lacks styles that are needed: {missing}")
    if fresh:
        put = edit.before_close(xml, "w:styles", "\n" + "\n".join(fresh) + "\n")
        if put is None:
            raise ValueError("the target style sheet is not closed")
        xml = put
    return xml, done


IMPORTED = "file_key string, xml string, done map<string,string>, error string"


def import_rows(rows: DataFrame) -> DataFrame:
    """:func:`import_styles` for ``rows(file_key, target, template, wanted)``, sheets as texts: ``file_key, xml, done, error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    xml, done = import_styles(row.target, Sheet(row.template), list(row.wanted))
                    out.append((row.file_key, xml, done, None))
                except ValueError as error:
                    out.append((row.file_key, None, None, str(error)))
            yield pd.DataFrame(out, columns=["file_key", "xml", "done", "error"])

    return rows.select("file_key", "target", "template", "wanted").mapInPandas(run, IMPORTED)
