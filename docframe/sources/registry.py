"""Style and template registries: small JSON contracts read with explicit schemas, checked as relations."""

from __future__ import annotations

import os

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import markup
from docframe.functions.text import nullif_empty
from docframe.operators.relational import raise_if_any

STYLE_FILE, TEMPLATE_FILE = "arch_style_registry.json", "arch_template_registry.json"
ROLE_SCHEMA = "version int, source_docx string, roles map<string,struct<style_id:string,styleId_:string>>, source_tokens map<string,string>"
_STYLE = "style_id:string,type:string,name:string,based_on:string,next:string,link:string,ui_priority:int,semi_hidden:boolean,unhide_when_used:boolean,qformat:boolean,pPr:string,rPr:string,tblPr:string,trPr:string,tcPr:string"
_SECTION = "sectPr:string,header_refs:map<string,string>,footer_refs:map<string,string>,headers:map<string,string>,footers:map<string,string>"
_MEDIA = "path:string,target:string,name:string,filename:string,content_base64:string,base64:string,data:string,data_base64:string"
_ENTRY = f"part_name:string,xml:string,part_xml:string,rels_xml:string,relationships_xml:string,rels_part_name:string,rel_id:string,rid:string,relationship_id:string,media:array<struct<{_MEDIA}>>,media_files:array<struct<{_MEDIA}>>"
TEMPLATE_SCHEMA = (
    "version string, doc_defaults struct<default_run_props:struct<rPr:string>,default_paragraph_props:struct<pPr:string>>, "
    f"styles struct<style_defs:array<struct<{_STYLE}>>>, theme struct<theme1_xml:string>, fonts struct<font_table_xml:string>, "
    "settings struct<compat:struct<compat_xml:string>>, "
    "numbering struct<abstract_nums:array<struct<abstractNumId:int,xml:string>>,nums:array<struct<numId:int,abstractNumId:int,xml:string>>>, "
    f"page_layout struct<default_section:struct<{_SECTION}>,section_chain:array<struct<{_SECTION}>>>, headers_footers struct<headers:array<struct<{_ENTRY}>>,footers:array<struct<{_ENTRY}>>>"
)
# Optional raw parts beside the contracts.
RAW_STYLES, RAW_SETTINGS = "arch_styles_raw.xml", "arch_settings_raw.xml"
# Fragments of a style and the element each must be.
FRAGMENTS = {"pPr": "w:pPr", "rPr": "w:rPr", "tblPr": "w:tblPr", "trPr": "w:trPr", "tcPr": "w:tcPr"}


def contract_root(path: str) -> str:
    """The folder of both contract files, given it or one of them."""
    system, place = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    is_file = system.get_file_info(place).type == pafs.FileType.File
    folder, place = (os.path.dirname(x) if is_file else x for x in (path, place))
    missing = [n for n in (STYLE_FILE, TEMPLATE_FILE) if system.get_file_info(f"{place}/{n}").type != pafs.FileType.File]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return folder


def raw_part(spark: SparkSession, folder: str, name: str) -> str | None:
    """A raw part beside the contracts; None if there is none."""
    path = os.path.join(folder, name)
    system, place = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    if system.get_file_info(place).type != pafs.FileType.File:
        return None
    return spark.read.text(path, wholetext=True).first().value


def numbering_rows(template_row: DataFrame, keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Numbers ``(keys, num_id, abstract_id, xml)`` and abstract definitions ``(keys, abstract_id, xml)`` of registries; the last row of an id counts."""
    nums = template_row.select(*keys, F.posexplode("numbering.nums").alias("pos", "n")).select(*keys, "pos", F.col("n.numId").alias("num_id"), F.col("n.abstractNumId").alias("abstract_id"), F.coalesce("n.xml", F.lit("")).alias("xml"))
    abstracts = template_row.select(*keys, F.posexplode("numbering.abstract_nums").alias("pos", "a")).select(*keys, "pos", F.col("a.abstractNumId").alias("abstract_id"), F.coalesce("a.xml", F.lit("")).alias("xml"))
    last = lambda rows, name, *rest: rows.where(f"{name} is not null").groupBy(*keys, name).agg(*(F.max_by(c, "pos").alias(c) for c in rest))
    return last(nums, "num_id", "abstract_id", "xml"), last(abstracts, "abstract_id", "xml")


def parsed(text: Column, schema: str) -> Column:
    """A contract's JSON as a struct. Names that differ in case only are told apart before parsing."""
    return F.from_json(F.replace(F.replace(text, F.lit('"styleId"'), F.lit('"styleId_"')), F.lit('"rId"'), F.lit('"rid"')), schema)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file."""
    return spark.read.text(path, wholetext=True).select(parsed(F.col("value"), schema).alias("j")).select("j.*")


def usable_roles(contracts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, role, style_id`` of parsed style registries: usable roles only, either spelling of the key, trimmed."""
    rows = contracts.select(*keys, F.explode("roles").alias("role", "r"))
    return rows.select(*keys, "role", F.coalesce(nullif_empty(F.trim("r.style_id")), nullif_empty(F.trim("r.styleId_"))).alias("style_id")).where("style_id is not null")


def role_styles(spark: SparkSession, folder: str) -> DataFrame:
    """``role, style_id`` of one registry; an error if no role is usable."""
    usable = usable_roles(_json(spark, os.path.join(folder, STYLE_FILE), ROLE_SCHEMA), [])
    if usable.isEmpty():
        raise ValueError("no role of the style registry has a style")
    return usable


def available_roles(spark: SparkSession, folder: str) -> list[str] | None:
    """All role names, usable or not, sorted; None without a registry file."""
    path = os.path.join(folder, STYLE_FILE)
    system, place = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    if system.get_file_info(place).type != pafs.FileType.File:
        return None
    return _json(spark, path, ROLE_SCHEMA).select(F.array_sort(F.map_keys("roles")).alias("r")).first().r


def source_tokens(spark: SparkSession, folder: str) -> dict[str, str]:
    return dict(_json(spark, os.path.join(folder, STYLE_FILE), ROLE_SCHEMA).select("source_tokens").first().source_tokens or {})


def template(spark: SparkSession, folder: str) -> DataFrame:
    """The template registry, one row; sections that are absent are null."""
    return _json(spark, os.path.join(folder, TEMPLATE_FILE), TEMPLATE_SCHEMA)


def style_defs(template_row: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Style definitions with their position."""
    return template_row.select(*keys, F.posexplode("styles.style_defs").alias("pos", "s")).select(*keys, "pos", "s.*")


def style_markup() -> F.Column:
    """One style definition as markup: attributes escaped, fragments verbatim, a missing name is the id."""
    value = lambda tag, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f'<w:{tag} w:val="'), markup.escape_attribute(F.col(c).cast("string")), F.lit('"/>')))
    flag = lambda tag, c: F.when(F.col(c), f"<w:{tag}/>")
    opened = F.concat(F.lit('<w:style w:type="'), markup.escape_attribute(F.coalesce("type", F.lit("paragraph"))), F.lit('" w:styleId="'), markup.escape_attribute(F.col("style_id")), F.lit('">'))
    name = F.concat(F.lit('<w:name w:val="'), markup.escape_attribute(F.coalesce(nullif_empty(F.col("name")), F.col("style_id"))), F.lit('"/>'))
    return F.concat_ws(
        "\n", opened, name, value("basedOn", "based_on"), value("next", "next"), value("link", "link"), value("uiPriority", "ui_priority"), flag("semiHidden", "semi_hidden"),
        flag("unhideWhenUsed", "unhide_when_used"), flag("qFormat", "qformat"), *(nullif_empty(F.col(c)) for c in FRAGMENTS), F.lit("</w:style>"),
    )


# Namespaces of a style sheet.
SHEET_HEAD = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" '
    'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml">'
)


def defaults_markup(run: F.Column, paragraph: F.Column) -> F.Column:
    """Document defaults from two fragments; an empty element stands for a missing one."""
    return F.concat(
        F.lit("<w:docDefaults>\n<w:rPrDefault>"), F.coalesce(nullif_empty(run), F.lit("<w:rPr/>")), F.lit("</w:rPrDefault>\n<w:pPrDefault>"),
        F.coalesce(nullif_empty(paragraph), F.lit("<w:pPr/>")), F.lit("</w:pPrDefault>\n</w:docDefaults>"),
    )


def style_sheets(defs: DataFrame, keys: list[str], run: F.Column | None = None, paragraph: F.Column | None = None) -> DataFrame:
    """``keys, xml``: a synthetic style sheet per key from rows with ``pos`` and the style columns; rows without id are left out."""
    made = defs.where("coalesce(style_id, '') <> ''").select(*keys, "pos", style_markup().alias("m"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]), "\n")
    head = F.concat(F.lit(SHEET_HEAD), F.lit("\n"), defaults_markup(run if run is not None else F.lit(""), paragraph if paragraph is not None else F.lit("")), F.lit("\n"))
    return made.groupBy(*keys).agg(body.alias("b")).select(*keys, F.concat(head, F.col("b"), F.lit("\n</w:styles>")).alias("xml"))


def template_sheet(template_row: DataFrame, raw: str | None = None) -> str:
    """The template's style sheet: the raw one if given, else put together from the definitions."""
    if raw:
        return raw
    ends = template_row.select("doc_defaults.default_run_props.rPr", "doc_defaults.default_paragraph_props.pPr").first()
    sheet = style_sheets(style_defs(template_row).withColumn("k", F.lit(1)), ["k"], F.lit(ends.rPr or ""), F.lit(ends.pPr or "")).first()
    return sheet.xml if sheet else f"{SHEET_HEAD}\n</w:styles>"


def header_footer_entries(template_row: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Headers, then footers: ``kind, pos, part_name, xml, rels_xml, rels_part_name, rid, media``, alias columns merged."""
    parts = []
    for kind, column in (("header", "headers"), ("footer", "footers")):
        rows = template_row.select(*keys, F.lit(kind).alias("kind"), F.posexplode(f"headers_footers.{column}").alias("pos", "e")).where("e is not null")
        parts.append(
            rows.select(
                *keys, "kind", "pos", "e.part_name", F.coalesce(nullif_empty(F.col("e.xml")), F.col("e.part_xml")).alias("xml"), F.coalesce(nullif_empty(F.col("e.rels_xml")), F.col("e.relationships_xml")).alias("rels_xml"),
                "e.rels_part_name", F.coalesce("e.relationship_id", "e.rid", "e.rel_id").alias("rid"), F.when(F.size("e.media") > 0, F.col("e.media")).otherwise(F.col("e.media_files")).alias("media"),
            )
        )
    return parts[0].unionByName(parts[1])


def media_items(entries: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``part_name, item, filename, content`` of the media with a name and a content; names are base names."""
    rows = entries.select(*keys, "part_name", F.posexplode("media").alias("item", "m"))
    name = F.coalesce(*(nullif_empty(F.trim(f"m.{c}")) for c in ("path", "target", "name", "filename")))
    content = F.coalesce(*(nullif_empty(F.col(f"m.{c}")) for c in ("content_base64", "base64", "data", "data_base64")))
    return rows.select(*keys, "part_name", (F.col("item") + 1).alias("item"), F.element_at(F.split(name, "/"), -1).alias("filename"), F.unbase64(content).alias("content")).where("filename <> '' and content is not null")


def violations(template_row: DataFrame, roles: DataFrame, keys: list[str] = ()) -> DataFrame:
    """All problems of both contracts at once: ``keys, rule, item``; empty if they are sound. ``keys`` tell templates apart."""
    keys = list(keys)
    defs = style_defs(template_row, keys).withColumn("id", F.trim(F.coalesce("style_id", F.lit(""))))
    rule = lambda df, name, item: df.select(*keys, F.lit(name).alias("rule"), item.cast("string").alias("item"))
    out = [
        rule(defs.where("id = ''"), "style_without_id", F.col("pos")),
        rule(defs.where("id <> ''").groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_style", F.col("id")),
        rule(roles.join(defs.select(*keys, F.col("id").alias("style_id")), [*keys, "style_id"], "left_anti"), "role_style_unknown", F.concat_ws(":", "role", "style_id")),
    ]
    for column, tag in FRAGMENTS.items():
        error = markup.fragment_error(F.col(column), tag)
        out.append(rule(defs.where(error.isNotNull()), f"bad_{column}", F.col("id")))
    for column, tag in (("settings.compat.compat_xml", "w:compat"), ("theme.theme1_xml", "a:theme"), ("fonts.font_table_xml", "w:fonts"), ("page_layout.default_section.sectPr", "w:sectPr")):
        error = markup.fragment_error(F.col(column), tag)
        out.append(rule(template_row.where(error.isNotNull()), "bad_fragment", F.lit(column)))
    default = F.col("page_layout.default_section.sectPr")
    out.append(rule(template_row.where(F.trim(F.coalesce(default, F.lit(""))) == ""), "no_default_section", F.lit("page_layout.default_section.sectPr")))
    chain = template_row.select(*keys, F.posexplode("page_layout.section_chain").alias("pos", "s"))
    out.append(rule(chain.where(markup.fragment_error(F.col("s.sectPr"), "w:sectPr").isNotNull()), "bad_section", F.col("pos")))
    abstracts = template_row.select(*keys, F.explode("numbering.abstract_nums").alias("a")).select(*keys, "a.abstractNumId")
    nums = template_row.select(*keys, F.explode("numbering.nums").alias("n")).select(*keys, "n.numId", "n.abstractNumId")
    out.append(rule(abstracts.where("abstractNumId is null"), "abstract_without_id", F.lit("numbering.abstract_nums")))
    out.append(rule(nums.where("numId is null or abstractNumId is null"), "num_without_id", F.col("numId")))
    out.append(rule(nums.where("numId is not null").join(abstracts, [*keys, "abstractNumId"], "left_anti").where("abstractNumId is not null"), "num_abstract_unknown", F.concat_ws(":", "numId", "abstractNumId")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def check(template_row: DataFrame, roles: DataFrame) -> None:
    raise_if_any(violations(template_row, roles), "the registries are not sound", 100)
