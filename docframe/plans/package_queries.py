"""Queries on packages, registries, styles and environments put together from the tables, each with an independent DuckDB query.

The tables hold rows of styles, entries and parts, not archives; every query builds the documents, sheets or
registries of all packages or templates from whole tables and runs the operator of the pipeline on them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import edit, markup, text
from docframe.operators import batches, classify, environment, footers, layout, numbering, pipeline, relational, styles
from docframe.operators import paragraphs as doc_paragraphs
from docframe.operators.context import splice, with_context
from docframe.operators.hierarchy import current_rows
from docframe.operators.references import part_key
from docframe.plans.link_queries import ROLE_STYLES, deterministic, unresolved_filter
from docframe.plans.sql import blank_trim
from docframe.plans.text_queries import ROWS, _MARKER, _RULE, bundle_rows, strip_sql
from docframe.session import cut, scratch, spread
from docframe.sources import docx, registry
from docframe.sources.tables import table

_PART = "nullif(trim(regexp_replace(trim(part_name), '^(\\./|/)', '')), '')"


def esc(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


# ---- what the tables hold, as the operators take it ----


def entries(spark, folder):
    """Header and footer entries with a part and content, once per id."""
    rows = table(spark, folder, "hf_entries").where("file_key is not null and xml is not null").select("entry_id", "file_key", "hf_kind", part_key(F.col("part_name")).alias("part"), F.trim("rid").alias("rid"), "xml")
    return rows.where("part is not null").distinct()


ENTRIES = f"entries as (select distinct entry_id, file_key, hf_kind, {_PART} as part, trim(rid) as rid, xml from hf_entries where file_key is not null and xml is not null and {_PART} is not null)"


def entry_parts(spark, folder):
    """One content per part name of a file, in the order of the names."""
    rows = entries(spark, folder).groupBy("file_key", "part").agg(F.max("xml").alias("xml"))
    return relational.numbered(rows, ["file_key"], [F.col("part")], "ordinal")


PARTS = f"{ENTRIES}, parts as (select file_key, part, max(xml) as xml, row_number() over (partition by file_key order by part) - 1 as ordinal from entries group by file_key, part)"


def part_rows(spark, folder):
    return entry_parts(spark, folder).select("file_key", F.col("ordinal").cast("int").alias("ordinal"), F.col("part").alias("part_name"), F.lit(8).alias("compress_type"), F.encode("xml", "UTF-8").alias("content"))


_STYLE_COLUMNS = ["style_type", "style_name", "based_on", "next", "link", "ui_priority", "semi_hidden", "unhide_when_used", "qformat", "ppr", "rpr"]


def current_styles(spark, folder):
    """Current, undeleted styles of each template, in the order of their ids."""
    rows = table(spark, folder, "style_defs").where("template_key is not null and trim(style_id) <> ''")
    rows = rows.select("template_key", F.trim("style_id").alias("style_id"), *(F.expr(f"nullif(trim({c}), '')").alias(c) if c in ("based_on", "next", "link") else F.col(c) for c in _STYLE_COLUMNS), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), "revision", "loaded_at")
    now = current_rows(rows, ["template_key", "style_id"], "revision", ["loaded_at", "is_deleted", "based_on", "next", "link", "ppr", "rpr"])
    return relational.numbered(now.where("not is_deleted"), ["template_key"], [F.col("style_id")])


STYLES = """clean as (
  select template_key, trim(style_id) as style_id, style_type, style_name, nullif(trim(based_on), '') as based_on, nullif(trim("next"), '') as next, nullif(trim(link), '') as link, ui_priority, semi_hidden, unhide_when_used, qformat, ppr, rpr,
    coalesce(is_deleted, false) as is_deleted, coalesce(revision, -2147483648) as revision, loaded_at
  from style_defs where template_key is not null and trim(coalesce(style_id, '')) <> ''),
ranked as (select *, row_number() over (partition by template_key, style_id order by revision desc, loaded_at desc, is_deleted desc, based_on desc nulls last, next desc nulls last, link desc nulls last, ppr desc nulls last, rpr desc nulls last) as rank_ from clean),
styles as (select *, row_number() over (partition by template_key order by style_id) - 1 as pos from ranked where rank_ = 1 and not is_deleted)"""


def as_registry(rows):
    """Style rows under the names of a registry."""
    return rows.select("template_key", "pos", "style_id", F.col("style_type").alias("type"), F.col("style_name").alias("name"), "based_on", "next", "link", "ui_priority", "semi_hidden", "unhide_when_used", "qformat", F.col("ppr").alias("pPr"), F.col("rpr").alias("rPr"), *(F.lit(None).cast("string").alias(c) for c in ("tblPr", "trPr", "tcPr")))


def _style_sql() -> str:
    value = lambda tag, c: f"case when coalesce({c}::varchar, '') <> '' then '<w:{tag} w:val=\"' || {esc(f'{c}::varchar')} || '\"/>' end"
    flag = lambda tag, c: f"case when {c} then '<w:{tag}/>' end"
    opened = f"'<w:style w:type=\"' || {esc(chr(99) + 'oalesce(style_type, ' + chr(39) + 'paragraph' + chr(39) + ')')} || '\" w:styleId=\"' || {esc('style_id')} || '\">'"
    name = f"'<w:name w:val=\"' || {esc('coalesce(nullif(style_name, ' + chr(39) * 2 + '), style_id)')} || '\"/>'"
    parts = [opened, name, value("basedOn", "based_on"), value("next", "next"), value("link", "link"), value("uiPriority", "ui_priority"), flag("semiHidden", "semi_hidden"), flag("unhideWhenUsed", "unhide_when_used"), flag("qFormat", "qformat"), "nullif(ppr, '')", "nullif(rpr, '')", "'</w:style>'"]
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


STYLE_XML = _style_sql()


def sheets(spark, folder):
    """One style sheet per template from its current styles."""
    return registry.style_sheets(as_registry(current_styles(spark, folder)), ["template_key"])


_SHEET = f"'{registry.SHEET_HEAD}' || chr(10) || '<w:docDefaults>' || chr(10) || '<w:rPrDefault><w:rPr/></w:rPrDefault>' || chr(10) || '<w:pPrDefault><w:pPr/></w:pPrDefault>' || chr(10) || '</w:docDefaults>' || chr(10) || string_agg(m, chr(10) order by pos) || chr(10) || '</w:styles>'"


def documents(spark, folder):
    """One document part per file from its paragraphs; table rows stand in tables of their own."""
    rows = bundle_rows(spark, folder).where("file_key is not null")
    number = F.when(F.trim("marker_type") == "list_numpr", '<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>').otherwise("")
    block = F.concat(F.lit("<w:p>"), number, F.lit("<w:r><w:t>"), markup.escape_attribute(F.coalesce("text", F.lit(""))), F.lit("</w:t></w:r></w:p>"))
    block = F.when(F.col("in_table"), F.concat(F.lit("<w:tbl>"), block, F.lit("</w:tbl>"))).otherwise(block)
    joined = splice(spread(rows.select("file_key", "idx", block.alias("xml")), "file_key"), ["file_key"], "idx", "xml")
    return joined.select("file_key", F.concat(F.lit("<w:document><w:body>"), "xml", F.lit("</w:body></w:document>")).alias("xml"))


# Text of the paragraphs as the analysis sees them: entities resolved, white space squeezed, cleaned.
_CLEAN, _TAGS = strip_sql("raw")
ANALYSIS = f"""{ROWS}, numbered_ as (select file_key, row_number() over (partition by file_key order by idx) - 1 as i, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as raw, in_table, trim(marker_type) = 'list_numpr' as listed from rows_),
cleaned as (select *, {_CLEAN} as full_text, {_TAGS} as tags from numbered_ where raw <> ''),
kept as (select *, substr(full_text, 1, 200) as t, coalesce({_MARKER.format(c='full_text')}, case when listed then 'list_numpr' end) as marker from cleaned where full_text <> '' and not regexp_matches(full_text, '^\\s*(?i:END\\s+OF\\s+SECTION)')),
seen as (select *, lag(t) over w as before, lead(t) over w as after from kept window w as (partition by file_key order by i)),
analysed as (select *, {_RULE} as role from seen)"""

# ---- packages ----


def package_scan(spark, folder):
    """Packages written from the entries of a file and scanned back as a folder."""
    where = scratch(spark)
    docx.write_packages(part_rows(spark, folder), where).count()
    got = docx.read_packages(spark, where)
    return got.select(F.regexp_extract("file_key", "^(.*)__[0-9a-f]{12}$", 1).alias("file_key"), F.col("ordinal").cast("bigint").alias("ordinal"), "part_name", F.decode("content", "UTF-8").alias("xml"), F.col("error").isNull().alias("readable"))


def single_part(spark, folder):
    """One part by its name out of every archive."""
    archives = docx.build_packages(part_rows(spark, folder)).select("file_key", F.lit("").alias("path"), "content")
    return docx.part_text(docx.expand(archives), "word/header1.xml")


def output_assembly(spark, folder):
    """Packages patched and scanned again: headers replaced, footers left out, a style sheet added; names, order and contents."""
    rows = part_rows(spark, folder)
    headers = rows.where(F.col("part_name").rlike(r"^word/header[0-9]+\.xml$"))
    new = headers.select("file_key", "part_name", F.encode(F.concat(F.decode("content", "UTF-8"), F.lit("<!--new-->")), "UTF-8").alias("content"))
    sheet = rows.select("file_key").distinct().select("file_key", F.lit("word/styles.xml").alias("part_name"), F.encode(F.lit("<w:styles xmlns:w='w'/>"), "UTF-8").alias("content"))
    gone = rows.where(F.col("part_name").rlike(r"^word/footer[0-9]+\.xml$")).select("file_key", "part_name")
    patched = docx.patch_packages(rows, new.unionByName(sheet), gone, check=False)
    archives = docx.build_packages(patched).select("file_key", F.lit("").alias("path"), "content")
    return docx.expand(archives).select("file_key", F.col("ordinal").cast("bigint").alias("ordinal"), "part_name", F.decode("content", "UTF-8").alias("xml"))


def allowed_parts(spark, folder):
    """Which part names a patch may touch."""
    names = table(spark, folder, "package_parts").select("part_name").where("part_name is not null").distinct()
    return names.select("part_name", docx.patchable(part_key(F.col("part_name"))).alias("allowed"))


def _marked(spark, folder):
    """Entries as parts; those about installation are cut short, those about fabrication carry made-up prefixes."""
    rows = entries(spark, folder)
    cut_short = F.substring(F.col("xml"), F.lit(1), F.length("xml") - 1)
    prefixed = F.regexp_replace(F.regexp_replace("xml", "<w:p>", "<ns0:p xmlns:ns0='w'>"), "</w:p>", "</ns0:p>")
    xml = F.when(F.col("xml").contains("INSTALLATION"), cut_short).when(F.col("xml").contains("FABRICATION"), prefixed).otherwise(F.col("xml"))
    bound = F.regexp_replace(xml, "^<w:(hdr|ftr)>", "<w:$1 xmlns:w='w'>")
    return rows.select(F.concat_ws("#", "file_key", "entry_id").alias("file_key"), F.concat("part", F.lit("")).alias("part_name"), F.encode(bound, "UTF-8").alias("content"))


def wellformed_parts(spark, folder):
    """Parts that do not parse."""
    return docx.xml_errors(_marked(spark, folder)).select("file_key", "part_name", F.col("error").contains("XML parse error").alias("named"))


def prefix_check(spark, folder):
    """Parts with prefixes that a serializer made up."""
    return docx.namespace_errors(_marked(spark, folder))


def role_preflight(spark, folder):
    """Rows per role and whether the role has a style."""
    final = deterministic(spark, folder).select("file_key", F.col("idx").alias("paragraph_index"), "csi_role")
    return batches.preflight_report(final, spark.createDataFrame(ROLE_STYLES, "role string, style_id string"))


def answer_blocks(spark, folder):
    """Text blocks of an answer joined, others left out: the paragraphs of a delivery as blocks, table rows as another kind."""
    rows = table(spark, folder, "slim_bundle").where("file_key is not null")
    blocks = F.transform("paragraphs", lambda p: F.struct(F.when(F.coalesce(p["in_table"], F.lit(False)), "table").otherwise("text").alias("type"), F.coalesce(p["text"], F.lit("")).alias("text")))
    return rows.select("file_key", "received_at", F.size("paragraphs").cast("bigint").alias("n"), F.sha2(batches.text_of_blocks(blocks), 256).alias("digest")).distinct()


# ---- registries ----


def _style_contracts(spark, folder):
    """A style registry per template: each role with the first style of its stem, under either key; a role without one has a blank id."""
    first = current_styles(spark, folder).select("template_key", F.regexp_replace("style_id", "[0-9]+$", "").alias("stem"), "style_id").groupBy("template_key", "stem").agg(F.min("style_id").alias("style_id"))
    roles = table(spark, folder, "templates").select("template_key").withColumn("r", F.array(*(F.struct(F.lit(r).alias("role"), F.lit(s).alias("stem")) for r, s in ROLE_STYLES))).select("template_key", F.inline("r"))
    rows = roles.join(first, ["template_key", "stem"], "left")
    key = F.when(F.col("role") == "PART", "styleId").otherwise("style_id")
    entry = F.concat(F.lit('"'), "role", F.lit('":{"'), key, F.lit('":"'), F.coalesce(F.concat(F.lit(" "), "style_id"), F.lit(" ")), F.lit('"}'))
    body = F.array_join(F.array_sort(F.collect_list(entry)), ",")
    made = rows.groupBy("template_key").agg(F.concat(F.lit('{"version":1,"roles":{'), body, F.lit("}}")).alias("json"))
    return made.select("template_key", registry.parsed(F.col("json"), registry.ROLE_SCHEMA).alias("j")).select("template_key", "j.*")


def registry_roles(spark, folder):
    """Usable roles of every template's style registry."""
    return registry.usable_roles(_style_contracts(spark, folder), ["template_key"])


def registry_available(spark, folder):
    """All roles that a style registry names, usable or not."""
    return _style_contracts(spark, folder).select("template_key", F.array_join(F.array_sort(F.map_keys("roles")), ",").alias("roles"))


_ROLES = "r(role, stem) as (values " + ", ".join(f"('{r}', '{s}')" for r, s in ROLE_STYLES) + ")"


def _templates(spark, folder):
    """A parsed template registry per template: its styles, one number per style with a priority, entries of its packages as headers and footers."""
    style = F.struct(F.col("style_id"), F.col("style_type").alias("type"), F.col("style_name").alias("name"), "based_on", "next", "link", "ui_priority", "semi_hidden", "unhide_when_used", "qformat", F.col("ppr").alias("pPr"), F.col("rpr").alias("rPr"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", style.alias("s")))), lambda x: x["s"])
    defs = current_styles(spark, folder).groupBy("template_key").agg(F.to_json(F.struct(F.struct(ordered.alias("style_defs")).alias("styles"))).alias("json"))
    return defs.select("template_key", registry.parsed(F.col("json"), registry.TEMPLATE_SCHEMA).alias("j")).select("template_key", "j.*")


def template_registry(spark, folder):
    """The style definitions of every template's registry, read back from its JSON."""
    return registry.style_defs(_templates(spark, folder), ["template_key"]).select("template_key", F.col("pos").cast("bigint").alias("pos"), "style_id", "type", "based_on", "next", "link", "ui_priority", "semi_hidden", "qformat", "pPr", "rPr")


def registry_violations(spark, folder):
    """All problems of both contracts of every template at once."""
    templates = _templates(spark, folder)
    named = deterministic(spark, folder).join(spark.createDataFrame(ROLE_STYLES, "csi_role string, stem string"), "csi_role").select("template_key", F.col("csi_role").alias("role"), F.concat("stem", F.lit("1")).alias("style_id")).distinct()
    return registry.violations(templates, named.join(templates.select("template_key"), "template_key", "left_semi"), ["template_key"])


def style_sheets(spark, folder):
    return sheets(spark, folder)


def contract_config(spark, folder):
    """Both contract files of a run written, found from one of them, and read: roles with their styles, and how many roles are named."""
    where = scratch(spark)
    roles = ",".join(f'"{r}":{{"style_id":"{s}"}}' for r, s in ROLE_STYLES) + ',"END_OF_SECTION":{"styleId":" "}'
    for name, body in ((registry.STYLE_FILE, f'{{"version":1,"roles":{{{roles}}}}}'), (registry.TEMPLATE_FILE, _template_json(spark, folder))):
        _write_text(where, name, body)
    config = pipeline.load_config(spark, f"{where}/{registry.STYLE_FILE}")
    return spark.createDataFrame([(r, s, len(config.available), config.sheet.count("<w:style ")) for r, s in config.roles.items()], "role string, style_id string, n_available long, n_styles long")


def _write_text(folder: str, name: str, body: str) -> None:
    import pyarrow.fs as pafs

    system, root = pafs.FileSystem.from_uri(docx._uri(folder))
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(body.encode())


def _template_json(spark, folder) -> str:
    """One template with a style per role, a default section and no numbering."""
    defs = ",".join(f'{{"style_id":"{s}","type":"paragraph","name":"{s}","based_on":"Base","pPr":"<w:pPr><w:spacing w:after=\\"4\\"/></w:pPr>"}}' for s in [*dict.fromkeys(s for _, s in ROLE_STYLES)])
    base = '{"style_id":"Base","type":"paragraph","name":"Base","rPr":"<w:rPr><w:sz w:val=\\"20\\"/></w:rPr>"}'
    return f'{{"version":"1","styles":{{"style_defs":[{base},{defs}]}},"page_layout":{{"default_section":{{"sectPr":"<w:sectPr><w:pgSz w:w=\\"9\\"/></w:sectPr>"}},"section_chain":[]}}}}'


def hf_registry(spark, folder):
    """Headers, then footers of every file's registry, alias keys merged, rows that are none left out."""
    return _hf_entries(spark, folder).select("file_key", "kind", F.col("pos").cast("bigint").alias("pos"), "part_name", "xml", "rid")


def _hf_entries(spark, folder):
    rows = entries(spark, folder)
    head = F.col("hf_kind") == "header"
    alias = F.when(head, F.struct(F.col("part").alias("part_name"), F.col("xml").alias("xml"), F.lit(None).cast("string").alias("part_xml"), F.col("rid").alias("rid"), F.lit(None).cast("string").alias("rel_id"), F.array(F.struct(F.concat(F.lit("word/media/"), F.col("entry_id").cast("string"), F.lit(".png")).alias("path"), F.base64(F.encode("xml", "UTF-8")).alias("data"))).alias("media")))
    alias = alias.otherwise(F.struct(F.col("part").alias("part_name"), F.lit("").alias("xml"), F.col("xml").alias("part_xml"), F.lit(None).cast("string").alias("rid"), F.col("rid").alias("rel_id"), F.array(F.struct(F.lit(" ").alias("path"), F.lit("eA==").alias("data"))).alias("media")))
    held = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("hf_kind") == kind, F.struct("entry_id", alias.alias("e"))))), lambda x: x["e"])
    made = rows.groupBy("file_key").agg(F.to_json(F.struct(F.struct(held("header").alias("headers"), held("footer").alias("footers")).alias("headers_footers"))).alias("json"))
    parsed = made.select("file_key", registry.parsed(F.col("json"), registry.TEMPLATE_SCHEMA).alias("j")).select("file_key", "j.*")
    return registry.header_footer_entries(parsed, ["file_key"])


def media_decode(spark, folder):
    """Media of the headers decoded; items without a name are left out."""
    return registry.media_items(_hf_entries(spark, folder), ["file_key"]).select("file_key", "part_name", "filename", F.col("item").cast("bigint").alias("item"), F.decode("content", "UTF-8").alias("content"))


# ---- documents ----


def bundle_analysis(spark, folder):
    """Every file's document through the whole analysis, tables included."""
    got = doc_paragraphs.analyse(documents(spark, folder)).enriched
    return got.select("file_key", F.col("paragraph_index").cast("bigint").alias("idx"), "text", "prev_text", "next_text", "in_table", "marker_type", F.col("num_pr.numId").alias("num_id"), F.col("num_pr.ilvl").alias("level"), F.col("ppr_hints.jc").alias("jc"), "csi_role")


def bundle_report(spark, folder):
    """What the analysis removed or stripped, with its tags."""
    got = doc_paragraphs.analyse(documents(spark, folder)).filter_report
    return got.select("file_key", F.col("paragraph_index").cast("bigint").alias("idx"), "action", F.array_join("tags", ",").alias("tags"))


def table_ranges(spark, folder):
    """Tables of every document with their offsets."""
    rows = documents(spark, folder).select("file_key", F.length("xml").cast("bigint").alias("n"), F.posexplode(markup.block_spans(F.col("xml"), "w:tbl")).alias("idx", "s"))
    return rows.select("file_key", F.col("idx").cast("bigint").alias("idx"), F.col("s.start").cast("bigint").alias("start"), F.col("s.stop").cast("bigint").alias("stop"))


# ---- edits of markup ----


def restyle_paragraphs(spark, folder):
    """Every paragraph under another style, without run fonts, without direct layout, and all of it."""
    rows = bundle_rows(spark, folder).where("file_key is not null")
    old = F.when(F.col("marker_type").isNotNull(), '<w:pStyle w:val="Old"/>').otherwise("")
    block = F.concat(F.lit("<w:p><w:pPr>"), old, F.lit('<w:jc w:val="left"/><w:spacing w:after="'), F.col("idx").cast("string"), F.lit('"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="X"/><w:b/></w:rPr><w:t>'), markup.escape_attribute(F.coalesce("text", F.lit(""))), F.lit("</w:t></w:r></w:p>"))
    rows = rows.select("file_key", "idx", block.alias("block"), F.when(F.col("in_table"), "Cell").otherwise("Body").alias("style"))
    styled, fonts, direct, whole = edit.column(edit.with_style, 2), edit.column(edit.without_run_fonts), edit.column(edit.without_direct_layout), edit.column(lambda b, s: edit.restyle(b, s, True), 2)
    return rows.select("file_key", "idx", styled("block", "style").alias("styled"), fonts("block").alias("plain_runs"), direct("block").alias("plain_layout"), whole("block", "style").alias("restyled"))


def style_edits(spark, folder):
    """Style blocks with a number: whether they bring layout, renumbered, without style and number, and equal but for white space."""
    rows = current_styles(spark, folder)
    block = F.concat(F.lit("<w:style><w:pStyle w:val='x'/>"), F.coalesce("ppr", F.lit("")), F.coalesce(F.concat(F.lit('<w:numPr><w:numId w:val="'), F.col("ui_priority").cast("string"), F.lit('"/></w:numPr>')), F.lit("")), F.lit("</w:style>"))
    rows = rows.select("template_key", "style_id", "ui_priority", F.regexp_replace(block, "'x'", '"x"').alias("block"))
    bare = edit.column(lambda b: edit.without(b, "w:pStyle", "w:numPr"))
    spaced = F.regexp_replace("block", "><", ">\n  <")
    return rows.select("template_key", "style_id", styles.brings_layout(F.col("block")).alias("layout"), styles.renumbered(F.col("block"), F.col("ui_priority"), F.col("ui_priority") + 1000).alias("renumbered"), bare("block").alias("bare"), styles.same_form(F.regexp_replace("block", "><", "> <"), spaced).alias("same"))


def style_maps(spark, folder):
    """Sheets of all rows of a style: the block that counts as its definition, the one that counts in a map, and its number."""
    rows = table(spark, folder, "style_defs").where("template_key is not null and trim(style_id) <> '' and revision is not null").select("template_key", F.trim("style_id").alias("style_id"), "revision", F.coalesce("ui_priority", F.lit(-1)).alias("p")).distinct()
    number = F.when(F.col("p") >= 0, F.concat(F.lit('<w:numPr><w:numId w:val="'), F.col("p").cast("string"), F.lit('"/></w:numPr>'))).otherwise("")
    block = F.concat(F.lit('<w:style w:styleId="'), markup.escape_attribute(F.col("style_id")), F.lit('"><w:rev w:val="'), F.col("revision").cast("string"), F.lit('"/>'), number, F.lit("</w:style>"))
    ordered = F.array_sort(F.collect_list(F.struct("style_id", "revision", "p", block.alias("b"))))
    made = rows.groupBy("template_key").agg(F.concat(F.lit("<w:styles>"), F.array_join(F.transform(ordered, lambda x: x["b"]), ""), F.lit("</w:styles>")).alias("xml"))
    blocks = styles.style_blocks(made, ["template_key"])
    ends = styles.first_and_last(blocks, ["template_key"])
    revision = lambda c: markup.attribute(F.col(c), "w:rev").cast("bigint")
    ends = ends.select("template_key", "style_id", revision("first_xml").alias("first_revision"), revision("last_xml").alias("last_revision"))
    return ends.join(numbering.style_numbers(blocks, ["template_key"]).select("template_key", "style_id", F.col("num_id").cast("bigint").alias("num_id")), ["template_key", "style_id"], "left")


def style_extract(spark, folder):
    """References and kind of each style read back from the sheets."""
    blocks = styles.style_blocks(sheets(spark, folder), ["template_key"])
    value = lambda tag: markup.attribute(F.col("xml"), tag)
    return blocks.select("template_key", "style_id", markup.attribute(F.col("xml"), "w:style", "w:type").alias("type"), value("w:basedOn").alias("based_on"), value("w:next").alias("next"), value("w:link").alias("link"))


def _joined(spark, folder, content):
    """One text per file from its entries in the order of their ids."""
    return splice(entries(spark, folder).select("file_key", "entry_id", content.alias("xml")), ["file_key"], "entry_id", "xml")


def run_blocks(spark, folder):
    """Run properties of a file without fonts and sizes, with their counts."""
    content = F.concat(F.lit('<w:p><w:r><w:rPr>\n<w:rFonts w:ascii="'), "hf_kind", F.lit('"/> <w:b w:val="'), F.coalesce("rid", F.lit("")), F.lit('"/>\n</w:rPr></w:r></w:p>'))
    rows = markup.explode_blocks(_joined(spark, folder, content), "xml", "w:rPr").select("file_key", markup.run_form(F.col("block")).alias("form"))
    return rows.groupBy("file_key", "form").agg(F.count(F.lit(1)).alias("n"))


def section_blocks(spark, folder):
    """Sections of a file: names of their children, what is left without managed properties, and the margins."""
    content = F.concat(
        F.lit('<w:p/><w:sectPr w:rsidR="'), F.col("entry_id").cast("string"), F.lit('"> <w:headerReference r:id="'), F.coalesce("rid", F.lit("")), F.lit('"/> <w:pgSz w:w="1"/> <w:pgMar w:top="'),
        F.length("xml").cast("string"), F.lit('" w:left="3"/> <w:custom w:val="'), "hf_kind", F.lit('"/> </w:sectPr>'),
    )
    rows = markup.explode_blocks(_joined(spark, folder, content), "xml", "w:sectPr")
    names = edit.column(lambda b: ",".join(n for n, _ in edit.children(b[b.index(">") + 1 :])))
    margins = markup.margins(F.col("block"))
    return rows.select("file_key", F.col("idx").cast("bigint").alias("idx"), names("block").alias("children"), markup.section_form(F.col("block")).alias("form"), margins["top"].alias("top"), margins["left"].alias("left"), margins["right"].alias("right"))


def hf_relationships(spark, folder):
    """The relationships of a file that lead to headers and footers."""
    line = F.concat(F.lit('<Relationship Id="'), F.coalesce("rid", F.lit("")), F.lit('" Type="http://x/relationships/'), "hf_kind", F.lit('" Target="'), "part", F.lit('"/><Relationship Id="s" Type="http://x/relationships/styles" Target="/header"/>'))
    return _joined(spark, folder, line).select("file_key", F.explode(markup.header_footer_relationships(F.col("xml"))).alias("relationship")).distinct()


# ---- numbering, footers, layout ----


def _numbering(spark, folder):
    """Numbers and abstract definitions of templates, their use by the styles of packages, and the packages' own parts."""
    now = current_styles(spark, folder).where("ui_priority is not null")
    nums = now.select("template_key", F.col("ui_priority").alias("num_id")).distinct().where("num_id <> 97")
    nums = nums.withColumn("abstract_id", F.when(F.col("num_id") == 96, 100).otherwise(F.col("num_id") % 7).cast("int"))
    text_of = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    nums = nums.withColumn("xml", text_of('<w:num w:numId="', F.col("num_id"), '" w16cid:durableId="', F.col("num_id"), '"><w:abstractNumId w:val="', F.col("abstract_id"), '"/></w:num>'))
    abstracts = nums.where("abstract_id < 100").select("template_key", "abstract_id").distinct()
    abstracts = abstracts.withColumn("xml", text_of('<w:abstractNum w:abstractNumId="', F.col("abstract_id"), '"><w:nsid w:val="0000000', F.col("abstract_id"), '"/></w:abstractNum>'))
    packages = table(spark, folder, "packages").where("file_key is not null").select("file_key", "template_key", "size_bytes")
    usage = packages.join(now.where("semi_hidden and qformat").select("template_key", "style_id", F.col("ui_priority").alias("num_id")), "template_key").select("file_key", "template_key", "style_id", "num_id")
    k = F.col("size_bytes") % 50
    targets = packages.where("size_bytes is not null").select("file_key", text_of('<w:numbering><w:abstractNum w:abstractNumId="', k, '"><w:nsid w:val="AAAAAAAA"/></w:abstractNum><w:num w:numId="', k, '"><w:abstractNumId w:val="', k, '"/></w:num></w:numbering>').alias("xml"))
    # The definitions travel as registries do: arrays in the JSON of each template.
    held = lambda rows, **names: rows.groupBy("template_key").agg(F.collect_list(F.struct(*(F.col(c).alias(n) for n, c in names.items()))).alias("held"))
    made = held(nums, numId="num_id", abstractNumId="abstract_id", xml="xml").withColumnRenamed("held", "nums").join(held(abstracts, abstractNumId="abstract_id", xml="xml").withColumnRenamed("held", "abstract_nums"), "template_key", "left")
    made = made.select("template_key", registry.parsed(F.to_json(F.struct(F.struct("nums", "abstract_nums").alias("numbering"))), registry.TEMPLATE_SCHEMA).alias("j")).select("template_key", "j.*")
    return usage, *registry.numbering_rows(made, ["template_key"]), targets


def numbering_registry(spark, folder):
    """Numbers of every template's registry with their abstract definition, null where it is missing."""
    _, nums, abstracts, _ = _numbering(spark, folder)
    rows = nums.join(abstracts.select("template_key", "abstract_id", F.col("xml").alias("abstract_xml")), ["template_key", "abstract_id"], "left")
    return rows.select("template_key", "num_id", "abstract_id", "xml", "abstract_xml")


def numbering_plan(spark, folder):
    """New numbers of the styles of each package, and what is wrong with the others."""
    made = numbering.plan(*_numbering(spark, folder))
    wrong = made.violations.select("file_key", F.col("rule").alias("kind"), F.array_join("styles", ",").alias("item"), F.col("item").cast("bigint").alias("old_id"), F.lit(None).cast("bigint").alias("new_id"))
    return made.styles.select("file_key", F.lit("style").alias("kind"), F.col("style_id").alias("item"), F.col("old_id").cast("bigint").alias("old_id"), F.col("new_id").cast("bigint").alias("new_id")).unionByName(wrong)


def numbering_inject(spark, folder):
    """Numbering parts of the packages with the new definitions."""
    usage, nums, abstracts, targets = _numbering(spark, folder)
    return numbering.inject(targets, numbering.plan(usage, nums, abstracts, targets)).select("file_key", "xml", "error")


def _footers(spark, folder):
    rows = entry_parts(spark, folder).where(F.col("xml").startswith("<w:ftr>"))
    split = F.regexp_replace("xml", "<w:t>(.{7})", "<w:t>$1</w:t></w:r><w:r><w:t>")
    return rows.select("file_key", F.col("part").alias("part_name"), split.alias("xml"))


def _tokens(spark, folder):
    """Number and title of a file's first footer as the template's, others in their place."""
    seen = footers.text_nodes(_footers(spark, folder)).groupBy("file_key", "part_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "seen"))), lambda x: x["seen"]), "").alias("t"))
    first = seen.groupBy("file_key").agg(F.min("t").alias("t"))
    return first.select("file_key", F.regexp_extract("t", "^[0-9 ]+ - (.*)$", 1).alias("title"), F.lit("Air handling-UNITS").alias("new_title"), F.regexp_extract("t", "^([0-9 ]+) - ", 1).alias("number"), F.lit("99 88 77").alias("new_number"))


def footer_tokens(spark, folder):
    """Footers with their tokens replaced, though each stands in two text nodes."""
    done = footers.patch_tokens(_footers(spark, folder), _tokens(spark, folder))
    return footers.text_nodes(done).groupBy("file_key", "part_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "seen"))), lambda x: x["seen"]), "").alias("seen"), F.count(F.lit(1)).alias("n_nodes"))


def apply_case_pattern(spark, folder):
    """The style names of a template in the case of each style id."""
    rows = current_styles(spark, folder)
    return rows.select("template_key", "style_id", text.apply_case(F.coalesce("style_name", F.lit("")), text.case_pattern(F.upper("style_id"))).alias("upper"), text.apply_case(F.coalesce("style_name", F.lit("")), F.lit("mixed")).alias("mixed"))


def _sections(spark, folder):
    """Sections of files, chains of sections and defaults of templates; templates of some libraries have no default."""
    rows = entries(spark, folder).join(table(spark, folder, "packages").select("file_key", "template_key", "library_code"), "file_key")
    rows = relational.numbered(rows, ["file_key"], [F.col("entry_id")])
    xml = F.concat(F.lit('<w:sectPr w:rsidR="'), F.col("entry_id").cast("string"), F.lit('"><w:headerReference w:type="default" r:id="'), F.coalesce("rid", F.lit("")), F.lit('"/><w:pgSz w:w="'), F.length("xml").cast("string"), F.lit('"/><w:titlePg/></w:sectPr>'))
    targets = rows.select("file_key", "template_key", "pos", xml.alias("xml"))
    chain = relational.numbered(current_styles(spark, folder).where("semi_hidden and qformat and ui_priority < 40").drop("pos"), ["template_key"], [F.col("style_id")])
    chain = chain.select("template_key", "pos", F.concat(F.lit('<w:sectPr><w:pgSz w:w="'), F.col("ui_priority").cast("string"), F.lit('"/><w:pgMar w:top="'), F.length("style_id").cast("string"), F.lit('"/></w:sectPr>')).alias("source"))
    defaults = table(spark, folder, "templates").where("library_code > 'LB-10'").select("template_key", F.lit('<w:sectPr><w:pgSz w:w="d"/></w:sectPr>').alias("source"))
    return targets, chain, defaults


def page_layout(spark, folder):
    """Sections of each file with the managed properties of the template section of their position."""
    targets, chain, defaults = _sections(spark, folder)
    return layout.merged_sections(targets, layout.section_sources(targets, chain, defaults))


def layout_violations(spark, folder):
    """Files whose number of sections their template cannot serve."""
    return layout.section_violations(*_sections(spark, folder))


def fonts_missing(spark, folder):
    """Fonts that the template of a package has and the package does not."""
    template, target = _font_tables(spark, folder)
    return environment.missing_fonts(environment.font_rows(template, ["file_key"]), environment.font_rows(target, ["file_key"]), ["file_key"]).select("file_key", "name")


def _font_tables(spark, folder):
    stems = current_styles(spark, folder).select("template_key", F.regexp_replace("style_id", "[0-9]+.*$", "").alias("stem")).distinct()
    font = F.concat(F.lit('<w:font w:name="'), "stem", F.lit('"></w:font>'))
    made = stems.groupBy("template_key").agg(F.concat(F.lit("<w:fonts>"), F.array_join(F.array_sort(F.collect_list(font)), ""), F.lit("</w:fonts>")).alias("xml"))
    packages = table(spark, folder, "packages").select("file_key", "template_key", "library_code")
    target = packages.select("file_key", F.concat(F.lit('<w:fonts><w:font w:name="Body"></w:font><w:font w:name="'), "library_code", F.lit('"></w:font></w:fonts>')).alias("xml"))
    return packages.join(made, "template_key").select("file_key", "xml"), target


# ---- environment steps on packages ----


def _packages(spark, folder):
    """Every package with the greatest number of its relationship ids and whether it already has the optional parts."""
    most = entries(spark, folder).select("file_key", F.expr("try_cast(regexp_extract(rid, '^rId([0-9]+)$', 1) as int)").alias("n")).groupBy("file_key").agg(F.max("n").alias("n"))
    rows = table(spark, folder, "packages").where("file_key is not null").join(most, "file_key", "left")
    return rows.select("file_key", "template_key", "library_code", F.coalesce("n", F.lit(1)).alias("n"), (F.col("library_code") < "LB-20").alias("full"))


def _part_map(**parts):
    names = {"types": "[Content_Types].xml", "rels": "word/_rels/document.xml.rels", "document": "word/document.xml", "theme": "word/theme/theme1.xml", "settings": "word/settings.xml", "fonts": "word/fontTable.xml", "styles": "word/styles.xml", "header": "word/header99.xml"}
    return F.create_map(*(x for k, v in parts.items() for x in (F.lit(names[k]), v)))


def _rels():
    return F.concat(F.lit('<Relationships><Relationship Id="rId'), F.col("n").cast("string"), F.lit('" Type="t/styles" Target="x.xml"/></Relationships>'))


def _json(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def theme_step(spark, folder):
    """Themes added with their wiring, or replaced."""
    theme = F.concat(F.lit('<a:theme n="'), "library_code", F.lit('"/>'))
    rows = _packages(spark, folder).select("file_key", _part_map(types=F.lit("<Types></Types>"), rels=_rels(), theme=F.when(F.col("full"), F.lit("<old/>"))).alias("parts"), _json(theme=F.struct(theme.alias("theme1_xml"))).alias("template"))
    got = environment.step_rows(rows, "theme")
    return got.select("file_key", F.col("parts")["word/theme/theme1.xml"].alias("theme"), F.col("parts")["[Content_Types].xml"].alias("types"), F.col("parts")["word/_rels/document.xml.rels"].alias("rels"), F.array_join("log", "|").alias("log"))


def settings_step(spark, folder):
    """Settings: raw ones replace those of the package but for its document id, flags are replaced or inserted, malformed ones change nothing."""
    have = F.concat(F.lit('<w:settings><w:docId w:val="'), "file_key", F.lit('"/><w:compat><w:old/></w:compat></w:settings>'))
    flags = F.when(F.col("library_code") == "LB-05", F.lit("<w:compat>")).otherwise(F.concat(F.lit('<w:compat><w:c w:v="'), "library_code", F.lit('"/></w:compat>')))
    raw = F.when(F.col("library_code").isin("LB-12", "LB-30"), F.lit('<w:settings><w:docId w:val="T"/><w:raw/></w:settings>'))
    rows = _packages(spark, folder).select("file_key", _part_map(types=F.lit("<Types></Types>"), rels=_rels(), settings=F.when(F.col("full"), have)).alias("parts"), _json(settings=F.struct(F.struct(flags.alias("compat_xml")).alias("compat"))).alias("template"), raw.alias("raw"))
    got = environment.step_rows(rows, "settings")
    return got.select("file_key", F.col("parts")["word/settings.xml"].alias("settings"), F.array_join("log", "|").alias("log"))


def fonts_step(spark, folder):
    """Font tables with the fonts of the template added."""
    template, target = _font_tables(spark, folder)
    rows = template.withColumnRenamed("xml", "t").join(target, "file_key").select("file_key", _part_map(fonts=F.col("xml")).alias("parts"), _json(fonts=F.struct(F.col("t").alias("font_table_xml"))).alias("template"))
    return environment.step_rows(rows, "fonts").select("file_key", F.col("parts")["word/fontTable.xml"].alias("fonts"), F.array_join("log", "|").alias("log"))


def defaults_step(spark, folder):
    """Document defaults replaced, inserted, or left where the sheet has no root."""
    sheet = F.when(F.col("full"), F.lit("<w:styles><w:docDefaults><w:x/></w:docDefaults><w:s/></w:styles>")).when(F.col("library_code") == "LB-33", F.lit("<other/>")).otherwise(F.lit("<w:styles a='b'><w:s/></w:styles>"))
    run = F.concat(F.lit('<w:rPr><w:sz w:val="'), F.col("n").cast("string"), F.lit('"/></w:rPr>'))
    rows = _packages(spark, folder).select("file_key", _part_map(styles=sheet).alias("parts"), _json(doc_defaults=F.struct(F.struct(run.alias("rPr")).alias("default_run_props"))).alias("template"))
    return environment.step_rows(rows, "defaults").select("file_key", F.col("parts")["word/styles.xml"].alias("styles"), F.array_join("log", "|").alias("log"))


def _hf_packages(spark, folder):
    """Packages with one old header, and templates with the entries of the same file as headers and footers, one per part."""
    rows = entries(spark, folder).where("part rlike '^word/(header|footer)[0-9]+\\\\.xml$' and rid is not null and rid <> ''")
    one = rows.groupBy("file_key", "part").agg(F.min_by(F.struct("entry_id", "hf_kind", "rid", "xml"), "entry_id").alias("e")).select("file_key", "part", "e.*")
    name = F.concat(F.col("entry_id").cast("string"), F.lit(".png"))
    item = lambda path, content: F.struct(path.alias("path"), F.base64(F.encode(content, "UTF-8")).alias("content_base64"))
    media = F.array(item(F.concat(F.lit("word/media/"), name), F.col("xml")), item(F.lit("logo.JPEG"), F.col("part")))
    rels = F.concat(F.lit('<R Target="./media/'), name, F.lit('"/>'))
    entry = F.struct("entry_id", F.struct(F.col("part").alias("part_name"), "xml", F.col("rid").alias("rId"), rels.alias("rels_xml"), media.alias("media")).alias("e"))
    held = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("hf_kind") == kind, entry))), lambda x: x["e"]).alias(f"{kind}s")
    ref = lambda kind: F.create_map(F.lit("default"), F.coalesce(F.min_by(F.when(F.col("hf_kind") == kind, F.col("rid")), F.when(F.col("hf_kind") == kind, F.col("entry_id"))), F.lit("none"))).alias(f"{kind}_refs")
    made = one.groupBy("file_key").agg(F.struct(held("header"), held("footer")).alias("headers_footers"), F.struct(F.lit("<w:sectPr><w:titlePg/></w:sectPr>").alias("sectPr"), ref("header"), ref("footer")).alias("default_section"))
    n = F.col("n").cast("string")
    rels = F.concat(F.lit('<Relationships><Relationship Id="rId'), n, F.lit('" Type="t/styles" Target="x.xml"/><Relationship Id="rId'), (F.col("n") + 1).cast("string"), F.lit('" Type="t/header" Target="header99.xml"/></Relationships>'))
    document = F.concat(F.lit('<w:body><w:sectPr><w:headerReference w:type="default" r:id="rId'), (F.col("n") + 1).cast("string"), F.lit('"/><w:pgSz w:w="1"/></w:sectPr></w:body>'))
    types = F.lit('<Types><Override PartName="/word/header99.xml" ContentType="h"/></Types>')
    packages = _packages(spark, folder).join(made, "file_key")
    return packages.select("file_key", _part_map(types=types, rels=rels, document=document, header=F.lit("<w:hdr/>")).alias("parts"), _json(headers_footers=F.col("headers_footers"), page_layout=F.struct("default_section")).alias("template"))


def headers_step(spark, folder):
    """Headers and footers imported: parts and media, relationships, references of the section, content types."""
    got = environment.step_rows(_hf_packages(spark, folder), "headers")
    return got.select("file_key", F.array_join(F.array_sort(F.map_keys("parts")), ",").alias("names"), F.col("parts")["word/_rels/document.xml.rels"].alias("rels"), F.col("parts")["word/document.xml"].alias("document"), F.col("error"))


def environment_run(spark, folder):
    """All steps in their order, by their log."""
    got = environment.step_rows(_hf_packages(spark, folder), "all")
    return got.select("file_key", F.array_join("log", "|").alias("log"))


# ---- styles ----


def style_import(spark, folder):
    """Styles of the roles of each file imported with all they need: what was done, what a second run does, and the size each got."""
    roles = registry.usable_roles(_style_contracts(spark, folder), ["template_key"]).withColumnRenamed("role", "csi_role")
    wanted = deterministic(spark, folder).select("file_key", "template_key", "csi_role").distinct().join(roles, ["template_key", "csi_role"]).groupBy("file_key", "template_key").agg(F.array_sort(F.collect_set("style_id")).alias("wanted"))
    old = current_styles(spark, folder).where("qformat").select("template_key", F.concat(F.lit('<w:style w:type="paragraph" w:styleId="'), markup.escape_attribute(F.col("style_id")), F.lit('"><w:name w:val="old"/></w:style>')).alias("b"))
    target = old.groupBy("template_key").agg(F.concat(F.lit("<w:styles>"), F.array_join(F.array_sort(F.collect_list("b")), ""), F.lit("</w:styles>")).alias("target"))
    rows = wanted.join(sheets(spark, folder).withColumnRenamed("xml", "template"), "template_key").join(target, "template_key", "left").withColumn("target", F.coalesce("target", F.lit("<w:styles></w:styles>")))
    rows = cut(spread(rows, "file_key"))
    once = cut(styles.import_rows(rows))
    twice = styles.import_rows(once.where("error is null").select("file_key", F.col("xml").alias("target")).join(rows.select("file_key", "template", "wanted"), "file_key"))
    size = styles.first_and_last(styles.style_blocks(once.where("error is null").select("file_key", "xml"), ["file_key"]), ["file_key"]).select("file_key", "style_id", markup.attribute(F.col("first_xml"), "w:sz").alias("size"))
    acts = lambda df, name: df.where("error is null").select("file_key", F.explode("done").alias("style_id", name))
    good = acts(once, "action").join(acts(twice, "again"), ["file_key", "style_id"]).join(size, ["file_key", "style_id"], "left")
    failed = once.where("error is not null").select("file_key", F.lit(None).cast("string").alias("style_id"), F.lit("error").alias("action"), F.lit(None).cast("string").alias("again"), F.lit(None).cast("string").alias("size"))
    return good.unionByName(failed)


# ---- checks and runs ----


def stability_check(spark, folder):
    """Headers and footers that differ after headers were rewritten and footers left out."""
    before = part_rows(spark, folder)
    after = before.where(~F.col("part_name").rlike(r"^word/footer[0-9]+\.xml$")).withColumn("content", F.when(F.col("part_name").rlike(r"^word/header1[0-9]*\.xml$"), F.encode(F.lit("<new/>"), "UTF-8")).otherwise(F.col("content")))
    return pipeline.stability_changes(before, after).select("file_key", "part_name", "change")


def output_checks(spark, folder):
    """Violations of an output in which entries about installation lost their run, one library its sections and all but headers their relationship."""
    def build(lossy):
        run = F.concat(F.lit('<w:p><w:r><w:rPr><w:b w:val="'), F.col("entry_id").cast("string"), F.lit('"/></w:rPr></w:r></w:p>'))
        if lossy:
            run = F.when(F.col("xml").contains("INSTALLATION"), "<w:p></w:p>").otherwise(run)
        return F.concat(run, F.lit('<w:headerReference w:type="x" r:id="'), F.coalesce("rid", F.lit("")), F.lit('"/>'))

    library = table(spark, folder, "packages").select("file_key", "library_code")
    mark = F.when(F.col("library_code") < "LB-05", "y").otherwise("x")
    before = _joined(spark, folder, build(False)).join(library, "file_key").select("file_key", F.concat("xml", F.lit('<w:sectPr><w:custom w:val="x"/></w:sectPr>')).alias("xml"))
    after = _joined(spark, folder, build(True)).join(library, "file_key").select("file_key", F.concat("xml", F.lit('<w:sectPr><w:custom w:val="'), mark, F.lit('"/></w:sectPr>')).alias("xml"))
    heads = F.concat(F.lit('<Relationship Id="'), F.when(F.col("hf_kind") == "header", F.coalesce("rid", F.lit(""))).otherwise("none"), F.lit('" Type="t"/>'))
    rels = _joined(spark, folder, heads).select("file_key", F.lit(environment.RELS_PART).alias("part_name"), F.encode("xml", "UTF-8").alias("content"))
    parts = rels.unionByName(part_rows(spark, folder).select("file_key", "part_name", "content"))
    return pipeline.output_violations(before, after, parts, ["word/header1.xml", "word/footer1.xml"])


def contract_run(spark, folder):
    """Paragraphs that an edit changed by more than it may, per file."""
    before = documents(spark, folder)
    styled = F.regexp_replace("xml", "<w:p><w:r>", '<w:p><w:pPr><w:pStyle w:val="S"/></w:pPr><w:r>')
    after = before.select("file_key", F.regexp_replace(styled, "steel", "iron").alias("xml"))
    parts = lambda d: d.select("file_key", F.lit(pipeline.DOCUMENT).alias("part_name"), F.encode("xml", "UTF-8").alias("content"))
    rows = pipeline.contract_violations(parts(before), parts(after))
    return rows.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").contains("+")).alias("n_shown"))


def _asked(spark, folder):
    rows = unresolved_filter(spark, folder).join(bundle_rows(spark, folder).select("file_key", "idx", "text"), ["file_key", "idx"]).where("file_key is not null")
    return batches.chunked(rows.select("file_key", F.col("idx").cast("int").alias("paragraph_index"), F.substring("text", 1, 40).alias("text")), 0, 3000, 40)


def reassembly(spark, folder):
    """Answers put together again: files of one library fail by an expired request, of another by a missing row; the others keep their notes."""
    chunks = _asked(spark, folder)
    library = table(spark, folder, "slim_bundle").groupBy("file_key").agg(F.min("library_code").alias("library"))
    rows = chunks.join(library, "file_key").withColumn("top", F.expr("max(paragraph_index) over (partition by file_key, chunk)"))
    item = F.when((F.col("library") == "LB-04") & (F.col("chunk") == 0) & (F.col("paragraph_index") == F.col("top")), None).otherwise(F.struct("paragraph_index", F.lit("PARAGRAPH").alias("csi_role")))
    answers = rows.groupBy("file_key", "chunk", "library").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("classifications"), F.array(F.concat(F.lit("n"), F.col("chunk").cast("string"))).alias("notes"))).alias("text"))
    responses = answers.select(F.concat_ws("__chunk", "file_key", F.col("chunk").cast("string")).alias("custom_id"), F.when(F.col("library") == "LB-03", "expired").otherwise("succeeded").alias("status"), "text")
    final, failed = batches.reassemble(chunks, responses, text.ROLES)
    notes = batches.notes(responses)
    good = final.groupBy("file_key").agg(F.count(F.lit(1)).alias("n")).join(notes, "file_key").select("file_key", "n", F.array_join("notes", ",").alias("notes"), F.lit(None).cast("string").alias("reason"))
    bad = failed.select("file_key", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("notes"), F.when(F.col("reason").startswith("request"), "request").otherwise("coverage").alias("reason"))
    return good.unionByName(bad)


class Reader:
    """A classifier that reads the texts around a row: what follows a part heading is an article, what precedes one a paragraph."""

    def classify_rows(self, records, roles):
        return ["ARTICLE" if (r["prev_text"] or "").startswith("PART ") else "PARAGRAPH" if (r["next_text"] or "").startswith("PART ") else "SUBPARAGRAPH" for r in records]


def context_classify(spark, folder):
    """Rows classified chunk by chunk with the texts before and after them, the chunks merged."""
    rows = bundle_rows(spark, folder).where("file_key is not null").select("file_key", F.col("idx").cast("int").alias("paragraph_index"), F.substring("text", 1, 40).alias("text"))
    chunks = batches.chunked(with_context(rows, ["file_key"], "paragraph_index"), 0, 6000, 60)
    return classify.merge_chunks(classify.classify_chunks(chunks, text.ROLES, Reader()), ["file_key", "paragraph_index"])


class Recorder:
    """A transport that answers every request at the second look."""

    def submit(self, requests):
        self.requests, self.looks = requests, 0
        return "batch"

    def status(self, batch):
        self.looks += 1
        return self.looks == 2, {"done": self.looks}

    def results(self, batch):
        return [{"custom_id": r["custom_id"], "status": "succeeded", "text": str(len(r["message"]) > 0)} for r in self.requests]


def submitted(spark, folder):
    """One request per chunk of a library's summary, submitted and polled."""
    rows = table(spark, folder, "style_libraries").select(F.col("library_code").alias("file_key"), F.lit(0).alias("paragraph_index"), F.col("title").alias("text"))
    requests = batches.build_requests(batches.chunked(rows), "Name the kind.", text.ROLES)
    return batches.submit_and_poll(requests, Recorder(), wait=lambda seconds: None)


def request_cap(spark, folder):
    """Whether a number of requests is refused under several caps."""
    chunks = _asked(spark, folder).select("file_key", "chunk", "paragraph_index")
    rows = []
    for cap in (1, 100, 10**9):
        try:
            batches.build_requests(chunks, "x", text.ROLES, cap)
            rows.append((cap, False))
        except ValueError:
            rows.append((cap, True))
    return spark.createDataFrame(rows, "cap long, refused boolean")


def prompt_text(spark, folder):
    """A prompt written and read as text in front of the roles."""
    where = scratch(spark)
    _write_text(where, "prompt.txt", "Read each row.\nName its role.\n")
    prompt = batches.read_prompt(spark, f"{where}/prompt.txt")
    return table(spark, folder, "style_libraries").select("library_code", batches.request_text(prompt, ["PART"], F.col("title")).alias("message"))


def package_run(spark, folder):
    """The whole pipeline on a package per file: packages written, scanned, analysed, classified, restyled, checked and written."""
    source, contracts, out = scratch(spark), scratch(spark), scratch(spark)
    roles = ",".join(f'"{r}":{{"style_id":"{s}"}}' for r, s in ROLE_STYLES)
    _write_text(contracts, registry.STYLE_FILE, f'{{"version":1,"roles":{{{roles}}}}}')
    _write_text(contracts, registry.TEMPLATE_FILE, _template_json(spark, folder))
    docs = documents(spark, folder).select("file_key", F.regexp_replace(F.regexp_replace("xml", "^<w:document>", '<w:document xmlns:w="w">'), "</w:body></w:document>$", '<w:sectPr><w:pgSz w:w="1"/></w:sectPr></w:body></w:document>').alias("xml"))
    parts = {"[Content_Types].xml": F.lit("<Types/>"), "word/document.xml": F.col("xml"), "word/styles.xml": F.lit('<w:styles xmlns:w="w"></w:styles>'), "word/_rels/document.xml.rels": F.lit("<Relationships/>")}
    # Packages of one library lack their style sheet and fail alone.
    lacking = table(spark, folder, "slim_bundle").groupBy("file_key").agg((F.min("library_code") == "LB-07").alias("lacking"))
    rows = docs.join(lacking, "file_key").select("file_key", "lacking", F.inline(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("part_name"), F.lit(8).alias("compress_type"), F.encode(c, "UTF-8").alias("content")) for i, (n, c) in enumerate(parts.items()))))).where("not (lacking and part_name = 'word/styles.xml')")
    docx.write_packages(rows, source).count()
    stages = {}
    done = pipeline.run_batch(spark, source, contracts, out, progress=stages.__setitem__)
    told = F.lit(",".join(f"{stage}:{counts.get('packages', '')}" for stage, counts in stages.items()))
    return done.select(F.regexp_extract("file_key", "^(.*)__[0-9a-f]{12}$", 1).alias("file_key"), "success", F.col("requested").cast("bigint").alias("requested"), F.col("modified").cast("bigint").alias("modified"), F.col("path").isNotNull().alias("written"), (F.col("duration_seconds") > 0).alias("timed"), F.col("error"), told.alias("stages"))


QUERIES = {
    f.__name__: f
    for f in (
        package_scan, single_part, output_assembly, allowed_parts, wellformed_parts, prefix_check, role_preflight, answer_blocks, registry_roles, registry_available, template_registry, registry_violations, style_sheets, contract_config,
        hf_registry, media_decode, bundle_analysis, bundle_report, table_ranges, restyle_paragraphs, style_edits, style_maps, style_extract, run_blocks, section_blocks, hf_relationships, numbering_registry, numbering_plan, numbering_inject, footer_tokens,
        apply_case_pattern, page_layout, layout_violations, fonts_missing, theme_step, settings_step, fonts_step, defaults_step, headers_step, environment_run, style_import, stability_check, output_checks, contract_run, reassembly,
        context_classify, submitted, request_cap, prompt_text, package_run,
    )
}

_BLOCK = f"'<w:p>' || case when trim(marker_type) = 'list_numpr' then '<w:pPr><w:numPr><w:ilvl w:val=\"0\"/><w:numId w:val=\"1\"/></w:numPr></w:pPr>' else '' end || '<w:r><w:t>' || {esc(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} || '</w:t></w:r></w:p>'"
ORACLES = {
    "package_scan": f"with {PARTS} select file_key, ordinal, part as part_name, xml, true as readable from parts",
    "single_part": f"with {PARTS} select file_key, xml from parts where part = 'word/header1.xml'",
    "output_assembly": f"""with {PARTS}, out_ as (
  select file_key, part, ordinal, case when regexp_matches(part, '^word/header[0-9]+\\.xml$') then xml || '<!--new-->' else xml end as xml from parts where not regexp_matches(part, '^word/footer[0-9]+\\.xml$')
  union all select distinct file_key, 'word/styles.xml', 1000000, '<w:styles xmlns:w=''w''/>' from parts)
select file_key, row_number() over (partition by file_key order by ordinal) - 1 as ordinal, part as part_name, xml from out_""",
    "allowed_parts": f"""select distinct part_name, coalesce({_PART} in ('word/document.xml', 'word/styles.xml', 'word/theme/theme1.xml', 'word/numbering.xml', 'word/settings.xml', 'word/fontTable.xml', '[Content_Types].xml', 'word/_rels/document.xml.rels')
  or regexp_matches({_PART}, '^word/(_rels/)?(header|footer)[0-9]+\\.xml(\\.rels)?$') and contains({_PART}, '_rels') = ({_PART} like '%.rels') or {_PART} like 'word/media/%', null) as allowed from package_parts where part_name is not null""",
    "wellformed_parts": f"with {ENTRIES} select file_key || '#' || entry_id as file_key, part as part_name, true as named from entries where contains(xml, 'INSTALLATION') and part like '%.xml'",
    "prefix_check": f"with {ENTRIES} select file_key || '#' || entry_id as file_key, part as part_name, part || ': made-up prefix ns0' as error from entries where contains(xml, 'FABRICATION') and not contains(xml, 'INSTALLATION') and part like '%.xml'",
    "role_preflight": f"""with {_ROLES}, c as (select distinct file_key, template_key, c.paragraph_index as i, c.csi_role as role from (select file_key, template_key, unnest(deterministic_classifications) as c from slim_bundle)),
n as (select role, count(*) as n from c group by all) select n.role, n, stem as style_id, stem is not null as mapped from n left join r on r.role = n.role""",
    "answer_blocks": """select distinct file_key, received_at, len(paragraphs) as n, sha256(coalesce(array_to_string(list_transform(list_filter(paragraphs, lambda p: not coalesce(p.in_table, false)), lambda p: coalesce(p.text, '')), ''), '')) as digest from slim_bundle where file_key is not null""",
    "registry_roles": f"with {STYLES}, {_ROLES}, f as (select template_key, regexp_replace(style_id, '[0-9]+$', '') as stem, min(style_id) as style_id from styles group by all) select t.template_key, role, f.style_id from templates t, r join f on f.stem = r.stem where f.template_key = t.template_key",
    "registry_available": f"with {_ROLES} select template_key, (select string_agg(role, ',' order by role) from r) as roles from templates",
    "template_registry": f"with {STYLES} select template_key, pos, style_id, style_type as type, based_on, next, link, ui_priority, semi_hidden, qformat, ppr as pPr, rpr as rPr from styles",
    "registry_violations": f"""with {STYLES}, {_ROLES}, t as (select distinct template_key from styles), named as (select distinct template_key, csi_role as role, stem || '1' as style_id from (select template_key, unnest(deterministic_classifications).csi_role as csi_role from slim_bundle) join r on r.role = csi_role)
select template_key, 'no_default_section' as rule, 'page_layout.default_section.sectPr' as item from t
union all select template_key, 'role_style_unknown', role || ':' || style_id from named n where template_key in (select template_key from t) and not exists (select 1 from styles s where s.template_key = n.template_key and s.style_id = n.style_id)""",
    "style_sheets": f"with {STYLES}, m as (select template_key, pos, {STYLE_XML} as m from styles) select template_key, {_SHEET} as xml from m group by template_key",
    "contract_config": f"with {_ROLES} select role, stem as style_id, (select count(*) + 1 from r) as n_available, (select count(distinct stem) + 1 from r) as n_styles from r",
    "hf_registry": f"with {ENTRIES} select file_key, hf_kind as kind, row_number() over (partition by file_key, hf_kind order by entry_id) - 1 as pos, part as part_name, xml, rid from entries",
    "media_decode": f"with {ENTRIES} select file_key, part as part_name, entry_id || '.png' as filename, 1 as item, xml as content from entries where hf_kind = 'header'",
    "bundle_analysis": f"""with {ANALYSIS} select file_key, i as idx, t as text, coalesce(substr(before, 1, 80), '') as prev_text, coalesce(substr(after, 1, 80), '') as next_text, in_table, marker as marker_type,
  case when listed then '1' end as num_id, case when listed then '0' end as level, null::varchar as jc, role as csi_role from analysed""",
    "bundle_report": f"""with {ANALYSIS}, j as (select *, regexp_matches(full_text, '^\\s*(?i:END\\s+OF\\s+SECTION)') as ends from cleaned)
select file_key, i as idx, case when full_text = '' or ends then 'removed' else 'stripped' end as action, case when ends then 'end_of_section_no_role' else array_to_string(list_filter(tags, lambda x, n: list_position(tags, x) = n), ',') end as tags
from j where len(tags) > 0 or ends""",
    "table_ranges": f"""with {ROWS}, b as (select file_key, idx, in_table, length({_BLOCK}) + case when in_table then 15 else 0 end as n from rows_ where file_key is not null),
o as (select *, 20 + coalesce(sum(n) over (partition by file_key order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as start from b)
select file_key, row_number() over (partition by file_key order by idx) - 1 as idx, start, start + n as stop from o where in_table""",
}

_TEXT = esc("coalesce(text, '')")
_OLD = """case when marker_type is not null then '<w:pStyle w:val="Old"/>' else '' end"""
_DIRECT = """'<w:jc w:val="left"/><w:spacing w:after="' || idx || '"/>'"""
_END = f"'<w:b/></w:rPr><w:t>' || {_TEXT} || '</w:t></w:r></w:p>'"
_FONT = """'<w:rFonts w:ascii="X"/>'"""
_PSTYLE = """'<w:pStyle w:val="' || case when in_table then 'Cell' else 'Body' end || '"/>'"""
_STYLE_BLOCK = """'<w:style><w:pStyle w:val="x"/>' || coalesce(ppr, '') || coalesce('<w:numPr><w:numId w:val="' || ui_priority || '"/></w:numPr>', '') || '</w:style>'"""
_HASH = "upper(substr(sha1(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), 1, 8))"
_OPEN = f"{ROWS}, fixed as (select distinct file_key, c.paragraph_index::bigint as idx from (select file_key, unnest(deterministic_classifications) as c from slim_bundle)), open_ as (select r.file_key, r.idx, r.text from rows_ r where not in_table and not exists (select 1 from fixed f where f.file_key = r.file_key and f.idx = r.idx))"
_CHUNKED = f"""{_OPEN}, rec as (select file_key, idx, substr(text, 1, 40) as t from open_ where file_key is not null),
len_ as (select file_key, idx, length(case when t is null then '{{"paragraph_index":' || idx || '}}' else '{{"paragraph_index":' || idx || ',"text":' || to_json(t) || '}}' end) as n_chars from rec),
siz as (select file_key, sum(n_chars) as chars, count(*) as n from len_ group by all),
z as (select file_key, n, case when chars <= 3000 and n <= 40 then n else greatest(10, floor(3000 / greatest(chars / greatest(n, 1), 1.0)))::bigint end as size from siz),
c as (select l.file_key, idx, n, size, case when size >= n then greatest(size, 1) else size - 20 end as step, row_number() over (partition by l.file_key order by idx) as rn from len_ l join z using (file_key)),
k as (select file_key, idx, unnest(generate_series(greatest(0, ceil((rn - size) / step::double))::bigint, least(floor((rn - 1) / step::double), greatest(0, ceil((n - size) / step::double)))::bigint)) as chunk from c)"""
_NUMBERING = f"""{STYLES}, now_ as (select * from styles where ui_priority is not null),
nums as (select distinct template_key, ui_priority as num_id, case when ui_priority = 96 then 100 else ui_priority % 7 end as abstract_id from now_ where ui_priority <> 97),
abstracts as (select distinct template_key, abstract_id from nums where abstract_id < 100),
linked as (select distinct p.file_key, n.style_id, n.ui_priority as num_id, m.abstract_id, p.size_bytes % 50 as k, m.num_id is null as no_num, a.abstract_id is null as no_abstract
  from packages p join now_ n on n.template_key = p.template_key and n.semi_hidden and n.qformat left join nums m on m.template_key = p.template_key and m.num_id = n.ui_priority
  left join abstracts a on a.template_key = p.template_key and a.abstract_id = m.abstract_id where p.file_key is not null),
ruled as (select *, case when k is null then 'no_numbering_part' when no_num then 'unknown_num' when no_abstract then 'unknown_abstract' end as rule from linked),
wrong as (select file_key, rule, case when rule = 'unknown_abstract' then abstract_id else num_id end as item, string_agg(style_id, ',' order by style_id) as styles from ruled where rule is not null group by file_key, rule, case when rule = 'unknown_abstract' then abstract_id else num_id end),
sound as (select * from linked where file_key not in (select file_key from wrong)),
new_a as (select file_key, abstract_id, k, k + row_number() over (partition by file_key order by abstract_id) as new_id from (select distinct file_key, abstract_id, k from sound)),
new_n as (select file_key, num_id, abstract_id, k, k + row_number() over (partition by file_key order by num_id) as new_id from (select distinct file_key, num_id, abstract_id, k from sound))"""
_A_XML = """'<w:abstractNum w:abstractNumId="' || {a} || '"><w:nsid w:val="' || {h} || '"/></w:abstractNum>'"""
_N_XML = """'<w:num w:numId="' || {n} || '" w16cid:durableId="' || {d} || '"><w:abstractNumId w:val="' || {a} || '"/></w:num>'"""
_A_OLD = _A_XML.format(a="abstract_id", h="'0000000' || abstract_id")
_N_OLD = _N_XML.format(n="num_id", d="num_id", a="n.abstract_id")
_PACKAGES = f"""{ENTRIES}, most as (select file_key, max(try_cast(nullif(regexp_extract(rid, '^rId([0-9]+)$', 1), '') as int)) as n from entries group by all),
pk as (select p.file_key, p.template_key, p.library_code, coalesce(n, 1) as n, p.library_code < 'LB-20' as full_ from packages p left join most using (file_key) where p.file_key is not null)"""
_RELS_SQL = """'<Relationships><Relationship Id="rId' || n || '" Type="t/styles" Target="x.xml"/>'"""
_HF = f"""{_PACKAGES}, one as (select file_key, part, arg_min(struct_pack(e := entry_id, k := hf_kind, r := rid, x := xml), entry_id) as e from entries where regexp_matches(part, '^word/(header|footer)[0-9]+\\.xml$') and coalesce(rid, '') <> '' group by all),
hf as (select o.file_key, part, e.e as entry_id, e.k as kind, e.r as rid, e.x as xml, pk.n + row_number() over (partition by o.file_key order by part) as new_id, pk.n from one o join pk using (file_key)),
target as (select file_key, rid, arg_max(new_id, struct_pack(f := kind = 'footer', e := entry_id)) as new_id from hf group by all),
refs as (select file_key, kind, arg_min(rid, entry_id) as rid from hf group by all)"""
_REF = """coalesce((select '<w:{k}Reference w:type="default" r:id="rId' || t.new_id || '"/>' from refs r join target t on t.file_key = r.file_key and t.rid = r.rid where r.file_key = h.file_key and r.kind = '{k}'), '')"""
_STEMS = "stems as (select distinct template_key, regexp_replace(style_id, '[0-9]+.*$', '') as stem from styles)"
_SECTIONS = f"""{ENTRIES}, {STYLES}, targets as (select e.*, p.template_key, row_number() over (partition by e.file_key order by entry_id) - 1 as pos from entries e join packages p using (file_key)),
chain as (select *, row_number() over (partition by template_key order by style_id) - 1 as at_ from styles where semi_hidden and qformat and ui_priority < 40)"""
_LAST = "regexp_replace(regexp_replace(part, '^.*/', ''), '\\.xml$', '')"
ORACLES |= {
    "restyle_paragraphs": f"""with {ROWS} select file_key, idx, '<w:p><w:pPr>' || {_PSTYLE} || {_DIRECT} || '</w:pPr><w:r><w:rPr>' || {_FONT} || {_END} as styled,
  '<w:p><w:pPr>' || {_OLD} || {_DIRECT} || '</w:pPr><w:r><w:rPr>' || {_END} as plain_runs, '<w:p><w:pPr>' || {_OLD} || '</w:pPr><w:r><w:rPr>' || {_FONT} || {_END} as plain_layout,
  '<w:p><w:pPr>' || {_PSTYLE} || '</w:pPr><w:r><w:rPr>' || {_END} as restyled from rows_ where file_key is not null""",
    "style_edits": f"""with {STYLES} select template_key, style_id, regexp_matches({_STYLE_BLOCK}, '<w:(spacing|ind|jc|numPr)') as layout,
  case when ui_priority is not null then replace({_STYLE_BLOCK}, '<w:numId w:val="' || ui_priority || '"', '<w:numId w:val="' || (ui_priority + 1000) || '"') end as renumbered, '<w:style>' || coalesce(ppr, '') || '</w:style>' as bare, true as same from styles""",
    "style_maps": """with r as (select template_key, trim(style_id) as style_id, revision, coalesce(ui_priority, -1) as p from style_defs where template_key is not null and trim(style_id) <> '' and revision is not null)
select template_key, style_id, min(revision)::bigint as first_revision, max(revision)::bigint as last_revision, nullif(arg_max(p, struct_pack(r := revision, p := p)), -1)::bigint as num_id from r group by all""",
    "style_extract": f"with {STYLES} select template_key, {esc('style_id')} as style_id, {esc('coalesce(style_type, ' + chr(39) + 'paragraph' + chr(39) + ')')} as type, {esc('based_on')} as based_on, {esc('next')} as next, {esc('link')} as link from styles",
    "run_blocks": f"""with {ENTRIES} select file_key, '<w:rPr><w:b w:val="' || coalesce(rid, '') || '"/></w:rPr>' as form, count(*) as n from entries group by all""",
    "section_blocks": f"""with {ENTRIES} select file_key, row_number() over (partition by file_key order by entry_id) - 1 as idx, 'headerReference,pgSz,pgMar,custom' as children,
  '<w:sectPr w:rsidR="' || entry_id || '"><w:custom w:val="' || hf_kind || '"/></w:sectPr>' as form, length(xml)::varchar as top, '3' as left, null::varchar as right from entries""".replace(" as left", ' as "left"').replace(" as right", ' as "right"'),
    "hf_relationships": f"""with {ENTRIES} select distinct file_key, '<Relationship Id="' || coalesce(rid, '') || '" Type="http://x/relationships/' || hf_kind || '" Target="' || part || '"/>' as relationship from entries""",
    "numbering_registry": f"""with {_NUMBERING} select n.template_key, num_id, n.abstract_id, {_N_OLD} as xml, case when a.abstract_id is not null then {_A_XML.format(a='a.abstract_id', h="'0000000' || a.abstract_id")} end as abstract_xml
from nums n left join abstracts a on a.template_key = n.template_key and a.abstract_id = n.abstract_id""",
    "numbering_plan": f"""with {_NUMBERING} select s.file_key, 'style' as kind, style_id as item, s.num_id as old_id, n.new_id from sound s join new_n n on n.file_key = s.file_key and n.num_id = s.num_id
union all select file_key, rule, styles, item, null from wrong""",
    "numbering_inject": f"""with {_NUMBERING}, a as (select file_key, k, string_agg({_A_XML.format(a='new_id', h=_HASH.format(c='(' + _A_OLD + ')'))}, chr(10) order by new_id) as x from new_a group by all),
n as (select n.file_key, string_agg({_N_XML.format(n='n.new_id', d="(('0x' || " + _HASH.format(c='(' + _N_OLD + ')') + ")::bigint % 2147483646 + 1)", a='a.new_id')}, chr(10) order by n.new_id) as x from new_n n join new_a a on a.file_key = n.file_key and a.abstract_id = n.abstract_id group by n.file_key)
select a.file_key, '<w:numbering><w:abstractNum w:abstractNumId="' || k || '"><w:nsid w:val="AAAAAAAA"/></w:abstractNum>' || a.x || chr(10) || '<w:num w:numId="' || k || '"><w:abstractNumId w:val="' || k || '"/></w:num>' || n.x || chr(10) || '</w:numbering>' as xml,
  null::varchar as error from a join n using (file_key)""",
    "footer_tokens": f"""with {PARTS}, f as (select file_key, part as part_name, regexp_extract(xml, '<w:t>(.*)</w:t>', 1) as t from parts where xml like '<w:ftr>%'),
first_ as (select file_key, min(t) as m from f group by all), k as (select file_key, regexp_extract(m, '^[0-9 ]+ - (.*)$', 1) as title, regexp_extract(m, '^([0-9 ]+) - ', 1) as number from first_),
j as (select part_name, file_key, number, case when title <> '' then replace(t, title, 'AIR HANDLING-UNITS') else t end as t from f join k using (file_key))
select file_key, part_name, case when number <> '' and contains(t, number) then replace(t, number, '99 88 77') when number <> '' then replace(t, replace(number, ' ', ''), '998877') else t end as seen, 2 as n_nodes from j""",
    "apply_case_pattern": f"with {STYLES} select template_key, style_id, upper(coalesce(style_name, '')) as upper, coalesce(style_name, '') as mixed from styles",
    "page_layout": f"""with {_SECTIONS} select t.file_key, t.pos, '<w:sectPr w:rsidR="' || entry_id || '"><w:headerReference w:type="default" r:id="' || coalesce(rid, '') || '"/>' || case
  when c.style_id is not null then '<w:pgSz w:w="' || c.ui_priority || '"/><w:pgMar w:top="' || length(c.style_id) || '"/>' when m.library_code > 'LB-10' then '<w:pgSz w:w="d"/>' else '<w:pgSz w:w="' || length(xml) || '"/>' end || '<w:titlePg/></w:sectPr>' as xml
from targets t left join chain c on c.template_key = t.template_key and c.at_ = t.pos left join templates m on m.template_key = t.template_key""",
    "layout_violations": f"""with {_SECTIONS}, n as (select file_key, template_key, count(*) as n_sections from targets group by all), l as (select template_key, count(*) as n_chain from chain group by all)
select file_key, n_sections, coalesce(n_chain, 0) as n_chain from n left join l using (template_key) where template_key not in (select template_key from templates where library_code > 'LB-10') and n_sections <> coalesce(n_chain, 0)""",
    "fonts_missing": f"with {STYLES}, {_STEMS} select file_key, stem as name from packages p join stems s using (template_key) where stem not in ('Body', p.library_code)",
    "theme_step": f"""with {_PACKAGES} select file_key, '<a:theme n="' || library_code || '"/>' as theme,
  '<Types>' || case when full_ then '' else '  <Override PartName="/word/theme/theme1.xml" ContentType="{environment.CONTENT_TYPES["theme"]}"/>' || chr(10) end || '</Types>' as types,
  {_RELS_SQL} || case when full_ then '' else '  <Relationship Id="rId' || (n + 1) || '" Type="{environment.REL_BASE}theme" Target="theme/theme1.xml"/>' || chr(10) end || '</Relationships>' as rels,
  case when full_ then 'theme: replaced' else 'theme: added' end as log from pk""",
    "settings_step": f"""with {_PACKAGES}, s as (select *, library_code in ('LB-12', 'LB-30') as raw_, '<w:compat><w:c w:v="' || library_code || '"/></w:compat>' as flags, '<w:settings><w:docId w:val="' || file_key || '"/>' as head from pk)
select file_key, case when raw_ and full_ then head || '<w:raw/></w:settings>' when raw_ then '<w:settings><w:docId w:val="T"/><w:raw/></w:settings>' when library_code = 'LB-05' then head || '<w:compat><w:old/></w:compat></w:settings>'
  when full_ then head || flags || '</w:settings>' else replace('{environment.EMPTY_SETTINGS}', '</w:settings>', '  ' || flags || chr(10) || '</w:settings>') end as settings,
  case when raw_ then 'settings: replaced, document id kept' when library_code = 'LB-05' then 'settings: malformed flags, nothing changed' when full_ then 'settings: flags replaced' else 'settings: flags inserted' end as log from s""",
    "fonts_step": f"""with {STYLES}, {_STEMS}, n as (select file_key, library_code, count(stem) filter (where stem not in ('Body', library_code)) as n, string_agg('<w:font w:name="' || stem || '"></w:font>', chr(10) order by stem) filter (where stem not in ('Body', library_code)) as x from packages join stems using (template_key) group by all)
select file_key, '<w:fonts><w:font w:name="Body"></w:font><w:font w:name="' || library_code || '"></w:font>' || coalesce(x || chr(10), '') || '</w:fonts>' as fonts, 'fonts: ' || n || ' added' as log from n""",
    "defaults_step": f"""with {_PACKAGES}, b as (select *, '<w:docDefaults>' || chr(10) || '<w:rPrDefault><w:rPr><w:sz w:val="' || n || '"/></w:rPr></w:rPrDefault>' || chr(10) || '<w:pPrDefault><w:pPr/></w:pPrDefault>' || chr(10) || '</w:docDefaults>' as block from pk)
select file_key, case when full_ then '<w:styles>' || block || '<w:s/></w:styles>' when library_code = 'LB-33' then '<other/>' else '<w:styles a=''b''>' || chr(10) || block || chr(10) || '<w:s/></w:styles>' end as styles,
  case when full_ then 'defaults: replaced' when library_code = 'LB-33' then 'defaults: the style sheet has no root, nothing changed' else 'defaults: inserted' end as log from b""",
    "headers_step": f"""with {_HF}, names as (
  select file_key, part as name from hf union all select file_key, 'word/_rels/' || {_LAST} || '.xml.rels' from hf union all select file_key, 'word/media/hf_' || {_LAST} || '_01_' || substr(sha1(xml), 1, 8) || '.png' from hf union all select file_key, 'word/media/hf_' || {_LAST} || '_02_' || substr(sha1(part), 1, 8) || '.jpeg' from hf
  union all select distinct file_key, unnest(['[Content_Types].xml', 'word/_rels/document.xml.rels', 'word/document.xml']) from hf),
h as (select file_key, n, string_agg('<Relationship Id="rId' || new_id || '" Type="{environment.REL_BASE}' || kind || '" Target="' || {_LAST} || '.xml"/>', '' order by new_id) as added from hf group by all)
select h.file_key, (select string_agg(name, ',' order by name) from names m where m.file_key = h.file_key) as names, {_RELS_SQL} || added || '</Relationships>' as rels,
  '<w:body><w:sectPr>' || {_REF.format(k='header')} || {_REF.format(k='footer')} || '<w:pgSz w:w="1"/><w:titlePg/></w:sectPr></w:body>' as document, null::varchar as error from h""",
    "environment_run": f"""with {_HF} select file_key, 'theme: none in the template|settings: none in the template|fonts: none in the template|defaults: nothing to apply|layout: 1 sections|headers and footers: ' || count(*) || ' parts' as log from hf group by file_key""",
    "style_import": f"""with recursive {STYLES}, {_ROLES}, f as (select template_key, regexp_replace(style_id, '[0-9]+$', '') as stem, min(style_id) as style_id from styles group by all),
want as (select distinct file_key, d.template_key, f.style_id as id from (select distinct file_key, template_key, unnest(deterministic_classifications).csi_role as role from slim_bundle) d join r on r.role = d.role join f on f.template_key = d.template_key and f.stem = r.stem),
edges as (select * from (select template_key, style_id as src, unnest([based_on, link, next]) as dst from styles) where dst is not null),
reach as (select * from want union select r.file_key, r.template_key, e.dst from reach r join edges e on e.template_key = r.template_key and e.src = r.id),
known as (select r.*, s.style_id is not null as there, coalesce(s.qformat, false) as old, r.id in ('Normal', 'DefaultParagraphFont', 'TableNormal', 'NoList') as implicit from reach r left join styles s on s.template_key = r.template_key and s.style_id = r.id),
bad as (select distinct file_key from known where not there and not implicit),
up as (select template_key, style_id as id, based_on as anc, rpr, 0 as hop from styles union all select u.template_key, u.id, s.based_on, s.rpr, u.hop + 1 from up u join styles s on s.template_key = u.template_key and s.style_id = u.anc where u.hop < 49 and u.rpr is null),
size as (select template_key, id, regexp_extract(arg_min(rpr, hop) filter (where rpr is not null), 'w:val="([0-9]+)"', 1) as size from up group by all)
select file_key, k.id as style_id, case when not there then 'implicit' when old then 'replace' else 'insert' end as action, case when not there then 'implicit' else 'skip' end as again, z.size
from known k left join size z on z.template_key = k.template_key and z.id = k.id and there where file_key not in (select file_key from bad)
union all select file_key, null, 'error', null, null from bad""",
    "stability_check": f"with {PARTS} select file_key, part as part_name, case when regexp_matches(part, '^word/footer[0-9]+\\.xml$') then 'removed' else 'changed' end as change from parts where regexp_matches(part, '^word/(footer[0-9]+|header1[0-9]*)\\.xml$')",
    "output_checks": f"""with {PARTS}, files as (select distinct e.file_key, p.library_code from entries e join packages p using (file_key)), heads as (select distinct file_key, case when hf_kind = 'header' then rid else 'none' end as rid from entries),
have as (select file_key, part from parts where regexp_matches(part, '^word/(header|footer)[^/]*\\.xml$')), want as (select file_key, unnest(['word/header1.xml', 'word/footer1.xml']) as part from files)
select file_key, 'section' as rule, '0' as item from files where library_code < 'LB-05'
union all select file_key, 'run_formatting', '<w:rPr><w:b w:val="' || entry_id || '"/></w:rPr>' from entries join files using (file_key) where contains(xml, 'INSTALLATION')
union all select distinct e.file_key, 'reference', rid from entries e join files using (file_key) where rid <> '' and not exists (select 1 from heads h where h.file_key = e.file_key and h.rid = e.rid)
union all select file_key, 'extra_part', part from have h where not exists (select 1 from want w where w.file_key = h.file_key and w.part = h.part)
union all select file_key, 'missing_part', part from want w where not exists (select 1 from have h where h.file_key = w.file_key and h.part = w.part)""",
    "contract_run": f"with {ROWS} select file_key, count(*) as n, count(*) as n_shown from rows_ where file_key is not null and contains(text, 'steel') group by all",
    "reassembly": f"""with {_CHUNKED}, lib as (select file_key, min(library_code) as library from slim_bundle group by all)
select k.file_key, case when library in ('LB-03', 'LB-04') then 0 else count(distinct idx) end as n, case when library not in ('LB-03', 'LB-04') then (select string_agg('n' || c, ',' order by c) from (select unnest(range(max(chunk) + 1)) as c)) end as notes,
  case when library in ('LB-03', 'LB-04') then 'coverage' end as reason from k join lib using (file_key) group by k.file_key, library""",
    "context_classify": f"""with {ROWS}, t as (select file_key, idx, coalesce(lag(substr(text, 1, 40)) over w, '') as before, coalesce(lead(substr(text, 1, 40)) over w, '') as after from rows_ where file_key is not null window w as (partition by file_key order by idx))
select file_key, idx::int as paragraph_index, case when before like 'PART %' then 'ARTICLE' when after like 'PART %' then 'PARAGRAPH' else 'SUBPARAGRAPH' end as csi_role from t""",
    "submitted": "select library_code || '__chunk0' as custom_id, 'succeeded' as status, 'True' as text from style_libraries",
    "request_cap": f"with {_CHUNKED}, n as (select count(*) as n from (select distinct file_key, chunk from k)) select cap, n > cap as refused from n, (values (1), (100), (1000000000)) v(cap)",
    "prompt_text": "select library_code, 'Read each row.' || chr(10) || 'Name its role.' || chr(10) || chr(10) || 'available_roles: [\"PART\"]' || chr(10) || chr(10) || title as message from style_libraries",
    "package_run": f"""with {ANALYSIS}, f as (select distinct file_key from rows_ where file_key is not null), n as (select file_key, count(*) filter (where not in_table) as n from analysed group by all),
lib as (select file_key, min(library_code) <> 'LB-07' as good from slim_bundle group by all)
select file_key, good as success, coalesce(n, 0) as requested, case when good then coalesce(n, 0) else 0 end as modified, good as written, true as timed, case when not good then '''word/styles.xml''' end as error,
  (select 'read:,classify:,apply:' || count(*) || ',write:' || count(*) filter (where good) from f join lib using (file_key)) as stages from f join lib using (file_key) left join n using (file_key)""",
}
ORACLES = {name: blank_trim(sql) for name, sql in ORACLES.items()}
