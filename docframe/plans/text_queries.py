"""Queries on lines, paragraphs and markup, each with an independent DuckDB query."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import ids, markup, text
from docframe.operators import context, paragraphs as doc_paragraphs
from docframe.operators.relational import numbered
from docframe.plans.sql import blank_trim
from docframe.sources.tables import table


def lines(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", F.posexplode(text.lines(F.col("text"))).alias("pos", "line"))
    return docs.withColumn("idx", F.col("pos").cast("bigint")).drop("pos")


def bundle_rows(spark, folder):
    """Paragraphs of the bundles, once per file and index."""
    rows = table(spark, folder, "slim_bundle").select("file_key", F.explode("paragraphs").alias("p")).select("file_key", F.col("p.paragraph_index").cast("bigint").alias("idx"), "p.text", "p.in_table", "p.marker_type")
    return rows.where("idx is not null").groupBy("file_key", "idx").agg(F.max("text").alias("text"), F.max(F.coalesce("in_table", F.lit(False))).alias("in_table"), F.max("marker_type").alias("marker_type"))


LINES = """lines as (
  select doc_id, lang, source, (i - 1)::bigint as idx, l[i::bigint] as line from (
    select doc_id, lang, source, l, unnest(generate_series(1, len(l))) as i from (
      select doc_id, lang, source, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as l from documents)))"""
ROWS = """rows_ as (
  select file_key, p.paragraph_index::bigint as idx, max(p.text) as text, max(coalesce(p.in_table, false)) as in_table, max(p.marker_type) as marker_type
  from (select file_key, unnest(paragraphs) as p from slim_bundle) where p.paragraph_index is not null group by all)"""


def lines_explode(spark, folder):
    return lines(spark, folder).select("doc_id", "idx", "line")


def marker_type(spark, folder):
    return lines(spark, folder).select("doc_id", "idx", text.marker_type(F.col("line")).alias("marker")).where("marker is not null")


_MARKER = "case when regexp_matches({c}, '^\\s*[A-Z]\\.\\s+') then 'upper_alpha' when regexp_matches({c}, '^\\s*[0-9]+\\.\\s+') then 'number' when regexp_matches({c}, '^\\s*[a-z]\\.\\s+') then 'lower_alpha' end"
_SECTION = "'^\\s*(?i:SECTION)\\s+[0-9]{2}(\\s+[0-9]{2}){2,}([^0-9A-Za-z_]|$)'"
_RULE = f"""case when in_table or coalesce(t, '') = '' then null when regexp_matches(t, {_SECTION}) then 'SectionID'
  when regexp_matches(t, '^\\s*(?i:END\\s+OF\\s+SECTION)') then 'END_OF_SECTION' when regexp_matches(t, '^\\s*(?i:PART)\\s+[123]([^0-9A-Za-z_]|$)') then 'PART'
  when regexp_matches(t, '^\\s*[0-9]+\\.[0-9]{{2}}([^0-9A-Za-z_]|$)') then 'ARTICLE'
  when coalesce(regexp_matches(before, {_SECTION}), false) and regexp_matches(t, '^[^a-z]*[A-Z][^a-z]*$') then 'SectionTitle'
  when marker = 'upper_alpha' then 'PARAGRAPH' when marker in ('number', 'list_numpr') then 'SUBPARAGRAPH' when marker = 'lower_alpha' then 'SUBSUBPARAGRAPH' end"""


def _roles(spark, folder):
    """Rule roles of the bundle paragraphs, the title rule over the row before."""
    rows = bundle_rows(spark, folder).withColumn("t", text.squeeze(F.col("text"))).where("t <> ''")
    rows = rows.withColumn("marker", F.coalesce(text.marker_type(F.col("t")), F.when(F.trim("marker_type") == "list_numpr", "list_numpr")))
    rows = context.neighbours(rows, ["file_key"], "idx", F.col("t"), after=None)
    return rows.withColumn("role", text.rule_role(F.col("t"), F.col("marker"), F.col("before"), F.col("in_table")))


def rule_role(spark, folder):
    return _roles(spark, folder).select("file_key", "idx", "marker", "role")


_ROLES = f"""{ROWS}, squeezed as (
  select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from rows_), marked as (
  select *, coalesce({_MARKER.format(c="t")}, case when trim(marker_type) = 'list_numpr' then 'list_numpr' end) as marker,
    lag(t) over (partition by file_key order by idx) as before from squeezed where t <> ''),
roles as (select *, {_RULE} as role from marked)"""


def role_counts(spark, folder):
    """The flagship: how many lines of each rule role every language has."""
    rows = lines(spark, folder).withColumn("t", text.squeeze(F.col("line"))).where("t <> ''")
    rows = rows.withColumn("marker", text.marker_type(F.col("t")))
    rows = context.neighbours(rows, ["doc_id"], "idx", F.col("t"), after=None)
    rows = rows.withColumn("role", F.coalesce(text.rule_role(F.col("t"), F.col("marker"), F.col("before"), F.lit(False)), F.lit("open")))
    return rows.groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), "role").agg(F.count(F.lit(1)).alias("n"))


def role_fallback(spark, folder):
    rows = table(spark, folder, "slim_bundle").select("file_key", "available_roles", F.explode("deterministic_classifications").alias("c"))
    rows = rows.select("file_key", F.col("c.paragraph_index").cast("bigint").alias("idx"), F.col("c.csi_role").alias("role"), F.filter("available_roles", lambda r: ~r.isin("SUBPARAGRAPH", "SectionID")).alias("have")).distinct()
    return rows.select("file_key", "idx", "role", text.available_role(F.col("role"), F.col("have")).alias("resolved"))


# Lines that do not belong to the specification, one of which is put behind each text by its length; the last ones do belong.
PROBES = [
    "[Note to Specifier: choose one of the two makers.]", "Designer's note, remove before issue", "[Retain one of the two options below.]", "Retain definitions remaining when editing is done.", "Paragraph below is described in another place.",
    "Brackets in first two paragraphs below are to be sized.", "Option: plastic shields may be used.", "Manufacturers' catalogs show that such hangers are small.", "Stronger inserts may permit use of shorter shields.", "This Section uses the term of the owner.",
    "See the Evaluations for a discussion.", "Do not repeat what other parts say.", "Copyright 2031 by the office", "all rights reserved.", "Unauthorized copying of this text is an offence.", "- - - - -", "Page 4 of 17", "3 of 9", "Rev. B", "before {revision 4} behind",
    "before <<hidden until printed>> behind", "[hidden text]: not shown", "Retain existing supports where shown.", "Verify all sizes in the field before work begins.", "Option: Provide bracing where the code asks for it.", "See Section 01 33 00 for submittals.",
]


def _probed(spark, folder):
    """Every paragraph with one of the probes as a further line."""
    rows = bundle_rows(spark, folder).where("text is not null")
    probe = F.element_at(F.array(*map(F.lit, PROBES)), F.length("text") % len(PROBES) + 1)
    return rows.withColumn("text", F.concat("text", F.lit("\n"), probe))


def _stripped(spark, folder):
    return _probed(spark, folder).withColumn("s", text.strip_boilerplate(F.col("text")))


def boilerplate_strip(spark, folder):
    """Every paragraph with a probe behind it, stripped by the rules of the engine."""
    return _stripped(spark, folder).select("file_key", "idx", F.col("s.text").alias("clean"), F.array_join("s.tags", ",").alias("tags"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip_sql(value: str) -> tuple[str, str]:
    """Stripped text and list of tags of a SQL expression under the rules of the engine."""
    tags = []
    for pattern, tag in text.BOILERPLATE:
        tags.append(f"case when regexp_matches({value}, {sql_text(pattern)}) then ['{tag}'] else [] end")
        value = f"regexp_replace({value}, {sql_text(pattern)}, '', 'g')"
    clean = f"regexp_replace(regexp_replace(regexp_replace({value}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
    return f"trim({clean})", "list_concat(" + ", ".join(tags) + ")"


_CLEAN, _TAGS = strip_sql("text")
_STRIP = f"""with {ROWS}, probed as (select file_key, idx, text || chr(10) || ([{", ".join(map(sql_text, PROBES))}])[length(text) % {len(PROBES)} + 1] as text from rows_ where text is not null),
tagged as (select *, {_TAGS} as found from probed)
select file_key, idx, {_CLEAN} as clean, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') as tags from tagged"""


def filter_report(spark, folder):
    """What cleaning does per tag: paragraphs removed entirely or stripped."""
    rows = _stripped(spark, folder).where("size(s.tags) > 0").select(F.when(F.col("s.text") == "", "removed").otherwise("stripped").alias("action"), F.explode("s.tags").alias("tag"))
    return rows.groupBy("action", "tag").agg(F.count(F.lit(1)).alias("n"))


def case_pattern(spark, folder):
    """Case pattern and title form of every paragraph, in any script; a null text is unknown."""
    return bundle_rows(spark, folder).select("file_key", "idx", text.case_pattern(F.col("text")).alias("pattern"), text.title_case(F.col("text")).alias("title"))


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_CASE = f"""with {ROWS}, words as (
  select file_key, idx, text, trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) as t, list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '') as w from rows_)
select file_key, idx,
  case when t = '' then 'unknown' when t = upper(t) then 'upper'
    when len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) * 10 >= len(w) * 7 then 'title' else 'mixed' end as pattern,
  array_to_string(list_transform(w, lambda x: array_to_string(list_transform(string_split(x, '-'), lambda p:
    case when upper(regexp_replace(p, '[^A-Za-z]', '', 'g')) in ({", ".join(f"'{a}'" for a in text.ACRONYMS)}) then p
      when upper(p) = p and regexp_matches(p, '\\p{{Lu}}') and not regexp_matches(p, '[\\p{{Ll}}\\p{{Lt}}]') then array_to_string(list_transform(regexp_extract_all(p, '([{_CASED}]+|[^{_CASED}]+)'), lambda r: upper(r[1:1]) || lower(r[2:])), '')
      else p end), '-')), ' ') as title
from words"""


def section_number(spark, folder):
    """Section number of every paragraph; empty where there is none."""
    return bundle_rows(spark, folder).select("file_key", "idx", text.section_number(F.col("text")).alias("number"))


_NUMBER = f"""with {ROWS} select file_key, idx, trim(regexp_replace(
  coalesce(nullif(regexp_extract(coalesce(text, ''), '(?i)section{_SPACE}(\\p{{Nd}}[\\p{{Nd}}{_SPACE[1:-2]}]*)', 1), ''), array_to_string(regexp_extract_all(coalesce(text, ''), '(\\p{{Nd}}+)', 1), ' ')), '{_SPACE}', ' ', 'g')) as number
from rows_"""


def blocks_explode(spark, folder):
    entries = table(spark, folder, "hf_entries").select("entry_id", "xml").distinct()
    return markup.explode_blocks(entries, "xml", "w:p").select("entry_id", F.col("idx").cast("bigint").alias("idx"), "block")


def block_text(spark, folder):
    rows = blocks_explode(spark, folder)
    return rows.select("entry_id", "idx", markup.block_text(F.col("block")).alias("text"), text.squeeze(markup.unescape_basic(markup.raw_text(F.col("block")))).alias("basic_text"))


_BLOCKS = """entries as (select distinct entry_id, xml from hf_entries where xml is not null),
blocks as (select entry_id, (i - 1)::bigint as idx, b[i::bigint] as block from (
  select entry_id, b, unnest(generate_series(1, len(b))) as i from (select entry_id, regexp_extract_all(xml, '(<w:p\\b[\\s\\S]*?</w:p>)', 1) as b from entries)))"""
_RAW = "array_to_string(regexp_extract_all(block, '<w:t\\b[^>]*>([\\s\\S]*?)</w:t>', 1), '')"
_PLAIN = f"trim(regexp_replace(replace(replace(replace(replace(replace({_RAW}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


def block_spans(spark, folder):
    """Spans of all text nodes in the header and footer parts of a file, joined in the order of their ids."""
    entries = table(spark, folder, "hf_entries").where("xml is not null and file_key is not null").select("file_key", "entry_id", "xml").distinct()
    joined = context.splice(entries, ["file_key"], "entry_id", "xml")
    spans = joined.select("file_key", F.posexplode(markup.block_spans(F.col("xml"), "w:t")).alias("idx", "s"))
    return spans.select("file_key", F.col("idx").cast("bigint").alias("idx"), F.col("s.start").cast("bigint").alias("start"), F.col("s.stop").cast("bigint").alias("stop"))


def first_attr(spark, folder):
    styles = table(spark, folder, "style_defs").where("style_id is not null").select("template_key", "style_id", "revision", "ppr", "rpr").distinct()
    return styles.select("template_key", "style_id", "revision", markup.attribute(F.col("ppr"), "w:spacing", "w:after").alias("after"), markup.attribute(F.col("rpr"), "w:sz").alias("size"))


def on_off_hints(spark, folder):
    """Tri-state switches read from run properties that are put together from the size and flags of a style."""
    styles = table(spark, folder, "style_defs").where("style_id is not null").select("template_key", "style_id", "revision", "semi_hidden", "qformat").distinct()
    xml = F.concat(F.lit("<w:rPr>"), F.when(F.col("semi_hidden"), '<w:b w:val="off"/>').when(~F.col("semi_hidden"), "<w:b/>").otherwise(""), F.when(F.col("qformat"), '<w:i w:val="true"/>').otherwise("<w:iCs/>"), F.lit("</w:rPr>"))
    flags = {"semi_hidden": F.col("semi_hidden"), "qformat": F.col("qformat"), "bold": markup.on_off(xml, "w:b"), "italic": markup.on_off(xml, "w:i")}
    return styles.select("template_key", "style_id", "revision", *(c.cast("string").alias(n) for n, c in flags.items()))


def contract_diff(spark, folder):
    """Styles whose layout differs from their first revision by more than an edit may change."""
    entries = table(spark, folder, "hf_entries").where("xml is not null").select("entry_id", "xml").distinct()
    edited = F.concat(F.regexp_replace("xml", "<w:p>", '<w:p><w:pPr><w:pStyle w:val="Edited"/><w:jc w:val="both"/></w:pPr>'), F.when(F.col("xml").contains("INSTALLATION"), "<!-- changed -->").otherwise(""))
    both = entries.select("entry_id", markup.contract_form(F.col("xml")).alias("before"), markup.contract_form(edited).alias("after"))
    return both.where("before <> after").select("entry_id", "after")


def escape_attr(spark, folder):
    titles = table(spark, folder, "part").select("p_partkey", F.concat(F.lit('<a b="'), "p_name", F.lit("\" & 'c'>")).alias("t"))
    return titles.select("p_partkey", markup.escape_attribute(F.col("t")).alias("escaped"), (markup.unescape_basic(markup.escape_attribute(F.col("t"))) == F.col("t")).alias("round_trip"))


def fragment_check(spark, folder):
    """Fragments of styles held against another element (error), their own (sound) and cut by their last sign (cut)."""
    styles = table(spark, folder, "style_defs").where("style_id is not null").select("template_key", "style_id", "revision", "ppr", "rpr").distinct()
    short = F.substring(F.col("rpr"), F.lit(1), F.length("rpr") - 1)
    checks = {"error": markup.fragment_error(F.col("ppr"), "w:rPr"), "cut": markup.fragment_error(short, "w:rPr"), "sound": markup.fragment_error(F.col("rpr"), "w:rPr").isNull()}
    return styles.select("template_key", "style_id", "revision", *(c.alias(n) for n, c in checks.items()))


def hash_snapshot(spark, folder):
    return table(spark, folder, "documents").select("doc_id", ids.sha256(F.col("text")).alias("digest"), ids.short_hash(F.col("text")).alias("short"))


def short_key(spark, folder):
    return table(spark, folder, "packages").select("file_key", ids.file_key(F.concat(F.lit("/in/"), "template_key", F.lit("/"), "file_name")).alias("made"), (F.regexp_extract("file_key", "__([0-9a-f]{12})$", 1) != "").alias("well_formed"))


def durable_id(spark, folder):
    return table(spark, folder, "part").select("p_partkey", ids.durable_id(F.col("p_name")).alias("durable_id"), ids.short_hash(F.col("p_name")).alias("nsid"))


def free_ids(spark, folder):
    """Hash ids of part names, avoiding those of the dearer half of their brand."""
    parts = table(spark, folder, "part")
    mean = parts.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"))
    taken = parts.join(mean, "p_brand").where("p_retailprice > mean").groupBy("p_brand").agg(F.collect_set(ids.short_hash(F.col("p_name"))).alias("taken"))
    return parts.join(taken, "p_brand", "left").select("p_partkey", ids.free_hash(F.col("p_name"), F.coalesce("taken", F.array()), tries=9).alias("free"))


def custom_id(spark, folder):
    rows = bundle_rows(spark, folder).select("file_key", "idx", ids.request_id(F.col("file_key"), F.col("idx")).alias("request"))
    return rows.select("request", ids.request_key(F.col("request")).alias("key"), ids.request_chunk(F.col("request")).alias("chunk"))


def json_props(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def rel_target(spark, folder):
    parts = table(spark, folder, "package_parts").where("part_name is not null").select("part_name").distinct()
    return parts.select("part_name", ids.relative_target(F.col("part_name")).alias("target"))


def context_prev_next(spark, folder):
    rows = bundle_rows(spark, folder).where("text <> ''").select("file_key", "idx", F.substring("text", 1, context.TEXT_CHARS).alias("text"))
    return context.with_context(rows, ["file_key"], "idx")


def running_offset(spark, folder):
    return context.running_offset(lines(spark, folder), ["doc_id"], "idx", F.length("line") + 1).select("doc_id", "idx", "offset")


def chunk_overlap(spark, folder):
    rows = bundle_rows(spark, folder).select("file_key", "idx")
    return context.overlapping_chunks(rows, ["file_key"], "idx", 50).select("file_key", "idx", "chunk")


_CHUNKS = f"""{ROWS}, counted as (select file_key, idx, text, row_number() over (partition by file_key order by idx) as rn, count(*) over (partition by file_key) as n from rows_),
chunks as (
  select file_key, idx, text, unnest(generate_series(greatest(0, ceil((rn - 50) / 30.0))::bigint, least(floor((rn - 1) / 30.0), greatest(0, ceil((n - 50) / 30.0)))::bigint)) as chunk
  from counted where n > 50
  union all select file_key, idx, text, 0 from counted where n <= 50)"""


def chunk_ranges(spark, folder):
    return context.chunk_ranges(chunk_overlap(spark, folder), ["file_key"], "idx")


def chunk_sizing(spark, folder):
    record = F.to_json(F.struct(F.col("idx").alias("paragraph_index"), "text"))
    sizes = bundle_rows(spark, folder).groupBy("file_key").agg(F.sum(F.length(record)).alias("chars"), F.count(F.lit(1)).alias("n_rows"))
    return sizes.select("file_key", "n_rows", context.chunk_rows(F.col("chars") + 200, F.col("n_rows"), F.lit(200), 6000).alias("rows_per_chunk"))


def chunk_completeness(spark, folder):
    rows = bundle_rows(spark, folder).select("file_key", "idx", "text")
    chunks = context.overlapping_chunks(rows, ["file_key"], "idx", 50)
    received = chunks.where("length(text) > 250")
    return context.chunk_completeness(chunks, received, ["file_key"])


def splice_roundtrip(spark, folder):
    joined = context.splice(lines(spark, folder), ["doc_id"], "idx", "line", "\n")
    docs = table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", "\r\n|\r", "\n").alias("whole"))
    return joined.join(docs, "doc_id").select("doc_id", (F.col("line") == F.col("whole")).alias("same"), F.length("line").cast("bigint").alias("n_chars"))


def document_analysis(spark, folder):
    """Header and footer parts as documents through the whole analysis; checked against its SQL counterpart."""
    docs = table(spark, folder, "hf_entries").where("xml is not null").select(F.col("entry_id").cast("string").alias("file_key"), "xml").distinct()
    got = doc_paragraphs.analyse(docs).enriched
    return got.select("file_key", F.col("paragraph_index").cast("bigint").alias("idx"), "text", "prev_text", "in_table", "marker_type", "csi_role")


def stable_rank(spark, folder):
    rows = lines(spark, folder).where("line <> ''").select("doc_id", "idx", "line")
    return numbered(rows, ["doc_id"], [F.col("line"), F.col("idx")]).select("doc_id", "idx", "pos")


QUERIES = {
    f.__name__: f
    for f in (
        lines_explode, marker_type, rule_role, role_counts, role_fallback, boilerplate_strip, filter_report, case_pattern, section_number, blocks_explode, block_text,
        block_spans, first_attr, on_off_hints, contract_diff, escape_attr, fragment_check, hash_snapshot, short_key, durable_id, free_ids, custom_id, json_props, rel_target,
        context_prev_next, running_offset, chunk_overlap, chunk_ranges, chunk_sizing, chunk_completeness, splice_roundtrip, document_analysis, stable_rank,
    )
}

_HASH = "upper(substr(sha1(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), 1, 8))"
ORACLES = {
    "lines_explode": f"with {LINES} select doc_id, idx, line from lines",
    "marker_type": f"with {LINES} select * from (select doc_id, idx, {_MARKER.format(c='line')} as marker from lines) where marker is not null",
    "rule_role": f"with {_ROLES} select file_key, idx, marker, role from roles",
    "role_counts": f"""with {LINES}, marked as (select doc_id, coalesce(lang, '?') as lang, idx, false as in_table, trim(regexp_replace(line, '\\s+', ' ', 'g')) as t from lines),
  seen as (select *, {_MARKER.format(c='t')} as marker, lag(t) over (partition by doc_id order by idx) as before from marked where t <> '')
select lang, coalesce({_RULE}, 'open') as role, count(*) as n from seen group by all""",
    "role_fallback": """with c as (select distinct file_key, c.paragraph_index::bigint as idx, c.csi_role as role, have from (
  select file_key, unnest(deterministic_classifications) as c, list_filter(available_roles, lambda r: r not in ('SUBPARAGRAPH', 'SectionID')) as have from slim_bundle)),
f(role, chain) as (values ('SectionID', ['SectionID', 'SectionTitle']), ('SUBSUBPARAGRAPH', ['SUBSUBPARAGRAPH', 'SUBPARAGRAPH', 'PARAGRAPH']), ('SUBPARAGRAPH', ['SUBPARAGRAPH', 'PARAGRAPH']))
select file_key, idx, c.role, list_filter(coalesce(chain, [c.role]), lambda r: list_contains(have, r))[1] as resolved from c left join f on f.role = c.role""",
    "boilerplate_strip": _STRIP,
    "filter_report": f"with s as ({_STRIP}) select action, tag, count(*) as n from (select case when clean = '' then 'removed' else 'stripped' end as action, unnest(string_split(tags, ',')) as tag from s where tags <> '') group by all",
    "case_pattern": _CASE,
    "section_number": _NUMBER,
    "blocks_explode": f"with {_BLOCKS} select entry_id, idx, block from blocks",
    "block_text": f"with {_BLOCKS} select entry_id, idx, {_PLAIN} as text, {_PLAIN} as basic_text from blocks",
    "block_spans": """with e as (select distinct file_key, entry_id, xml from hf_entries where xml is not null and file_key is not null),
o as (select *, coalesce(sum(length(xml)) over (partition by file_key order by entry_id rows between unbounded preceding and 1 preceding), 0)::bigint as base from e where true)
select file_key, row_number() over (partition by file_key order by entry_id) - 1 as idx, base + strpos(xml, '<w:t>') - 1 as start, base + strpos(xml, '</w:t>') + 5 as stop from o where strpos(xml, '<w:t>') > 0""",
    "first_attr": """select distinct template_key, style_id, revision, ppr_ as after, rpr_ as size from (
  select distinct template_key, style_id, revision, ppr, rpr, nullif(regexp_extract(ppr, 'w:after="([^"]+)"', 1), '') as ppr_, nullif(regexp_extract(rpr, '<w:sz w:val="([^"]+)"', 1), '') as rpr_ from style_defs where style_id is not null)""",
    "on_off_hints": "select distinct template_key, style_id, revision, semi_hidden::varchar as semi_hidden, qformat::varchar as qformat, (not semi_hidden)::varchar as bold, case when qformat then 'true' end as italic from style_defs where style_id is not null",
    "contract_diff": "select distinct entry_id, xml || '<!-- changed -->' as after from hf_entries where contains(xml, 'INSTALLATION')",
    "escape_attr": """select p_partkey, '&lt;a b=&quot;' || p_name || '&quot; &amp; ''c''&gt;' as escaped, true as round_trip from part""",
    "fragment_check": """select template_key, style_id, revision, case when trim(coalesce(ppr, '')) <> '' then 'expected <w:rPr>: ' || substr(trim(ppr), 1, 60) end as error,
  case when rpr is not null then 'expected <w:rPr>: ' || substr(substr(rpr, 1, length(rpr) - 1), 1, 60) end as cut, true as sound
from (select distinct template_key, style_id, revision, ppr, rpr from style_defs) where style_id is not null""",
    "hash_snapshot": f"select doc_id, sha256(text) as digest, {_HASH.format(c='text')} as short from documents",
    "short_key": """select file_key, regexp_replace(regexp_replace(file_name, '\\.[^.]*$', ''), '[^A-Za-z0-9_.-]', '_', 'g') || '__' || substr(sha1('/in/' || template_key || '/' || file_name), 1, 12) as made,
  regexp_matches(file_key, '__[0-9a-f]{12}$') as well_formed from packages""",
    "durable_id": f"select p_partkey, ('0x' || {_HASH.format(c='p_name')})::bigint % 2147483646 + 1 as durable_id, {_HASH.format(c='p_name')} as nsid from part",
    "free_ids": f"""with m as (select p_brand, avg(p_retailprice) as mean from part group by all),
taken as (select distinct p_brand, {_HASH.format(c='p_name')} as h from part join m using (p_brand) where p_retailprice > mean),
tries as (select p_partkey, p_brand, i, {_HASH.format(c="(p_name || case when i > 0 then '__collision_' || i else '' end)")} as h from part, (select unnest(range(10)) as i))
select p_partkey, arg_min(t.h, i) as free from tries t left join taken k on k.p_brand = t.p_brand and k.h = t.h where k.h is null group by all""",
    "custom_id": f"with {ROWS} select file_key || '__chunk' || idx as request, file_key as key, idx::int as chunk from rows_",
    "json_props": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "rel_target": "select distinct part_name, ltrim(trim(part_name), './') as target from package_parts where part_name is not null",
    "context_prev_next": f"""with {ROWS}, t as (select file_key, idx, substr(text, 1, 200) as text from rows_ where text <> '')
select file_key, idx, text, coalesce(lag(substr(text, 1, 80)) over w, '') as prev_text, coalesce(lead(substr(text, 1, 80)) over w, '') as next_text from t window w as (partition by file_key order by idx)""",
    "running_offset": f"with {LINES} select doc_id, idx, coalesce(sum(length(line) + 1) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as offset from lines".replace(" as offset", ' as "offset"'),
    "chunk_overlap": f"with {_CHUNKS} select file_key, idx, chunk from chunks",
    "chunk_ranges": f"with {_CHUNKS} select file_key, chunk, min(idx) as first_index, max(idx) as last_index, count(*) as n_rows from chunks group by all",
    "chunk_sizing": f"""with {ROWS}, s as (select file_key, sum(length(case when text is null then '{{"paragraph_index":' || idx || '}}' else '{{"paragraph_index":' || idx || ',"text":' || to_json(text) || '}}' end))::bigint as chars, count(*) as n_rows from rows_ group by all) select file_key, n_rows, greatest(10, floor(5800 / greatest(chars / n_rows, 1.0)))::bigint as rows_per_chunk from s""",
    "chunk_completeness": f"""with {_CHUNKS}, e as (select file_key, count(distinct chunk) as n_expected, count(distinct case when length(text) > 250 then chunk end) as n_received from chunks group by all)
select *, n_expected = n_received as complete from e""",
    "splice_roundtrip": "select doc_id, true as same, length(replace(text, chr(13) || chr(10), chr(10)))::bigint as n_chars from documents where text is not null",
    "document_analysis": f"""with {_BLOCKS}, texts as (select entry_id::varchar as file_key, idx, {_PLAIN} as text from blocks),
seen as (select *, text as t, false as in_table, null::varchar as before, {_MARKER.format(c='text')} as marker from texts where text <> '')
select file_key, idx, substr(text, 1, 200) as text, '' as prev_text, false as in_table, marker as marker_type, {_RULE} as csi_role from seen""",
    "stable_rank": f"with {LINES} select doc_id, idx, row_number() over (partition by doc_id order by line, idx) - 1 as pos from lines where line <> ''",
}
ORACLES = {name: blank_trim(sql) for name, sql in ORACLES.items()}
