"""Queries on joins, set operations, aggregates, ids, closures and checks, each with an independent DuckDB query."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import ids, text
from docframe.operators import batches, classify, closure, context, relational
from docframe.operators.hierarchy import current_rows
from docframe.operators.references import part_key
from docframe.plans.sql import blank_trim
from docframe.plans.text_queries import LINES, ROWS, bundle_rows, lines
from docframe.sources.tables import table
from docframe.streaming import packages

ROLE_STYLES = [("SectionID", "SectNo"), ("SectionTitle", "Title"), ("PART", "PartHead"), ("ARTICLE", "ArtHead"), ("PARAGRAPH", "Body"), ("SUBPARAGRAPH", "ListItem")]
_ROLE_SQL = "roles(csi_role, stem) as (values " + ", ".join(f"('{r}', '{s}')" for r, s in ROLE_STYLES) + ")"


def _role_styles(spark):
    return spark.createDataFrame(ROLE_STYLES, "csi_role string, stem string")


def deterministic(spark, folder):
    rows = table(spark, folder, "slim_bundle").select("file_key", "template_key", F.explode("deterministic_classifications").alias("c"))
    return rows.select("file_key", "template_key", F.col("c.paragraph_index").cast("bigint").alias("idx"), "c.csi_role").distinct()


_FIXED = "fixed as (select distinct file_key, template_key, c.paragraph_index::bigint as idx, c.csi_role from (select file_key, template_key, unnest(deterministic_classifications) as c from slim_bundle))"


def styles(spark, folder):
    """Current, undeleted styles with trimmed ids and references."""
    rows = table(spark, folder, "style_defs").select(
        "template_key", F.trim("style_id").alias("style_id"), *(text.nullif_empty(F.trim(c)).alias(c) for c in ("based_on", "next", "link")),
        "style_type", "ppr", "rpr", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), "revision", "loaded_at",
    ).where("template_key is not null and style_id <> ''")
    now = current_rows(rows, ["template_key", "style_id"], "revision", ["loaded_at", "is_deleted", "based_on", "next", "link", "ppr", "rpr"])
    return now.where("not is_deleted")


_STYLES = """clean as (
  select template_key, trim(style_id) as style_id, nullif(trim(based_on), '') as based_on, nullif(trim("next"), '') as next, nullif(trim(link), '') as link, style_type, ppr, rpr,
    coalesce(is_deleted, false) as is_deleted, coalesce(revision, -2147483648) as revision, loaded_at
  from style_defs where template_key is not null and trim(coalesce(style_id, '')) <> ''),
styles as (select * from (
  select *, row_number() over (partition by template_key, style_id order by revision desc, loaded_at desc, is_deleted desc, based_on desc nulls last, next desc nulls last, link desc nulls last, ppr desc nulls last, rpr desc nulls last) as rank_ from clean)
  where rank_ = 1 and not is_deleted)"""


def unresolved_filter(spark, folder):
    return bundle_rows(spark, folder).where("not in_table").select("file_key", "idx").join(deterministic(spark, folder), ["file_key", "idx"], "left_anti")


def role_lookup(spark, folder):
    return deterministic(spark, folder).join(_role_styles(spark), "csi_role").groupBy("csi_role", "stem").agg(F.count(F.lit(1)).alias("n"))


def unmapped_roles(spark, folder):
    return deterministic(spark, folder).join(_role_styles(spark), "csi_role", "left_anti").groupBy("csi_role").agg(F.count(F.lit(1)).alias("n"))


def used_styles(spark, folder):
    """Distinct roles of a file resolved to style stems, those whose template has such a style (semi join) only."""
    have = styles(spark, folder).select("template_key", F.regexp_replace("style_id", "[0-9]+$", "").alias("stem")).distinct()
    return deterministic(spark, folder).join(_role_styles(spark), "csi_role").select("file_key", "template_key", "stem").distinct().join(have, ["template_key", "stem"], "left_semi")


def fk_violations(spark, folder):
    """Lines whose part is not among the small parts, with the referrers counted."""
    parts = table(spark, folder, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, folder, "lineitem").join(parts, "l_partkey", "left_anti").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("l_orderkey").alias("n_orders"))


def range_containment(spark, folder):
    """Deterministic rows inside the index range of their file's table rows."""
    ranges = bundle_rows(spark, folder).where("in_table").groupBy("file_key").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("stop"))
    return relational.interval_semi_join(deterministic(spark, folder), ranges, ["file_key"], "idx").select("file_key", "idx", "csi_role")


def two_hop(spark, folder):
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_customers"))


def style_numbering_hop(spark, folder):
    """Two hops over styles: link to the linked style to what that is based on."""
    now = styles(spark, folder)
    linked = now.select("template_key", F.col("style_id").alias("link"), F.col("based_on").alias("second"))
    return now.where("link is not null").join(linked, ["template_key", "link"]).where("second is not null").select("template_key", "style_id", "link", "second")


def positional_fill(spark, folder):
    """Each supplier of a nation, by rank, gets the customer of that rank; past the end the nation's default."""
    suppliers = relational.numbered(table(spark, folder, "supplier"), ["s_nationkey"], [F.col("s_suppkey")])
    customers = relational.numbered(table(spark, folder, "customer").where("c_acctbal > 9000"), ["c_nationkey"], [F.col("c_custkey")])
    sources = customers.select(F.concat_ws("-", "c_nationkey", "pos").alias("slot"), F.col("c_name").alias("value"))
    targets = suppliers.select("s_suppkey", F.concat_ws("-", "s_nationkey", "pos").alias("slot"))
    return relational.positional_fill(targets, sources, F.lit("default"), "slot").select("s_suppkey", "slot", "value")


def package_patch(spark, folder):
    """The current parts of packages: late revisions replace, deleted ones are left out, new ones are added."""
    rows = table(spark, folder, "package_parts").select("file_key", part_key(F.col("part_name")).alias("part"), "size_bytes", "revision", F.coalesce("is_deleted", F.lit(False)).alias("gone"), "loaded_at").where("part is not null").distinct()
    keys = ["file_key", "part"]
    base = relational.first_by(rows.where("revision = 1").withColumn("row", F.struct("loaded_at", "size_bytes")), keys, "row", "row").select(*keys, F.col("row.size_bytes").alias("size_bytes"))
    later = current_rows(rows.where("revision > 1"), keys, "revision", ["loaded_at", "size_bytes"])
    patched = relational.patch_parts(base, later.where("not gone").select(*keys, "size_bytes"), later.where("gone").select(*keys), keys, "size_bytes")
    return patched.select("file_key", "part", F.coalesce("size_bytes", F.lit(-1)).cast("bigint").alias("size_bytes"), "origin")


def merge_upsert(spark, folder):
    """First revisions of styles against current ones: skip, replace or insert."""
    keys = ["template_key", "style_id"]
    first = table(spark, folder, "style_defs").where("revision = 1 and trim(style_id) <> ''").select("template_key", F.trim("style_id").alias("style_id"), F.coalesce("ppr", F.lit("")).alias("ppr"))
    first = first.groupBy(*keys).agg(F.max("ppr").alias("ppr"))
    now = styles(spark, folder).select(*keys, F.coalesce("ppr", F.lit("")).alias("ppr"))
    return relational.upsert_actions(first, now, keys, "ppr")


def upsert_result(spark, folder):
    keys = ["template_key", "style_id"]
    first = table(spark, folder, "style_defs").where("revision = 1 and trim(style_id) <> ''").select("template_key", F.trim("style_id").alias("style_id"), F.coalesce("ppr", F.lit("")).alias("ppr")).groupBy(*keys).agg(F.max("ppr").alias("ppr"))
    return relational.upsert(first, styles(spark, folder).select(*keys, F.coalesce("ppr", F.lit("")).alias("ppr")), keys)


def bag_containment(spark, folder):
    """Lines of one source that occur more often there than in all others."""
    rows = lines(spark, folder).where("line <> ''")
    return relational.missing_from_bag(rows.where("source = 'harbor_specs'").select("line"), rows.where("source <> 'harbor_specs'").select("line"), ["line"])


def except_all(spark, folder):
    rows = lines(spark, folder).where("line <> ''")
    return rows.where("lang = 'en'").select("line").exceptAll(rows.where("coalesce(lang, '') <> 'en'").select("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def set_symmetric_diff(spark, folder):
    """Header and footer parts that only the entries or only the parts of a package name."""
    entries = table(spark, folder, "hf_entries").select("file_key", part_key(F.col("part_name")).alias("part")).where("file_key is not null and part is not null")
    parts = table(spark, folder, "package_parts").select("file_key", part_key(F.col("part_name")).alias("part")).where(F.col("part").rlike(r"^word/(header|footer)[^/]*\.xml$"))
    return relational.symmetric_difference(entries, parts, ["file_key", "part"])


def hash_diff(spark, folder):
    """First against current content hash of each style's layout: added, removed, changed."""
    keys = ["template_key", "style_id"]
    first = table(spark, folder, "style_defs").where("revision = 1 and trim(style_id) <> ''").select("template_key", F.trim("style_id").alias("style_id"), F.coalesce("ppr", F.lit("")).alias("ppr")).groupBy(*keys).agg(ids.sha256(F.max("ppr")).alias("digest"))
    now = styles(spark, folder).select(*keys, ids.sha256(F.coalesce("ppr", F.lit(""))).alias("digest"))
    return relational.compare_maps(first, now, keys, "digest")


def substring_theta(spark, folder):
    """Footers and headers that contain a heading of their package: the form of best priority wins."""
    heads = bundle_rows(spark, folder).where(F.col("text").rlike(text.ARTICLE)).select("file_key", F.regexp_replace("text", r"^\s*[0-9]+\.[0-9]{2}\s+", "").alias("head")).distinct()
    forms = heads.select("file_key", F.posexplode(F.array(F.col("head"), F.initcap("head"), F.lower("head"))).alias("priority", "form")).where("form <> ''")
    entries = table(spark, folder, "hf_entries").where("xml is not null").select("entry_id", "file_key", "xml").distinct()
    hits = entries.join(forms, "file_key").where(F.contains("xml", F.col("form")))
    return hits.groupBy("entry_id").agg(F.min_by("form", F.struct("priority", "form")).alias("form"))


def role_counts_by_template(spark, folder):
    return deterministic(spark, folder).groupBy("template_key", "csi_role").agg(F.count(F.lit(1)).alias("n"))


def coverage(spark, folder):
    """Share of each file's rows outside tables that rules classify, in basis points."""
    expected = bundle_rows(spark, folder).where("not in_table").select("file_key", "idx")
    return relational.coverage(expected, deterministic(spark, folder), ["file_key", "idx"], ["file_key"])


def max_ids(spark, folder):
    """Greatest relationship number per package, 0 where no entry has one."""
    rows = table(spark, folder, "hf_entries").select("file_key", F.regexp_extract("rid", "^rId([0-9]+)$", 1).alias("n"))
    have = rows.where("n <> ''").groupBy("file_key").agg(F.max(F.col("n").cast("bigint")).alias("m"))
    return table(spark, folder, "packages").select("file_key").join(have, "file_key", "left").select("file_key", F.coalesce("m", F.lit(0)).cast("bigint").alias("max_id"))


def alloc_ids(spark, folder):
    """New keys for suppliers behind the parts' keys, in supplier order."""
    return relational.allocate_ids(table(spark, folder, "supplier").select("s_suppkey"), table(spark, folder, "part"), "s_suppkey", "p_partkey", -1).select("s_suppkey", "new_id")


def duplicates(spark, folder):
    rows = table(spark, folder, "style_defs").select("template_key", F.trim("style_id").alias("style_id"), "revision").where("style_id <> ''")
    return relational.duplicates(rows, ["template_key", "style_id", "revision"])


def merge_conflicts(spark, folder):
    """Styles whose paragraph layout differs between their rows."""
    rows = table(spark, folder, "style_defs").where("trim(style_id) <> ''").select("template_key", F.trim("style_id").alias("style_id"), "ppr")
    return relational.conflicts(rows, ["template_key", "style_id"], "ppr")


def first_per_role(spark, folder):
    """First text of each role in a file, with its title form."""
    rows = deterministic(spark, folder).join(bundle_rows(spark, folder).select("file_key", "idx", "text"), ["file_key", "idx"]).where("text is not null")
    return relational.first_by(rows, ["file_key", "csi_role"], "text", "idx")


def first_last_revision(spark, folder):
    rows = table(spark, folder, "style_defs").where("trim(style_id) <> '' and revision is not null").select("template_key", F.trim("style_id").alias("style_id"), "revision", F.coalesce("ui_priority", F.lit(-1)).alias("p"))
    rows = rows.withColumn("row", F.struct("revision", "p"))
    return rows.groupBy("template_key", "style_id").agg(F.min("row").alias("a"), F.max("row").alias("b")).select("template_key", "style_id", F.col("a.p").cast("bigint").alias("first_priority"), F.col("b.p").cast("bigint").alias("last_priority"))


def missing_preview(spark, folder):
    docs, done = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "doc_labels").select("doc_id")
    return relational.preview_missing(docs, done, ["doc_id"], 20)


_ORDER = ["A", "F", "N", "O", "R"]


def canonical_order(spark, folder):
    """Status letters of an order put among its return flags in canonical order."""
    held = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("a"), F.array_sort(F.collect_set("l_linestatus")).alias("b"))
    as_elements = lambda c: F.transform(c, lambda t: F.struct(t.alias("tag"), t.alias("xml")))
    put = relational.insert_in_order(as_elements("a"), as_elements("b"), _ORDER)
    return held.select("l_orderkey", F.array_join(F.transform(put, lambda e: e["tag"]), "").alias("letters"))


def dep_closure(spark, folder):
    """Everything any current style of a template needs over based_on, link and next."""
    now = styles(spark, folder)
    seeds = now.select("template_key", F.col("style_id").alias("seed"))
    return closure.dependency_closure(seeds, closure.style_edges(now, ["template_key"]), ["template_key"]).select("template_key", "seed", "id")


def inherited_attr(spark, folder):
    """Size and paragraph layout of each style, each resolved on its own over at most 50 ancestors."""
    now = styles(spark, folder).select("template_key", F.col("style_id").alias("id"), F.col("based_on").alias("parent"), "rpr", "ppr")
    got = closure.nearest_ancestor(now, ["template_key"], ["rpr", "ppr"])
    return got.select("template_key", "id", F.coalesce("rpr", F.lit("default")).alias("rpr"), F.coalesce("ppr", F.lit("default")).alias("ppr"), F.coalesce("rpr_depth", F.lit(-1)).cast("bigint").alias("rpr_depth"))


def preflight_violations(spark, folder):
    """All problems of the style catalogue at once: duplicate ids, unknown templates, unresolved references, bad fragments."""
    raw = table(spark, folder, "style_defs").select("template_key", F.trim("style_id").alias("style_id"), "ppr").distinct()
    now = styles(spark, folder)
    no_id = raw.where("coalesce(style_id, '') = ''").select("template_key", F.lit("").alias("item"), F.lit("no_id").alias("rule"))
    unknown = now.join(table(spark, folder, "templates").select("template_key"), "template_key", "left_anti").select("template_key", F.col("style_id").alias("item"), F.lit("unknown_template").alias("rule"))
    targets = now.select("template_key", F.col("style_id").alias("dst"))
    dangling = closure.style_edges(now, ["template_key"]).join(targets, ["template_key", "dst"], "left_anti").select("template_key", F.concat_ws(">", "src", "dst").alias("item"), F.concat(F.lit("dangling_"), "kind").alias("rule"))
    case_twins = now.groupBy("template_key", F.lower("style_id").alias("item")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("template_key", "item", F.lit("case_twin").alias("rule"))
    return no_id.unionByName(unknown).unionByName(dangling).unionByName(case_twins).groupBy("template_key", "item", "rule").agg(F.count(F.lit(1)).alias("n"))


def stub_classify(spark, folder):
    """The offline classifier on all rows that rules leave open."""
    rows = unresolved_filter(spark, folder).join(bundle_rows(spark, folder).select("file_key", "idx", "text"), ["file_key", "idx"])
    return classify.classify(rows, ["file_key", "idx"], text.ROLES)


_OPEN = f"{ROWS}, {_FIXED}, open_ as (select r.file_key, r.idx, r.text from rows_ r where not in_table and not exists (select 1 from fixed f where f.file_key = r.file_key and f.idx = r.idx))"
_STUB = "case when length(coalesce(text, '')) > 60 and text like '%.' then 'PARAGRAPH' when contains(coalesce(text, ''), ':') then 'ARTICLE' else 'SUBPARAGRAPH' end"


def final_merge(spark, folder):
    """Payloads of three kinds by library: the open rows only, all rows, and all rows with some fixed ones changed."""
    keys = ["file_key", "idx"]
    fixed = deterministic(spark, folder).groupBy(*keys).agg(F.min("csi_role").alias("csi_role"))
    open_rows = unresolved_filter(spark, folder)
    library = table(spark, folder, "slim_bundle").groupBy("file_key").agg(F.min("library_code").alias("library"))
    changed = F.when((F.col("library") >= "LB-27") & (F.col("csi_role") == "PART"), "ARTICLE").otherwise(F.col("csi_role"))
    whole = fixed.join(library, "file_key").where("library >= 'LB-14'").select(*keys, changed.alias("csi_role"))
    rows = classify.final_classifications(fixed, stub_classify(spark, folder).unionByName(whole), open_rows, keys, ["file_key"])
    return rows.select("file_key", "idx", "csi_role", "mode", "status")


def payload_checks(spark, folder):
    """Violations of a payload in which one label is unknown and some documents are not classifiable or come twice."""
    payload = table(spark, folder, "doc_labels").select("doc_id", F.col("label").alias("csi_role"))
    allowed = table(spark, folder, "documents").where("lang = 'en'").select("doc_id")
    return classify.payload_violations(payload, allowed, ["doc_id"], ["prose", "list", "table"])


def chunk_merge(spark, folder):
    """Overlapping chunks classified apart and merged without conflict."""
    rows = bundle_rows(spark, folder).select("file_key", "idx", "text")
    chunks = context.overlapping_chunks(rows, ["file_key"], "idx", 50).select("file_key", "idx", "chunk", "text")
    labelled = classify.classify(chunks, ["file_key", "idx", "chunk"], text.ROLES)
    return classify.merge_chunks(labelled, ["file_key", "idx"])


def batch_summary(spark, folder):
    """Deliveries and failures (no paragraphs) per library, with the latest receipt."""
    rows = table(spark, folder, "slim_bundle").withColumn("ok", F.size("paragraphs") > 0)
    return rows.groupBy("library_code").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.max("received_at").alias("latest"))


def roles_of_registry(spark, folder):
    """Distinct available roles per template, sorted."""
    return table(spark, folder, "slim_bundle").select("template_key", F.explode("available_roles").alias("r")).groupBy("template_key").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("roles"))


def tag_dedupe(spark, folder):
    """Tags of stripped paragraphs in first-seen order."""
    rows = table(spark, folder, "slim_bundle").select("file_key", F.explode("filter_report.paragraphs_stripped").alias("s"))
    return rows.select("file_key", F.col("s.paragraph_index").cast("bigint").alias("idx"), F.array_join(F.array_distinct("s.tags"), ",").alias("tags")).distinct()


def revenue_rollup(spark, folder):
    """Plain aggregation over the large fact table."""
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("latest"))


def request_messages(spark, folder):
    """Requests for the rows that rules leave open, with their texts, in chunks of the production limits."""
    rows = unresolved_filter(spark, folder).join(bundle_rows(spark, folder).select("file_key", "idx", "text"), ["file_key", "idx"]).select("file_key", F.col("idx").cast("int").alias("paragraph_index"), "text")
    requests = batches.build_requests(batches.chunked(rows), "Classify.", text.ROLES, 10**9)
    asked = F.size(F.regexp_extract_all("message", F.lit('"paragraph_index":([0-9]+)'), F.lit(1)))
    return requests.select("custom_id", F.col("chunk").cast("bigint").alias("chunk"), asked.cast("bigint").alias("n_rows"))


def answers(spark, folder):
    """Stored classifications parsed back from JSON, fenced or not."""
    fixed = deterministic(spark, folder).groupBy("file_key", F.col("idx").cast("int").alias("paragraph_index")).agg(F.min("csi_role").alias("csi_role"))
    stored = batches.classification_json(fixed).select("file_key", batches.answer(F.concat(F.lit("```json\n"), "json", F.lit("\n```"))).alias("a"))
    return stored.select("file_key", F.inline("a.classifications")).select("file_key", F.col("paragraph_index").cast("bigint").alias("idx"), "csi_role")


def hourly_events(spark, folder):
    """The streaming extension's window counts on the batch table."""
    return packages.windowed_counts(table(spark, folder, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        unresolved_filter, role_lookup, unmapped_roles, used_styles, fk_violations, range_containment, two_hop, style_numbering_hop, positional_fill, package_patch, merge_upsert, upsert_result,
        bag_containment, except_all, set_symmetric_diff, hash_diff, substring_theta, role_counts_by_template, coverage, max_ids, alloc_ids, duplicates, merge_conflicts, first_per_role,
        first_last_revision, missing_preview, canonical_order, dep_closure, inherited_attr, preflight_violations, stub_classify, final_merge, payload_checks, chunk_merge, batch_summary,
        roles_of_registry, tag_dedupe, revenue_rollup, request_messages, answers, hourly_events,
    )
}

_FIRST = "first_ as (select template_key, trim(style_id) as style_id, max(coalesce(ppr, '')) as ppr from style_defs where revision = 1 and trim(style_id) <> '' group by all)"
_PART = "nullif(trim(regexp_replace(trim(part_name), '^(\\./|/)', '')), '')"
_EDGES = "edges as (select template_key, style_id as src, kind, dst from (select template_key, style_id, unnest(['based_on', 'link', 'next']) as kind, unnest([based_on, link, next]) as dst from styles) where dst is not null)"
ORACLES = {
    "unresolved_filter": f"with {_OPEN} select file_key, idx from open_",
    "role_lookup": f"with {_FIXED}, {_ROLE_SQL} select csi_role, stem, count(*) as n from fixed join roles using (csi_role) group by all",
    "unmapped_roles": f"with {_FIXED}, {_ROLE_SQL} select csi_role, count(*) as n from fixed where csi_role not in (select csi_role from roles) group by all",
    "used_styles": f"with {_FIXED}, {_ROLE_SQL}, {_STYLES} select distinct file_key, template_key, stem from fixed join roles using (csi_role) where exists (select 1 from styles s where s.template_key = fixed.template_key and regexp_replace(s.style_id, '[0-9]+$', '') = roles.stem)",
    "fk_violations": "select l_partkey, count(*) as n_lines, count(distinct l_orderkey) as n_orders from lineitem where l_partkey not in (select p_partkey from part where p_size <= 25) group by all",
    "range_containment": f"with {ROWS}, {_FIXED}, r as (select file_key, min(idx) as a, max(idx) as b from rows_ where in_table group by all) select file_key, idx, csi_role from fixed join r using (file_key) where idx between a and b",
    "two_hop": "select r_name, n_name, count(*) as n_customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
    "style_numbering_hop": f"with {_STYLES} select a.template_key, a.style_id, a.link, b.based_on as second from styles a join styles b on b.template_key = a.template_key and b.style_id = a.link where b.based_on is not null",
    "positional_fill": """with s as (select s_suppkey, s_nationkey || '-' || (row_number() over (partition by s_nationkey order by s_suppkey) - 1) as slot from supplier),
c as (select c_name, c_nationkey || '-' || (row_number() over (partition by c_nationkey order by c_custkey) - 1) as slot from customer where c_acctbal > 9000)
select s_suppkey, s.slot, coalesce(c_name, 'default') as value from s left join c on c.slot = s.slot""",
    "package_patch": f"""with p as (select distinct file_key, {_PART} as part, size_bytes, revision, coalesce(is_deleted, false) as gone, loaded_at from package_parts where {_PART} is not null),
base as (select file_key, part, arg_min(struct_pack(s := size_bytes), struct_pack(t := loaded_at, s := coalesce(size_bytes, -1))).s as size_bytes from p where revision = 1 group by all),
later as (select file_key, part, arg_max(struct_pack(g := gone, s := size_bytes), struct_pack(r := revision, t := loaded_at, s := coalesce(size_bytes, -1))) as l from p where revision > 1 group by all)
select coalesce(b.file_key, l.file_key) as file_key, coalesce(b.part, l.part) as part, coalesce(case when l.part is not null then l.l.s else b.size_bytes end, -1)::bigint as size_bytes,
  case when l.part is null then 'base' when b.part is null then 'new' else 'replaced' end as origin
from base b full join later l on l.file_key = b.file_key and l.part = b.part where not coalesce(l.l.g, false)""",
    "merge_upsert": f"with {_STYLES}, {_FIRST} select s.template_key, s.style_id, coalesce(s.ppr, '') as ppr, case when f.style_id is null then 'insert' when f.ppr = coalesce(s.ppr, '') then 'skip' else 'replace' end as action from styles s left join first_ f on f.template_key = s.template_key and f.style_id = s.style_id",
    "upsert_result": f"with {_STYLES}, {_FIRST} select template_key, style_id, coalesce(ppr, '') as ppr from styles union all select * from first_ f where not exists (select 1 from styles s where s.template_key = f.template_key and s.style_id = f.style_id)",
    "bag_containment": f"with {LINES}, c as (select line, count(*) filter (where source = 'harbor_specs') as before_n, count(*) filter (where source <> 'harbor_specs') as after_n from lines where line <> '' group by all) select * from c where after_n < before_n",
    "except_all": f"with {LINES} select line, count(*) as n from (select line from lines where line <> '' and lang = 'en' except all select line from lines where line <> '' and coalesce(lang, '') <> 'en') group by all",
    "set_symmetric_diff": f"""with a as (select file_key, {_PART} as part from hf_entries where file_key is not null and {_PART} is not null), b as (select file_key, {_PART} as part from package_parts where regexp_matches({_PART}, '^word/(header|footer)[^/]*\\.xml$'))
select *, 'left' as side from (select * from a except select * from b) union all select *, 'right' from (select * from b except select * from a)""",
    "hash_diff": f"""with {_STYLES}, {_FIRST} select coalesce(f.template_key, s.template_key) as template_key, coalesce(f.style_id, s.style_id) as style_id, sha256(f.ppr) as before, case when s.style_id is not null then sha256(coalesce(s.ppr, '')) end as after,
  case when f.style_id is null then 'added' when s.style_id is null then 'removed' else 'changed' end as change
from first_ f full join styles s on f.template_key = s.template_key and f.style_id = s.style_id where f.style_id is null or s.style_id is null or f.ppr <> coalesce(s.ppr, '')""",
    "substring_theta": f"""with {ROWS}, heads as (select distinct file_key, regexp_replace(text, '^\\s*[0-9]+\\.[0-9]{{2}}\\s+', '') as head from rows_ where regexp_matches(text, '^\\s*[0-9]+\\.[0-9]{{2}}([^0-9A-Za-z_]|$)')),
forms as (select file_key, 0 as priority, head as form from heads union all select file_key, 1, array_to_string(list_transform(string_split(lower(head), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') from heads union all select file_key, 2, lower(head) from heads),
e as (select distinct entry_id, file_key, xml from hf_entries where xml is not null)
select entry_id, arg_min(form, struct_pack(p := priority, f := form)) as form from e join forms using (file_key) where form <> '' and contains(xml, form) group by all""",
    "role_counts_by_template": f"with {_FIXED} select template_key, csi_role, count(*) as n from fixed group by all",
    "coverage": f"""with {ROWS}, {_FIXED}, d as (select distinct file_key, idx from fixed), c as (
  select r.file_key, count(*) as n_expected, count(d.idx) as n_done from rows_ r left join d on d.file_key = r.file_key and d.idx = r.idx where not in_table group by all)
select *, floor(n_done * 10000 / n_expected)::bigint as basis_points from c""",
    "max_ids": "select p.file_key, coalesce(max(nullif(regexp_extract(rid, '^rId([0-9]+)$', 1), '')::bigint), 0)::bigint as max_id from packages p left join hf_entries h on h.file_key = p.file_key group by all",
    "alloc_ids": "select s_suppkey, ((select max(p_partkey) from part) + row_number() over (order by s_suppkey))::bigint as new_id from supplier",
    "duplicates": "select template_key, trim(style_id) as style_id, revision, count(*) as n from style_defs where trim(style_id) <> '' group by all having count(*) > 1",
    "merge_conflicts": "select template_key, trim(style_id) as style_id, count(distinct ppr) as n_values, min(ppr) as least, max(ppr) as greatest from style_defs where trim(style_id) <> '' group by all having count(distinct ppr) > 1",
    "first_per_role": f"with {ROWS}, {_FIXED} select file_key, csi_role, arg_min(text, idx) as text from fixed join rows_ using (file_key, idx) where text is not null group by all",
    "first_last_revision": """with r as (select template_key, trim(style_id) as style_id, revision, coalesce(ui_priority, -1) as p from style_defs where trim(style_id) <> '' and revision is not null)
select template_key, style_id, arg_min(p, struct_pack(r := revision, p := p))::bigint as first_priority, arg_max(p, struct_pack(r := revision, p := p))::bigint as last_priority from r group by all""",
    "missing_preview": "select doc_id from documents where doc_id not in (select doc_id from doc_labels) order by doc_id limit 20",
    "canonical_order": "select l_orderkey, array_to_string(list_sort(list_concat(list_distinct(list(l_returnflag)), list_distinct(list(l_linestatus)))), '') as letters from lineitem group by all",
    "dep_closure": f"with recursive {_STYLES}, {_EDGES}, reach as (select template_key, style_id as seed, style_id as id from styles union select r.template_key, r.seed, e.dst from reach r join edges e on e.template_key = r.template_key and e.src = r.id) select template_key, seed, id from reach",
    "inherited_attr": f"""with recursive {_STYLES}, up as (
  select template_key, style_id as id, based_on as anc, rpr, ppr, 0::bigint as hop from styles
  union all select u.template_key, u.id, s.based_on, s.rpr, s.ppr, u.hop + 1 from up u join styles s on s.template_key = u.template_key and s.style_id = u.anc where u.hop < 49)
select template_key, id, coalesce(arg_min(rpr, hop) filter (where rpr is not null), 'default') as rpr, coalesce(arg_min(ppr, hop) filter (where ppr is not null), 'default') as ppr, coalesce(min(hop) filter (where rpr is not null), -1)::bigint as rpr_depth from up group by all""",
    "preflight_violations": f"""with {_STYLES}, {_EDGES}, raw as (select distinct template_key, trim(style_id) as style_id, ppr from style_defs), v as (
  select template_key, '' as item, 'no_id' as rule from raw where coalesce(style_id, '') = ''
  union all select template_key, style_id, 'unknown_template' from styles where template_key not in (select template_key from templates)
  union all select template_key, src || '>' || dst, 'dangling_' || kind from edges e where not exists (select 1 from styles s where s.template_key = e.template_key and s.style_id = e.dst)
  union all select template_key, lower(style_id), 'case_twin' from styles group by all having count(*) > 1)
select template_key, item, rule, count(*) as n from v group by all""",
    "stub_classify": f"with {_OPEN} select file_key, idx, {_STUB} as csi_role from open_",
    "final_merge": f"""with {_OPEN}, lib as (select file_key, min(library_code) as library from slim_bundle group by all), f as (select file_key, idx, min(csi_role) as role from fixed group by all),
w as (select *, library >= 'LB-14' as total, library >= 'LB-27' and role = 'PART' as over_ from f join lib using (file_key)), t as (select file_key, bool_or(coalesce(total, false)) as total from w group by all)
select file_key, idx, case when over_ then 'ARTICLE' else role end as csi_role, case when total then 'total' else 'merged' end as mode, case when over_ then 'override' else 'ok' end as status from w
union all select o.file_key, idx, {_STUB}, case when coalesce(total, false) then 'total' else 'merged' end, 'ok' from open_ o left join t using (file_key)""",
    "payload_checks": """select doc_id, 'duplicate' as rule from doc_labels group by doc_id having count(*) > 1
union all select doc_id, 'not_classifiable' from doc_labels where doc_id not in (select doc_id from documents where lang = 'en')
union all select doc_id, 'bad_role' from doc_labels where label not in ('prose', 'list', 'table')""",
    "chunk_merge": f"with {ROWS} select file_key, idx, {_STUB} as csi_role from rows_",
    "batch_summary": "select library_code, count(*) as n, count(*) filter (where len(paragraphs) > 0) as n_ok, max(received_at) as latest from slim_bundle group by all",
    "roles_of_registry": "select template_key, array_to_string(list_sort(list_distinct(flatten(list(available_roles)))), ',') as roles from slim_bundle group by all having len(flatten(list(available_roles))) > 0",
    "tag_dedupe": """with s as (select file_key, unnest(filter_report.paragraphs_stripped) as s from slim_bundle),
t as (select file_key, s.paragraph_index::bigint as idx, s.tags as tags, unnest(generate_series(1, greatest(1, len(s.tags)))) as i from s)
select distinct file_key, idx, array_to_string(list_filter(tags, lambda x, j: list_position(tags, x) = j), ',') as tags from t""",
    "request_messages": f"""with {_OPEN}, r as (select file_key, idx, length(case when text is null then '{{"paragraph_index":' || idx || '}}' else '{{"paragraph_index":' || idx || ',"text":' || to_json(text) || '}}' end) as n_chars from open_),
s as (select file_key, sum(n_chars) + 200 as chars, count(*) as n from r group by all),
z as (select file_key, n, case when chars <= 320000 and n <= 300 then n else greatest(10, floor(319800 / greatest((chars - 200) / greatest(n, 1), 1.0)))::bigint end as size from s),
c as (select r.file_key, n, size, case when size >= n then greatest(size, 1) else size - 20 end as step, row_number() over (partition by r.file_key order by idx) as rn from r join z using (file_key)),
k as (select file_key, unnest(generate_series(greatest(0, ceil((rn - size) / step::double))::bigint, least(floor((rn - 1) / step::double), greatest(0, ceil((n - size) / step::double)))::bigint)) as chunk from c)
select file_key || '__chunk' || chunk as custom_id, chunk, count(*) as n_rows from k group by all""",
    "answers": f"with {_FIXED} select file_key, idx, min(csi_role) as csi_role from fixed group by all",
    "hourly_events": "select date_trunc('hour', ts)::timestamp as start, event_type, count(*) as n from events group by all",
    "revenue_rollup": "select l_returnflag, l_linestatus, sum(l_quantity::decimal(18,2))::double as sum_qty, count(*) as n, max(l_shipdate) as latest from lineitem group by all",
}
ORACLES = {name: blank_trim(sql) for name, sql in ORACLES.items()}
