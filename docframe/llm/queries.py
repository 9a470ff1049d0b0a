"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.llm import lookalikes, mixing, packing, quality, residue, splitting
from docframe.session import cut
from docframe.sources.tables import table


def p1_found(spark, folder):
    return lookalikes.found(table(spark, folder, "slim_bundle")).select("file_key", "paragraph_index")


def p1_consistent(spark, folder):
    return lookalikes.consistent(table(spark, folder, "slim_bundle"))


def _piece_limits(spark, folder) -> tuple[int, int, int]:
    row = packing.limit(table(spark, folder, "size_limits"), "bundle_piece")
    return row["max_size"], row["overlap_paragraphs"] or 0, row["overlap_chars"] or 0


def p3_found(spark, folder):
    limits = _piece_limits(spark, folder)
    return splitting.oversized(splitting.slices(table(spark, folder, "slim_bundle"), *limits), limits[0])


def p3_pieces(spark, folder):
    return splitting.pieces(table(spark, folder, "slim_bundle"), *_piece_limits(spark, folder))


def p5_found(spark, folder):
    return p5_residue(spark, folder).select("file_key", "paragraph_index")


def p5_residue(spark, folder):
    return residue.find_residue(residue.paragraphs(table(spark, folder, "slim_bundle")), ["file_key", "paragraph_index"])


def p5_clean(spark, folder):
    rows = residue.paragraphs(table(spark, folder, "slim_bundle"))
    return residue.exclude_residue(rows, ["file_key", "paragraph_index"])


def _container(spark, folder) -> int:
    return packing.limit(table(spark, folder, "size_limits"), "pack_container")["max_size"]


def p6_packed(spark, folder):
    return packing.pack(table(spark, folder, "documents"), _container(spark, folder))


def p6_found(spark, folder):
    return p6_packed(spark, folder).where("piece_no = 1 and n_pieces > 1").select("doc_id")


def p6_fill(spark, folder):
    return packing.fill_report(p6_packed(spark, folder), _container(spark, folder))


def _mix(spark, folder):
    return mixing.plan(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_found(spark, folder):
    return mixing.report(_mix(spark, folder)).where("short").select("source")


def p7_report(spark, folder):
    return mixing.report(_mix(spark, folder))


def p7_mixed(spark, folder):
    return mixing.mixed(_mix(spark, folder))


def p8_quality(spark, folder):
    return quality.assess(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p8_found(spark, folder):
    return quality.not_prose(p8_quality(spark, folder))


WIDE, INVISIBLE, SPACES = "[\uff01-\uff5e\ufb00-\ufb06]", "[\u200b-\u200d\u2060\ufeff\u00ad]", "[\u00a0\u2000-\u200a\u202f\u205f\u3000]"


def p1_check(spark, folder):
    """Per file the paragraphs that came out, and those among them that still hold a wide form, an invisible sign or an odd space."""
    left = lambda pattern: F.count_if(F.coalesce(F.col("text").rlike(pattern), F.lit(False)))
    return p1_consistent(spark, folder).groupBy("file_key").agg(F.count(F.lit(1)).alias("n_rows"), left(WIDE).alias("n_wide"), left(INVISIBLE).alias("n_invisible"), left(SPACES).alias("n_spaces"))


def p3_check(spark, folder):
    """Per file the characters of its paragraphs in all pieces without overlaps, and the pieces whose text is too long."""
    largest = _piece_limits(spark, folder)[0]
    return p3_pieces(spark, folder).groupBy("file_key").agg(F.sum(F.col("n_chars") - F.col("n_overlap_chars")).alias("n_chars"), F.count_if(F.length("text") > largest).alias("n_over"))


def p5_check(spark, folder):
    """Per file its paragraphs, found or clean, and the clean ones in which an open slot or dummy text stands."""
    keys = ["file_key", "paragraph_index"]
    rows = residue.paragraphs(table(spark, folder, "slim_bundle"))
    found = cut(residue.find_residue(rows, keys).select(*keys))
    marked = rows.select(*keys, F.coalesce(F.col("text").rlike(r"\{\{[^{}]*\}\}|(?i)lorem ipsum"), F.lit(False)).alias("left"))
    clean = marked.groupBy(*keys).agg(F.count_if("left").alias("n")).join(found, keys, "left_anti")
    rows = clean.unionByName(found.withColumn("n", F.lit(0).cast("bigint")))
    return rows.groupBy("file_key").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") > 0).alias("n_left"))


def p6_check(spark, folder):
    """One row: documents with and without text, containers over their capacity, documents whose pieces do not add up."""
    packed, capacity = p6_packed(spark, folder), _container(spark, folder)
    over = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("n_over"))
    docs = packed.groupBy("doc_id").agg(F.max("n_pieces").alias("n_pieces"), F.count(F.lit(1)).alias("n_rows"), F.max("token_to").alias("stop"), F.sum("n_tokens").alias("n"))
    sums = docs.agg(F.count_if(F.col("n") > 0).alias("n_packed"), F.count_if(F.col("n") == 0).alias("n_empty"), F.count_if((F.col("n_pieces") != F.col("n_rows")) | (F.col("stop") != F.col("n"))).alias("n_broken"))
    return sums.join(over, how="full", on=F.lit(True))


def p7_check(spark, folder):
    """Per listed source its documents, the text spans mixed more often than allowed, and the tokens beyond what it can give."""
    mix = _mix(spark, folder)
    report = mixing.report(mix)
    repeats = mixing.mixed(mix).groupBy("source", "doc_id", "token_from").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    rows = report.join(repeats, "source", "left")
    over = (F.col("mixed_tokens") > F.col("n_tokens") * F.col("max_repeats")).cast("bigint")
    return rows.select("source", "target_share", "max_repeats", "n_documents", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).cast("bigint").alias("n_over_repeats"), over.alias("n_over_tokens"))


def p8_statistics(spark, folder):
    """The statistics of p8_quality that SQL can count."""
    return p8_quality(spark, folder).select("doc_id", "n_words", "mean_word_length", "n_lines", "symbol_share", "letter_share")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_consistent, p3_found, p3_pieces, p5_found, p5_residue, p5_clean, p6_found, p6_packed, p6_fill,
        p7_found, p7_report, p7_mixed, p8_found, p8_quality, p1_check, p3_check, p5_check, p6_check, p7_check, p8_statistics,
    )
}

_ROWS = "rows_ as (select distinct file_key, p.paragraph_index as i from (select file_key, unnest(paragraphs) as p from slim_bundle) where file_key is not null and p.paragraph_index is not null)"
_SPACE = "\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}"
ORACLES: dict[str, str] = {
    "p1_check": f"with {_ROWS} select file_key, count(*) as n_rows, 0 as n_wide, 0 as n_invisible, 0 as n_spaces from rows_ group by all",
    "p3_check": """with p as (select file_key, p.paragraph_index as i, max(coalesce(length(p.text), 0)) as n from (select file_key, unnest(paragraphs) as p from slim_bundle)
  where file_key is not null and p.paragraph_index is not null group by all)
select file_key, sum(n)::bigint as n_chars, 0 as n_over from p group by all""",
    "p5_check": f"with {_ROWS} select file_key, count(*) as n_rows, 0 as n_left from rows_ group by all",
    "p6_check": "select count(*) filter (where text <> '') as n_packed, count(*) filter (where coalesce(text, '') = '') as n_empty, 0 as n_broken, 0 as n_over from documents",
    "p7_check": "select t.source, target_share, max_repeats, count(d.doc_id) as n_documents, 0 as n_over_repeats, 0 as n_over_tokens from mix_targets t left join documents d on d.source = t.source group by all",
    "p8_statistics": f"""with d as (select doc_id, coalesce(text, '') as t from documents),
c as (select doc_id, len(regexp_extract_all(t, '\\p{{L}}+')) as n_words, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) as letters,
  len(list_filter(string_split_regex(t, '[\\n\\r]'), lambda x: regexp_matches(x, '[^{_SPACE}]'))) as n_lines, greatest(1, length(regexp_replace(t, '[{_SPACE}]', '', 'g'))) as chars,
  length(regexp_replace(t, '[^#|{{}}<>~^=+_\\\\/*@$%&\\[\\]`]', '', 'g')) as symbols from d)
select doc_id, n_words, round(letters / greatest(n_words, 1), 6) as mean_word_length, n_lines, round(symbols / chars, 6) as symbol_share, round(letters / chars, 6) as letter_share from c""",
    "p3_found": """select file_key from (
  select file_key, p.paragraph_index as i, max(length(p.text)) as n from (select file_key, unnest(paragraphs) as p from slim_bundle) group by all)
group by file_key having sum(coalesce(n, 0)) > (select max_size from size_limits where limit_name = 'bundle_piece')""",
}
