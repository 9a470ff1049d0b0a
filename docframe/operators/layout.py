"""Page layout of sections: which template section each section of a document takes, and the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import edit


def section_sources(targets: DataFrame, chains: DataFrame, defaults: DataFrame) -> DataFrame:
    """``file_key, pos, source``: the template section for each section of a document, by position.

    ``targets(file_key, template_key, pos, ...)``, ``chains(template_key, pos, source)``,
    ``defaults(template_key, source)``. Positions past the chain take the default, or a null source if the
    template has none; :func:`section_violations` names those documents.
    """
    chain = chains.select("template_key", "pos", F.col("source").alias("__own"))
    default = defaults.select("template_key", F.col("source").alias("__default"))
    rows = targets.select("file_key", "template_key", "pos").join(chain, ["template_key", "pos"], "left").join(default, "template_key", "left")
    return rows.select("file_key", "pos", F.coalesce("__own", "__default").alias("source"))


def section_violations(targets: DataFrame, chains: DataFrame, defaults: DataFrame) -> DataFrame:
    """``file_key, n_sections, n_chain`` of documents whose number of sections differs from their template's, which has no default."""
    counts = targets.groupBy("file_key", "template_key").agg(F.count(F.lit(1)).alias("n_sections"))
    lengths = chains.groupBy("template_key").agg(F.count(F.lit(1)).alias("n_chain"))
    rows = counts.join(defaults.select("template_key"), "template_key", "left_anti").join(lengths, "template_key", "left").withColumn("n_chain", F.coalesce("n_chain", F.lit(0)))
    return rows.where("n_sections <> n_chain").select("file_key", "n_sections", F.col("n_chain").cast("bigint").alias("n_chain"))


def merged_sections(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """``file_key, pos, xml``: the sections of ``targets(file_key, pos, xml)`` with the managed properties of their source."""
    rows = targets.select("file_key", "pos", "xml").join(sources, ["file_key", "pos"])
    merge = edit.column(edit.merge_section, 2)
    return rows.select("file_key", "pos", F.when(F.col("source").isNull(), F.col("xml")).otherwise(merge("xml", F.coalesce("source", F.lit("")))).alias("xml"))
