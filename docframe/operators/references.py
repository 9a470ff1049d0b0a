"""References to records that do not exist, are deleted, or arrive later.

Distinct non-null foreign keys are left-anti-joined against the parent keys; the few orphan
keys are joined back to the referring rows. "Arrives later" is a comparison of the referring
row with its parent's earliest arrival: distinct (key, loaded_at) pairs are compared, so a key
that holds a third of all rows is reduced before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.operators.hierarchy import current_rows
from docframe.operators.skew import salted_lookup
from docframe.session import cut


def part_key(name: Column) -> Column:
    """A part name without surrounding blanks and one leading ``/`` or ``./``; blank gives null."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(name), r"^(\./|/)", "")), F.lit(""))


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``references`` whose target is missing, deleted or loaded later.

    ``references(src_table, owner_key, item_key, ref_field, target, loaded_at)``, one row per
    reference; ``parents(owner_key, target, is_deleted, first_loaded)``, unique on the key pair.
    A reference without ``loaded_at`` can only be missing or deleted. ``reason`` is missing,
    deleted or later.
    """
    references, parents = cut(references), cut(parents)
    keys = ["owner_key", "target"]
    asked = references.select(*keys).distinct()
    alive = parents.where(~F.col("is_deleted"))
    gone = asked.join(alive.select(*keys), keys, "left_anti")
    gone = gone.join(parents.where("is_deleted").select(*keys, F.lit("deleted").alias("reason")), keys, "left").select(
        *keys, F.coalesce("reason", F.lit("missing")).alias("reason")
    )
    late = (
        references.groupBy(*keys).agg(F.min("loaded_at").alias("first_use"))
        .join(alive.select(*keys, "first_loaded"), keys)
        .where(F.col("first_use") < F.col("first_loaded"))
        .select(*keys, "first_loaded")
    )
    bad = gone.withColumn("first_loaded", F.lit(None).cast("timestamp_ntz")).unionByName(late.withColumn("reason", F.lit("later")), allowMissingColumns=True)
    return (
        salted_lookup(references, bad, keys, how="inner")
        .where(F.col("first_loaded").isNull() | (F.col("loaded_at") < F.col("first_loaded")))
        .withColumn("period", F.date_format("loaded_at", "yyyy-MM"))
        .select("src_table", "owner_key", "item_key", "ref_field", "target", "reason", "period")
    )


def style_references(style_defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and parents of ``style_defs``; see :func:`orphan_references`.

    Only current rows refer; the earliest arrival of a target counts all its revisions.
    """
    rows = style_defs.select(
        F.col("template_key").alias("owner_key"),
        F.trim("style_id").alias("item_key"),
        *(F.expr(f"nullif(trim(`{c}`), '')").alias(c) for c in ("based_on", "next", "link")),
        F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"),
        "revision",
        "loaded_at",
    ).where("owner_key is not null and item_key <> ''")
    rank = F.struct(F.coalesce("revision", F.lit(-(2**31))).alias("r"), F.col("loaded_at"), F.col("is_deleted"), F.col("based_on"), F.col("next"), F.col("link"))
    now = rows.groupBy("owner_key", "item_key").agg(
        F.max_by(F.struct("based_on", "next", "link", "is_deleted", "loaded_at"), rank).alias("row"),
        F.min("loaded_at").alias("first_loaded"),
    )
    refs = (
        now.where("not row.is_deleted")
        .select(
            F.lit("style_defs").alias("src_table"),
            "owner_key",
            "item_key",
            F.expr("stack(3, 'based_on', row.based_on, 'next', row.next, 'link', row.link) as (ref_field, target)"),
            F.col("row.loaded_at").alias("loaded_at"),
        )
        .where("target is not null")
    )
    parents = now.select("owner_key", F.col("item_key").alias("target"), F.col("row.is_deleted").alias("is_deleted"), "first_loaded")
    return refs, parents


def part_references(hf_entries: DataFrame, package_parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of ``hf_entries`` to parts and the parts of ``package_parts``."""
    refs = hf_entries.select(
        F.lit("hf_entries").alias("src_table"),
        F.col("file_key").alias("owner_key"),
        F.col("entry_id").cast("string").alias("item_key"),
        F.lit("part_name").alias("ref_field"),
        part_key(F.col("part_name")).alias("target"),
        "loaded_at",
    ).where("target is not null and owner_key is not null").distinct()
    parts = package_parts.select(
        F.col("file_key").alias("owner_key"),
        part_key(F.col("part_name")).alias("target"),
        F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"),
        "revision",
        "loaded_at",
    ).where("owner_key is not null and target is not null")
    rank = F.struct(F.coalesce("revision", F.lit(-(2**31))).alias("r"), F.col("loaded_at"), F.col("is_deleted"))
    parents = parts.groupBy("owner_key", "target").agg(
        F.max_by("is_deleted", rank).alias("is_deleted"), F.min("loaded_at").alias("first_loaded")
    )
    return refs, parents


def orphans(style_defs: DataFrame, hf_entries: DataFrame, package_parts: DataFrame) -> DataFrame:
    """All orphan references of the three tables, one row each."""
    styles = orphan_references(*style_references(style_defs))
    parts = orphan_references(*part_references(hf_entries, package_parts))
    return styles.unionByName(parts)


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, field, reason and month."""
    return found.groupBy("src_table", "ref_field", "reason", "period").agg(
        F.count(F.lit(1)).alias("n_references"), F.count_distinct("owner_key").alias("n_owners")
    )
