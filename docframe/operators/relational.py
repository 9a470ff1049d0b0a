"""Joins, set operations, ranks and assertions that the document pipeline is made of.

Lookups against dimensions use plain joins: Spark broadcasts a side whose size it knows to be
small and shuffles otherwise. Sides that grow with the data are never hinted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.session import cut


def interval_semi_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str = "start", stop: str = "stop", block: int = 4096) -> DataFrame:
    """Points inside any range of their key group, each once; ranges are whole numbers, ``stop`` exclusive.

    Ranges are repeated once per block of positions they touch and points looked up in their block,
    so the join is an equi-join whose groups a large key cannot fill. Empty ranges hold nothing.
    """
    touched = F.explode(F.sequence(F.floor(F.col("__start") / block), F.floor((F.col("__stop") - 1) / block)))
    held = ranges.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(start).alias("__start"), F.col(stop).alias("__stop")).where("__start < __stop").withColumn("__block", touched)
    same = F.floor(F.col(at) / block) == F.col("__block")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return points.join(held, same & (F.col("__start") <= F.col(at)) & (F.col(at) < F.col("__stop")), "left_semi")


def positional_fill(targets: DataFrame, sources: DataFrame, default: Column, position: str = "pos", value: str = "value") -> DataFrame:
    """Each target with the source of the same position, or ``default`` past the end of the sources."""
    return targets.join(sources.select(position, value), position, "left").withColumn(value, F.coalesce(F.col(value), default))


def numbered(df: DataFrame, partition: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """0-based position within a partition.

    Rows are range-partitioned by key and order and ranked inside each range; ranges of one key are offset by the
    counts of those before, so no task holds all rows of a large key.
    """
    whose = [F.col(c) for c in partition]
    ranged = cut(df.repartitionByRange(*whose, *order).withColumn("__part", F.spark_partition_id()))  # written, so the numbers hold
    counts = ranged.groupBy(*partition, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*partition).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    bases = counts.select(*partition, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*partition, "__part").orderBy(*order)) - 1
    same = F.col("__part") == F.col("__other")
    for c in partition:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    bases = bases.select(*(F.col(c).alias(f"__k_{c}") for c in partition), F.col("__part").alias("__other"), "__base")
    ranked = ranged.withColumn("__rank", inside).join(bases, same)
    return ranked.select(*df.columns, (F.col("__base") + F.col("__rank")).cast("bigint").alias(name))


def compare_maps(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: keys whose value differs, with ``before``, ``after`` and ``change`` (added, removed, changed)."""
    left, right = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("__l")), after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("__r"))
    both = left.join(right, keys, "full_outer")
    change = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").otherwise("changed")
    return both.where(F.col("__l").isNull() | F.col("__r").isNull() | ~F.col("before").eqNullSafe(F.col("after"))).select(*keys, "before", "after", change.alias("change"))


def missing_from_bag(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Bag containment: keys that occur more often before than after, with both counts. Counts are pre-aggregated."""
    a = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("before_n"))
    b = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("after_n"))
    joined = a.join(b, keys, "left").withColumn("after_n", F.coalesce("after_n", F.lit(0)).cast("bigint"))
    return joined.where(F.col("after_n") < F.col("before_n"))


def symmetric_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with ``side``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def upsert_actions(target: DataFrame, source: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What a merge does with each source row: skip (equal), replace (other value) or insert (no target row)."""
    have = target.select(*keys, F.col(value).alias("__old"), F.lit(True).alias("__have"))
    action = F.when(F.col("__have").isNull(), "insert").when(F.col("__old").eqNullSafe(F.col(value)), "skip").otherwise("replace")
    return source.join(have, keys, "left").withColumn("action", action).drop("__old", "__have")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target after the merge: source rows win, other target rows stay."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))


def patch_parts(base: DataFrame, replacements: DataFrame, excluded: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Base rows with replaced values, without excluded ones, then new rows; ``origin`` tells base, replaced or new."""
    new = replacements.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__is_new"))
    kept = base.join(excluded.select(*keys).distinct(), keys, "left_anti").join(new, keys, "left")
    kept = kept.withColumn("origin", F.when(F.col("__is_new"), "replaced").otherwise("base")).withColumn(value, F.when(F.col("__is_new"), F.col("__new")).otherwise(F.col(value)))
    added = replacements.join(base.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("new"))
    return kept.drop("__new", "__is_new").unionByName(added, allowMissingColumns=True)


def allocate_ids(new: DataFrame, existing: DataFrame, order: str, identifier: str, start: int = 0, name: str = "new_id") -> DataFrame:
    """Consecutive ids after the greatest existing one, in the order of ``order``.

    ``start`` is the greatest id of an empty table. Ranks are computed per range partition and
    offset by the partition counts, so no task holds all rows.
    """
    top = existing.select(F.coalesce(F.max(identifier), F.lit(start)).cast("bigint")).scalar()
    return numbered(new, [], [F.col(order)], "__rank").withColumn(name, top + F.col("__rank") + 1).drop("__rank")


def first_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """First value per key in the given order."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Last value per key in the given order."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, the least and greatest named."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("greatest")).where("n_values > 1")


def coverage(expected: DataFrame, done: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per group the expected and done keys and the share in basis points, 10000 for an empty group."""
    marked = expected.join(done.select(*keys).distinct().withColumn("__done", F.lit(1)), keys, "left")
    counts = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_expected"), F.count("__done").alias("n_done"))
    return counts.withColumn("basis_points", F.when(F.col("n_expected") > 0, F.floor(F.col("n_done") * 10000 / F.col("n_expected"))).otherwise(10000).cast("bigint"))


def preview_missing(expected: DataFrame, done: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` expected keys that are not done, in key order (a report limit)."""
    return expected.select(*keys).distinct().join(done.select(*keys), keys, "left_anti").orderBy(*keys).limit(n)


def insert_in_order(existing: Column, new: Column, order: list[str], unknown: int = 10_000) -> Column:
    """Array ``existing`` with the elements of ``new`` put in, each before the first element of a higher rank.

    Elements are ``struct<tag, xml>``; tags outside ``order`` rank ``unknown``. Existing elements keep
    their order even where it is not canonical.
    """
    ranks = F.create_map(*(x for i, tag in enumerate(order) for x in (F.lit(tag), F.lit(i))))
    rank = lambda e: F.coalesce(F.element_at(ranks, e["tag"]), F.lit(unknown))

    def put(held, one):
        later = F.transform(held, lambda e: rank(e) > rank(one))
        at = F.array_position(later, True)
        return F.when(at == 0, F.array_append(held, one)).otherwise(F.array_insert(held, F.greatest(at, F.lit(1)).cast("int"), one))

    return F.aggregate(new, existing, put)


def raise_if_any(violations: DataFrame, message: str, n: int = 20) -> None:
    """Fail with the first ``n`` violation rows if there are any."""
    found = violations.limit(n).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")
