"""Joins against a table with unique keys when a few keys hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold 1/MAX_HEAVY of all rows, so the heavy list is bounded.
MAX_HEAVY = 200


def salted_lookup(many: DataFrame, one: DataFrame, keys: list[str], salts: int = 64, how: str = "left") -> DataFrame:
    """Join ``many`` with ``one`` (unique on ``keys``), spreading heavy keys over ``salts`` tasks.

    A key is heavy when it holds more than ``1/MAX_HEAVY`` of the rows of ``many``, so there are
    fewer than MAX_HEAVY heavy keys at any size and broadcasting them is bounded. Rows of heavy
    keys get one of ``salts`` salts by the hash of the whole row, so a repeated task salts alike; the matching row of ``one`` is repeated once per salt. All
    other rows carry salt 0. Rows with a null key match nothing: kept by ``left``, dropped by
    ``inner`` and ``left_semi``. The result equals the plain join.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join: {how}")
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.select(F.sum("__n")).scalar()
    heavy = counts.where((F.col("__n") > 10_000) & (F.col("__n") * MAX_HEAVY > total)).select(*keys, F.lit(True).alias("__heavy"))
    heavy = F.broadcast(heavy)  # fewer than MAX_HEAVY rows
    left = many.join(heavy, keys, "left").withColumn(
        "__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(*many.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    right = (
        one.join(heavy, keys, "left")
        .withColumn("__salt", F.explode(F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("__heavy")
    )
    return left.drop("__heavy").join(right, [*keys, "__salt"], how).drop("__salt")
