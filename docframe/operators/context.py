"""Ordered context of rows: neighbours, running offsets, overlapping chunks, splices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the text sent along and of chunks.
TEXT_CHARS, CONTEXT_CHARS, PREVIEW_CHARS = 200, 80, 120
MAX_CHARS, MAX_ROWS, OVERLAP, MIN_ROWS = 320_000, 300, 20, 10


#: Order values of one block; a key's rows are spread over its blocks, so no task holds all of a large key.
BLOCK = 65_536


def _blocked(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(order) / BLOCK))


def neighbours(df: DataFrame, keys: list[str], order: str, value: Column, before: str | None = "before", after: str | None = "after") -> DataFrame:
    """``value`` of the row before and after within a key, null at the edges.

    ``order`` holds whole numbers. Neighbours are found inside blocks of the order; the first and last
    row of a block look at the edges of the blocks around it, of which there is one row per block.
    """
    rows = _blocked(df, order)
    wrapped = F.struct(value.alias("v"))
    edges = rows.groupBy(*keys, "__block").agg(F.min_by(wrapped, order).alias("__first"), F.max_by(wrapped, order).alias("__last"))
    blocks = Window.partitionBy(*keys).orderBy("__block")
    edges = edges.select(*keys, "__block", F.lag("__last").over(blocks).alias("__before"), F.lead("__first").over(blocks).alias("__after"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    rows = rows.withColumn("__lag", F.lag(wrapped).over(inside)).withColumn("__lead", F.lead(wrapped).over(inside)).join(edges, [*keys, "__block"])
    if before:
        rows = rows.withColumn(before, F.coalesce("__lag", "__before")["v"])
    if after:
        rows = rows.withColumn(after, F.coalesce("__lead", "__after")["v"])
    return rows.drop("__block", "__lag", "__lead", "__before", "__after")


def with_context(df: DataFrame, keys: list[str], order: str, text: str = "text", chars: int = CONTEXT_CHARS) -> DataFrame:
    """``prev_text`` and ``next_text``: the first characters of the neighbours, empty at the edges."""
    rows = neighbours(df, keys, order, F.substring(F.col(text), 1, chars), "prev_text", "next_text")
    return rows.withColumn("prev_text", F.coalesce("prev_text", F.lit(""))).withColumn("next_text", F.coalesce("next_text", F.lit("")))


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, total: str | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before a row within its key, and the key's ``total``; ``order`` holds whole numbers.

    Two levels: sums of blocks over the key, sums of rows inside a block.
    """
    rows = _blocked(df, order).withColumn("__value", value)
    blocks = Window.partitionBy(*keys).orderBy("__block")
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__s"))
    base = F.coalesce(F.sum("__s").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "__block", base.alias("__base"), F.sum("__s").over(Window.partitionBy(*keys)).alias("__total"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0))).join(sums, [*keys, "__block"])
    rows = rows.withColumn(name, (F.col("__base") + F.col("__inside")).cast("bigint"))
    if total:
        rows = rows.withColumn(total, F.col("__total").cast("bigint"))
    return rows.drop("__block", "__value", "__inside", "__base", "__total")


def running_offset(df: DataFrame, keys: list[str], order: str, length: Column, name: str = "offset") -> DataFrame:
    """Characters before a row within its key, 0 for the first."""
    return running_sum(df, keys, order, length, name)


def chunk_rows(total_chars: Column, n_rows: Column, overhead: Column, max_chars: int = MAX_CHARS) -> Column:
    """Rows per chunk from the mean serialised size of a row, at least MIN_ROWS."""
    mean = F.greatest((total_chars - overhead) / F.greatest(n_rows, F.lit(1)), F.lit(1.0))
    return F.greatest(F.lit(MIN_ROWS), F.floor((F.lit(max_chars) - overhead) / mean)).cast("bigint")


def overlapping_chunks(df: DataFrame, keys: list[str], order: str, size: Column | int, overlap: int = OVERLAP) -> DataFrame:
    """One row per row and chunk that covers it: ``chunk`` from 0, ``rn`` from 1.

    Chunk ``c`` covers rows ``c * (size - overlap) + 1`` to ``+ size``; the last is the first to reach
    the end. ``size`` must exceed ``overlap``, else no chunk would advance.
    """
    if isinstance(size, int):
        if size <= overlap:
            raise ValueError("a chunk must be larger than the overlap")
        size = F.lit(size)
    counted = running_sum(df.withColumn("__size", size.cast("bigint")), keys, order, F.lit(1), "rn", "__n").withColumn("rn", F.col("rn") + 1)
    checked = F.when(F.col("__size") > overlap, F.col("__size") - overlap).otherwise(F.raise_error("a chunk must be larger than the overlap"))
    step = counted.withColumn("__step", F.when(F.col("__size") >= F.col("__n"), F.greatest(F.col("__size"), F.lit(1))).otherwise(checked))
    last = F.greatest(F.lit(0), F.ceil((F.col("__n") - F.col("__size")) / F.col("__step")))
    first_chunk = F.greatest(F.lit(0), F.ceil((F.col("rn") - F.col("__size")) / F.col("__step")))
    last_chunk = F.least(F.floor((F.col("rn") - 1) / F.col("__step")), last)
    return step.withColumn("chunk", F.explode(F.sequence(first_chunk.cast("bigint"), last_chunk.cast("bigint")))).drop("__n", "__size", "__step")


def chunk_ranges(chunks: DataFrame, keys: list[str], index: str) -> DataFrame:
    """First and last index and number of rows per chunk."""
    return chunks.groupBy(*keys, "chunk").agg(F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count(F.lit(1)).alias("n_rows"))


def chunk_completeness(expected: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the expected and received chunks and whether they agree."""
    a = expected.groupBy(*keys).agg(F.count_distinct("chunk").alias("n_expected"))
    b = received.groupBy(*keys).agg(F.count_distinct("chunk").alias("n_received"))
    both = a.join(b, keys, "left").withColumn("n_received", F.coalesce("n_received", F.lit(0)).cast("bigint"))
    return both.withColumn("complete", F.col("n_expected") == F.col("n_received"))


def splice(segments: DataFrame, keys: list[str], order: str, text: str, separator: str = "") -> DataFrame:
    """The segments of a key joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return segments.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias(text))
