"""Mixing sources to target weights with capped repetition.

The texts of a source form one token stream, cut into blocks of fixed length. The output is a
sequence of shards with a fixed number of block slots; each shard draws its source counts from a
multinomial over the target shares, seeded by the shard number, so shards are independent. The
``t``-th slot of a source takes block ``permutation(t mod blocks)`` of pass ``t div blocks``: a
pseudorandom index permutation per source and pass (a Feistel network with cycle walking), so a
source is used up evenly before any block repeats. Slots past ``max_repeats`` passes stay empty:
a short source gives all it may and the shares really reached are reported. Slots and text spans
meet in one join on (source, block), keys that no hot source can skew. The report is counted on the
drawn slots and the joined spans, not on the totals.

Only per-source totals (a row per listed source) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.tokens import DEFAULT_VOCABULARY, with_sizes
from docframe.session import cut

MAX_SOURCES = 100_000


def permute(t: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position ``t`` of the pseudorandom permutation of ``range(size)`` chosen by ``key``, per row."""
    t, size, key = (np.asarray(x).astype(np.uint64) for x in (t, size, key))
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def once(x, bits, mask, key):
        left, right = x >> bits, x & mask
        for turn in range(4):
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn * 0xD1B54A32D192ED03 % 2**64)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask)
        return (left << bits) | right

    out = once(t, bits, mask, key)
    while len(walk := np.flatnonzero(out >= size)):
        out[walk] = once(out[walk], bits[walk], mask[walk], key[walk])
    return out.astype(np.int64)


@dataclass
class Mix:
    """Sizes of the listed texts, one entry per listed source, and the drawn slots."""

    sizes: DataFrame
    sources: list[dict]
    slots: DataFrame
    block_tokens: int
    total_tokens: int


def plan(
    documents: DataFrame,
    targets: DataFrame,
    block_tokens: int = 2048,
    shard_blocks: int = 256,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
) -> Mix:
    """Size the texts of listed sources and draw the slots of an output as long as all of them.

    Texts with a null or unlisted source do not count; null and empty texts have no tokens. A
    null share counts as 0, a null ``max_repeats`` as 1. Targets without documents stay listed.
    """
    listed = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats")).limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = documents.join(targets.select("source").distinct(), "source", "left_semi")
    # The partition numbers are written with the sizes, so stream positions hold whatever is lost later.
    sizes = cut(with_sizes(wanted, [key, "source"], text, vocabulary).withColumnRenamed(key, "doc_id").withColumn("part", F.spark_partition_id()))
    totals = {r.source: r for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}  # a row per listed source
    sources = []
    for i, row in enumerate(sorted(listed, key=lambda r: r.source)):
        n = totals[row.source].n if row.source in totals else 0
        sources.append({"no": i, "source": row.source, "share": row.share, "repeats": row.repeats, "tokens": n, "docs": totals[row.source].docs if row.source in totals else 0, "blocks": -(-n // block_tokens)})
    total = sum(s["tokens"] for s in sources)
    slots = _slots(documents.sparkSession, sources, -(-total // block_tokens), shard_blocks, seed)
    return Mix(sizes, sources, slots, block_tokens, total)


def _slots(spark, sources: list[dict], n_slots: int, shard_blocks: int, seed: int) -> DataFrame:
    shares = np.array([s["share"] for s in sources], float)
    shares = shares / shares.sum() if shares.sum() > 0 else shares
    names = [s["source"] for s in sources]
    blocks = {s["source"]: s["blocks"] for s in sources}
    cap = {s["source"]: s["blocks"] * s["repeats"] for s in sources}
    number = {s["source"]: s["no"] for s in sources}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shard in batch["id"]:
                size = min(shard_blocks, n_slots - shard * shard_blocks)
                counts = np.random.default_rng([seed, shard]).multinomial(size, shares)
                rows += ((shard, names[i], int(counts[i])) for i in np.flatnonzero(counts))
            yield pd.DataFrame(rows, columns=["shard", "source", "n"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["source"].map(blocks).to_numpy(np.int64)
            t = batch["t"].to_numpy(np.int64)
            filled = t < batch["source"].map(cap).to_numpy(np.int64)
            turn = t // np.maximum(size, 1)
            key = (batch["source"].map(number).to_numpy(np.int64) * 1_000_003 + turn) * 7919 + seed
            at = np.full(len(t), -1, np.int64)
            at[filled] = permute(t[filled] % size[filled], size[filled], key[filled])
            yield pd.DataFrame({"shard": batch["shard"], "source": batch["source"], "t": t, "block": at})

    shards = -(-n_slots // shard_blocks) if shares.sum() > 0 else 0
    drawn = spark.range(shards).mapInPandas(draw, "shard long, source string, n long").withColumn("span", F.floor(F.col("shard") / 1024))
    # Running counts of a source over shards, in two levels so that no task sees all shards.
    spans = drawn.groupBy("source", "span").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("source", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "span").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = drawn.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(spans, ["source", "span"])
    slots = counted.select("shard", "source", F.explode(F.expr("sequence(base + first, base + first + n - 1)")).alias("t"))
    return slots.mapInPandas(place, "shard long, source string, t long, block long")


def spans(mix: Mix) -> DataFrame:
    """``source, block, doc_id, token_from, token_to``: which part of which text lies in a block.

    Stream positions come from running sums within a partition and the totals of the partitions
    before it, so a source that holds most rows is still spread over all partitions.
    """
    placed = mix.sizes.where("n_tokens > 0")
    totals = placed.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("first", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, ["source", "part"])
    size = F.lit(mix.block_tokens)
    at = at.select("source", "doc_id", "n_tokens", (F.col("base") + F.col("first")).alias("start"))
    blocks = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n_tokens") - 1) / size))))
    return blocks.select(
        "source",
        "block",
        "doc_id",
        F.greatest(F.lit(0), F.col("block") * size - F.col("start")).alias("token_from"),
        F.least("n_tokens", (F.col("block") + 1) * size - F.col("start")).alias("token_to"),
    )


def mixed(mix: Mix) -> DataFrame:
    """The mix: ``shard, source, t, block, doc_id, token_from, token_to``, several rows per slot."""
    return mix.slots.where("block >= 0").join(spans(mix), ["source", "block"]).select("shard", "source", "t", "block", "doc_id", "token_from", "token_to")


def report(mix: Mix) -> DataFrame:
    """Per listed source its target and reached share, slots, tokens, repeats, and whether it is ``short``.

    ``drawn_slots`` are the slots the draws gave a source, ``empty_slots`` those past its passes,
    ``mixed_tokens`` the tokens that the join with the text spans put into the mix. ``short``
    sources are found from the draws: those whose demand may exceed all they can give. A source
    with a demand of ``m`` slots on average draws ``n`` with ``(sqrt(n) + 3) ** 2 < m`` less often
    than once in 10**8 times, so that bound loses none; then the exact check is made whether all
    its tokens, repeated as often as allowed, are fewer than its share of the tokens of all
    documents of listed sources.
    """
    spark = mix.slots.sparkSession
    given = spark.createDataFrame(
        [(s["source"], s["docs"], s["tokens"], s["blocks"], float(s["share"]), int(s["repeats"])) for s in mix.sources],
        "source string, n_documents long, n_tokens long, n_blocks long, target_share double, max_repeats int",
    )
    drawn = mix.slots.groupBy("source").agg(F.count(F.lit(1)).alias("drawn_slots"), F.count_if(F.col("block") < 0).alias("empty_slots"))
    used = mixed(mix).groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("mixed_tokens"))
    rows = given.join(drawn, "source", "left").join(used, "source", "left")
    rows = rows.select(*given.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("drawn_slots", "empty_slots", "mixed_tokens")))
    supply = F.col("n_tokens") * F.col("max_repeats")
    may_lack = F.pow(F.sqrt("drawn_slots") + 3, 2) * mix.block_tokens > supply
    rows = rows.withColumn("short", may_lack & (F.col("mixed_tokens") <= supply) & (supply < F.col("target_share") * F.lit(mix.total_tokens)))
    all_mixed = rows.select(F.sum("mixed_tokens")).scalar()
    return rows.withColumn("reached_share", F.round(F.try_divide(F.col("mixed_tokens"), all_mixed), 6))
