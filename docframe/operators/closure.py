"""Closures and inheritance over style links, round by round on the frontier.

Each round joins only the new frontier with the links; distinct pairs are kept, so circles end.
Rounds are written to the shared checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.operators.skew import salted_lookup
from docframe.session import cut, cut_counted


def dependency_closure(seeds: DataFrame, edges: DataFrame, scope: list[str], max_rounds: int = 10_000) -> DataFrame:
    """``scope, seed, id``: everything that a seed reaches over ``edges(scope, src, dst)``, itself included.

    Targets without own edges (missing ones too) stay in the set; null targets do not count. Links
    are first widened to up to four hops, so a chain of n links takes n/4 rounds.
    """
    links = cut(edges.where("dst is not null").select(*scope, F.col("src").alias("id"), "dst").distinct())
    for _ in range(2):
        onward = links.select(*scope, F.col("id").alias("dst"), F.col("dst").alias("far"))
        links = cut(links.unionByName(links.join(onward, [*scope, "dst"]).select(*scope, "id", F.col("far").alias("dst"))).distinct())
    known = [cut(seeds.select(*scope, "seed", F.col("seed").alias("id")).distinct())]
    for _ in range(max_rounds):
        reached = known[-1].join(links, [*scope, "id"]).select(*scope, "seed", F.col("dst").alias("id")).distinct()
        whole = reduce(DataFrame.unionByName, known)
        # Each round adds its own rows as a table of their own; nothing is written twice.
        frontier, added = cut_counted(reached.join(whole, [*scope, "seed", "id"], "left_anti"), n=F.count(F.lit(1)))
        if not added["n"]:
            return whole
        known.append(frontier)
    raise RuntimeError(f"no end after {max_rounds} rounds")


def nearest_ancestor(nodes: DataFrame, scope: list[str], values: list[str], max_hops: int = 50) -> DataFrame:
    """Each value resolved on its own: that of the node or of the nearest ancestor that has one.

    ``nodes(scope, id, parent, values...)``, unique on ``(scope, id)``. Chains end at a missing parent
    and after ``max_hops`` nodes, which also ends circles. Gives ``scope, id, values...`` and
    ``<value>_depth`` (hops to the owner). Pointer doubling: after round ``k`` a node knows the
    nearest values within ``2**k`` hops and its ancestor at that distance, so ``log2(max_hops)``
    rounds are enough.
    """
    state = cut(nodes.select(*scope, "id", F.col("parent").alias("at"), *values, *(F.when(F.col(v).isNotNull(), 0).cast("int").alias(f"{v}_depth") for v in values)))
    reach = 1
    while reach < max_hops and not state.where(F.col("at").isNotNull()).isEmpty():
        above = state.select(*scope, F.col("id").alias("at"), F.col("at").alias("next_at"), *(F.col(c).alias(f"up_{c}") for v in values for c in (v, f"{v}_depth")))
        step = salted_lookup(state, above, [*scope, "at"])
        state = cut(
            step.select(
                *scope,
                "id",
                F.col("next_at").alias("at"),
                *(F.coalesce(v, f"up_{v}").alias(v) for v in values),
                *(F.coalesce(F.col(f"{v}_depth"), F.col(f"up_{v}_depth") + reach).cast("int").alias(f"{v}_depth") for v in values),
            )
        )
        reach *= 2
    near = {v: F.col(f"{v}_depth") < max_hops for v in values}
    return state.select(*scope, "id", *(F.when(near[v], F.col(v)).alias(v) for v in values), *(F.when(near[v], F.col(f"{v}_depth")).alias(f"{v}_depth") for v in values))


def style_edges(styles: DataFrame, scope: list[str], kinds: tuple[str, ...] = ("based_on", "link", "next")) -> DataFrame:
    """``scope, src, kind, dst`` from the reference columns of style rows."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("dst")) for k in kinds))
    return styles.select(*scope, F.col("style_id").alias("src"), F.inline(pairs)).where("dst is not null")


def with_default(column: str, default: Column) -> Column:
    """A resolved value or the document default."""
    return F.coalesce(F.col(column), default)
