"""Parent-child links to full hierarchies by parallel tree contraction.

Every node has at most one parent, so the links of a scope form trees and circles. A round
*rakes* all leaves onto their parents and *compresses* unary chains: an independent set of
nodes with exactly one child is spliced out, its child taking over its parent, edge length and
edge label. After O(log n) rounds only roots and circles shrunk to a self-loop are left. Subtree sizes
flow upwards with the contraction: a raked leaf hands its size to its parent, a spliced node leaves
its own on the edge of its child.

The recorded removals are then reversed, all rounds at once: every record points to a node that
outlives it, the parent for root, depth and path, the child for sizes and circles, so following
these pointers by doubling takes log2(rounds) joins.

No step groups rows of one tree into one task: counts per parent are pre-aggregated before the
shuffle, and all joins have unique keys on one side. The other side is the streamed one, so adaptive
execution splits a parent that holds a large part of it over many tasks. State is written to the
shared checkpoint folder once a round; each round writes only what it adds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docframe.operators.skew import salted_lookup
from docframe.session import cut


@dataclass
class Contraction:
    """The recorded contraction: ``rounds`` of removals and the ``top`` that cannot contract."""

    rounds: list[DataFrame] = field(default_factory=list)
    top: DataFrame | None = None


def contract(links: DataFrame, depths: bool = True, paths: bool = True, max_rounds: int = 400) -> Contraction:
    """Contract ``links(g, id, parent)``; ``(g, id)`` is unique and a parent without row is null.

    A record has ``action`` (rake, splice), the ``parent`` at removal, for a splice the ``child``. With
    ``depths`` also the edge length ``w``, the least id ``low`` on the edge, the subtree size ``acc``
    gathered so far and ``extra`` of the nodes spliced into the edge (of a splice: into that of its
    child); with ``paths`` the edge label ``seg`` (ids after the parent up to the node itself).
    ``top`` holds roots (``loop`` false) and circle cores (``loop`` true, ``low`` their least id).
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    first = {"w": one, "low": F.col("id"), "acc": one, "extra": none} if depths else {}
    if paths:
        first["seg"] = F.array("id")
    loop = F.coalesce(F.col("id") == F.col("parent"), F.lit(False))
    state = links.select("g", "id", F.when(~loop, F.col("parent")).alias("parent"), loop.alias("loop"), F.lit("keep").alias("action"), F.lit(None).cast("string").alias("child"), *(c.alias(k) for k, c in first.items()))
    open_edges = Observation()
    state = cut(state.observe(open_edges, F.count("parent").alias("n")))
    done = Contraction()
    for turn in range(max_rounds):
        kept = F.col("action") == "keep"
        # Children by parent, and the sizes of those raked in the last round.
        edge = {"id": F.col("id"), "extra": F.col("extra")} if depths else {"id": F.col("id")}
        kids = state.where(F.col("parent").isNotNull() & (F.col("action") != "splice")).groupBy("g", F.col("parent").alias("id"))
        kids = kids.agg(
            F.count_if(kept).alias("n"),
            F.min(F.when(kept, F.struct(*(c.alias(k) for k, c in edge.items())))).alias("kid"),
            *([F.coalesce(F.sum(F.when(~kept, F.col("acc") + F.col("extra"))), none).alias("gain")] if depths else []),
        )
        live = state.where(kept).drop("action", "child").join(kids, ["g", "id"], "left")
        if depths:
            live = live.withColumn("acc", F.col("acc") + F.coalesce("gain", none)).drop("gain")
        if not open_edges.get["n"]:
            done.top = live.drop("n", "kid", "parent")
            return done
        order = lambda c: F.xxhash64(F.lit(turn), "g", c)
        mine = order(F.col("id"))
        peak = (mine > order(F.col("kid.id"))) & (mine > order(F.col("parent")))
        action = F.when(F.col("parent").isNull(), "keep").when(F.coalesce("n", none) == 0, "rake").when((F.col("n") == 1) & peak, "splice").otherwise("keep")
        acted = live.withColumn("action", action)
        up = {"up": F.col("parent")}
        if depths:
            up |= {"up_w": F.col("w"), "up_low": F.col("low"), "up_extra": F.col("acc") + F.col("extra")}
        if paths:
            up["up_seg"] = F.col("seg")
        handed = acted.where(F.col("action") == "splice").select("g", F.col("kid.id").alias("id"), *(c.alias(k) for k, c in up.items()))
        # A spliced-out node hands its upward edge to its only child, also to one that is raked in
        # this round: so every removed node hangs on a node that outlives the round.
        moved, splice = F.col("up").isNotNull(), F.col("action") == "splice"
        parent = F.when(moved, F.col("up")).otherwise(F.col("parent"))
        closed = F.col("loop") | F.coalesce((F.col("action") == "keep") & (F.col("id") == parent), F.lit(False))
        columns = {"g": F.col("g"), "id": F.col("id"), "parent": F.when(~closed, parent), "loop": closed, "action": F.col("action"), "child": F.when(splice, F.col("kid.id"))}
        if depths:
            columns |= {
                "w": F.col("w") + F.coalesce("up_w", none),
                "low": F.least("low", "up_low"),
                "acc": F.col("acc"),
                "extra": F.when(splice, F.col("kid.extra")).otherwise(F.col("extra") + F.coalesce("up_extra", none)),
            }
        if paths:
            columns["seg"] = F.when(moved, F.concat("up_seg", "seg")).otherwise(F.col("seg"))
        step = acted.join(handed, ["g", "id"], "left").select(*(c.alias(k) for k, c in columns.items()))
        open_edges = Observation()
        state = cut(step.observe(open_edges, F.count_if(kept & F.col("parent").isNotNull()).alias("n")))
        done.rounds.append(state.where(F.col("action") != "keep"))
    raise RuntimeError(f"no end after {max_rounds} rounds")


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def spliced(contraction: Contraction, sizes: bool = True) -> DataFrame:
    """``(g, id, on_circle, size)`` of the spliced nodes, by way of the child that each was spliced onto.

    A spliced node lies on a circle exactly if its child does; raked nodes never do. Its subtree
    holds what it had gathered, what was spliced onto its child's edge, and the child's subtree.
    """
    add = [F.col("acc") + F.col("extra")] if sizes else [F.lit(0).cast("bigint")]
    jumps = cut(_all(contraction.rounds).where(F.col("action") == "splice").select("g", "id", F.col("child").alias("at"), add[0].alias("size")))
    onward = jumps.select("g", F.col("id").alias("at"), F.col("at").alias("next"), F.col("size").alias("more"))
    reach = 1
    while reach < len(contraction.rounds):
        # The pointer of a jump whose target is no jump has reached its end and stays.
        jumps = cut(jumps.join(onward, ["g", "at"], "left").select("g", "id", F.coalesce("next", "at").alias("at"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        onward = jumps.select("g", F.col("id").alias("at"), F.col("at").alias("next"), F.col("size").alias("more"))
        reach *= 2
    acc = F.col("acc") if sizes else F.lit(0).cast("bigint")
    raked = _all(contraction.rounds).where(F.col("action") == "rake")
    ends = [f.select("g", F.col("id").alias("at"), F.col("loop").alias("on_circle"), acc.alias("more")) for f in ([raked, contraction.top] if sizes else [contraction.top.where("loop")])]
    return jumps.join(_all(ends), ["g", "at"]).select("g", "id", "on_circle", (F.col("size") + F.col("more")).alias("size"))


def circle_members(contraction: Contraction) -> DataFrame:
    """``(g, id)`` of all nodes on a circle: the cores and the nodes spliced out of them."""
    cores = contraction.top.where("loop").select("g", "id")
    if not contraction.rounds or cores.isEmpty():
        return cores
    return cores.unionByName(spliced(contraction, sizes=False).where("on_circle").select("g", "id"))


def resolve(contraction: Contraction, paths: bool = True) -> DataFrame:
    """``(g, id, status, root, depth, path, size)``: status is tree, circle or into_circle.

    ``path`` holds the ids from the root to the node, depth is 0 at a root, ``size`` counts the node
    and its descendants. On and below a circle these are null and ``root`` is the least id of the
    circle. Without ``paths`` the path is null.
    """
    tree = ~F.col("loop")
    label = {"seg": F.col("seg")} if paths else {}
    top = contraction.top.select(
        "g",
        "id",
        tree.alias("tree"),
        F.when(tree, F.col("id")).otherwise(F.col("low")).alias("root"),
        F.when(tree, F.lit(0).cast("bigint")).alias("w"),
        *([F.when(tree, F.array("id")).alias("seg")] if paths else []),
        F.when(tree, F.col("acc")).alias("acc"),
    )
    if not contraction.rounds:
        return top.select("g", "id", F.when(F.col("tree"), "tree").otherwise("circle").alias("status"), "root", F.col("w").alias("depth"), (F.col("seg") if paths else F.lit(None).cast("array<string>")).alias("path"), F.col("acc").alias("size"))
    known = [top.withColumn("at", F.lit(None).cast("string"))]
    open_ = _all(contraction.rounds).select("g", "id", F.lit(None).cast("boolean").alias("tree"), F.lit(None).cast("string").alias("root"), "w", *label, F.when(F.col("action") == "rake", F.col("acc")).alias("acc"), F.col("parent").alias("at"))
    reach = 1
    while reach <= len(contraction.rounds):
        up = _all([*known, open_]).select("g", F.col("id").alias("at"), F.col("tree").alias("up_tree"), F.col("root").alias("up_root"), F.col("w").alias("up_w"), *(F.col(c).alias(f"up_{c}") for c in label), F.col("at").alias("up_at"))
        step = cut(
            open_.join(up, ["g", "at"]).select(
                "g", "id", F.col("up_tree").alias("tree"), F.col("up_root").alias("root"), (F.col("w") + F.col("up_w")).alias("w"), *(F.concat(f"up_{c}", c).alias(c) for c in label), "acc", F.col("up_at").alias("at")
            )
        )
        known.append(step.where(F.col("root").isNotNull()))
        open_ = step.where(F.col("root").isNull())
        reach *= 2
    whole = _all(known)
    got = spliced(contraction).withColumnRenamed("size", "spliced_size")
    cores = contraction.top.where("loop").select("g", "id", F.lit(True).alias("on_circle"), F.lit(None).cast("bigint").alias("spliced_size"))
    status = F.when(F.col("on_circle"), "circle").when(F.col("tree"), "tree").otherwise("into_circle")
    size = F.when(F.col("tree"), F.coalesce("spliced_size", "acc"))
    path = F.col("seg") if paths else F.lit(None).cast("array<string>")
    return whole.join(got.unionByName(cores), ["g", "id"], "left").select("g", "id", status.alias("status"), "root", F.col("w").alias("depth"), path.alias("path"), size.alias("size"))


def current_rows(rows: DataFrame, keys: list[str], revision: str, tie: list[str]) -> DataFrame:
    """One row per key: the highest revision; ties go to the greatest ``tie`` columns.

    Uses a partial-aggregating ``max_by``, so repeated rows of a hot key shrink before the
    shuffle. Rows must not have null keys.
    """
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(F.coalesce(F.col(revision), F.lit(-(2**31))).alias("r"), *(F.col(c) for c in tie))
    best = F.max_by(F.struct(*rest), rank).alias("__row")
    return rows.groupBy(*keys).agg(best).select(*keys, "__row.*")


def style_links(style_defs: DataFrame) -> DataFrame:
    """``(g, id, parent)`` of the current, undeleted styles of ``style_defs``.

    Ids and references compare without surrounding blanks. Rows with a null template or a null
    or blank id do not count; blank references, and references to styles that do not exist or
    are deleted, end the chain (parent null). Among rows of one revision the latest loaded wins.
    """
    rows = style_defs.select(
        "template_key",
        F.trim("style_id").alias("id"),
        F.expr("nullif(trim(based_on), '')").alias("based_on"),
        F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"),
        "revision",
        "loaded_at",
    ).where("template_key is not null and id <> ''")
    now = current_rows(rows, ["template_key", "id"], "revision", ["loaded_at", "is_deleted", "based_on"])
    now = now.where(~F.col("is_deleted")).select(F.col("template_key").alias("g"), "id", "based_on")
    there = now.select("g", F.col("id").alias("based_on"), F.lit(True).alias("there"))
    linked = salted_lookup(now, there, ["g", "based_on"])
    return linked.select("g", "id", F.when(F.col("there"), F.col("based_on")).alias("parent"))


def style_hierarchy(style_defs: DataFrame) -> DataFrame:
    """Per style: ``template_key, style_id, status, root, depth, path, n_descendants``.

    An empty table gives an empty result. ``path`` joins ids with `` > ``. On and below a circle
    ``path`` is null and ``depth`` and ``n_descendants`` are -1.
    """
    return resolve(contract(style_links(style_defs))).select(
        F.col("g").alias("template_key"),
        F.col("id").alias("style_id"),
        "status",
        "root",
        F.coalesce("depth", F.lit(-1)).alias("depth"),
        F.array_join("path", " > ").alias("path"),
        F.coalesce(F.col("size") - 1, F.lit(-1)).alias("n_descendants"),
    )


def descendants(known: DataFrame) -> DataFrame:
    """``(template_key, style_id, descendant_id, distance)``: one row per node and ancestor.

    The pairs come straight from the paths, one row each, so no list of all descendants of a
    large tree is ever held in one row.
    """
    return known.where(F.col("status") == "tree").select(
        F.col("g").alias("template_key"),
        F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "style_id"),
        F.col("id").alias("descendant_id"),
        "depth",
    ).select("template_key", "style_id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))


def style_descendants(style_defs: DataFrame) -> DataFrame:
    """All (style, descendant) pairs of the trees of ``style_defs``."""
    return descendants(resolve(contract(style_links(style_defs))))


def styles_in_circles(style_defs: DataFrame) -> DataFrame:
    """``(template_key, style_id)`` of styles that reach themselves by ``based_on``."""
    members = circle_members(contract(style_links(style_defs), depths=False, paths=False))
    return members.select(F.col("g").alias("template_key"), F.col("id").alias("style_id"))
