"""Hierarchies and orphan references against plain walks, with nulls, blanks, ties and circles."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docframe.operators import closure, hierarchy, references, skew

STYLE = "template_key string, style_id string, based_on string, next string, link string, revision int, is_deleted boolean, loaded_at timestamp_ntz, extra string"
NOW = dt.datetime(2031, 1, 1)


def style(key, style_id, based_on=None, revision=1, deleted=False, at=NOW, **more):
    return (key, style_id, based_on, more.get("next"), more.get("link"), revision, deleted, at, None)


def walk(links):
    """Status, root and path of each node by following parents."""
    out = {}
    for node in links:
        seen, at = [], node
        while at is not None and at not in seen:
            seen.append(at)
            at = links[at]
        if at is None:
            out[node] = ("tree", seen[-1], list(reversed(seen)))
        else:
            circle = seen[seen.index(at) :]
            out[node] = ("circle" if node in circle else "into_circle", min(circle), None)
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "star", "circle"])
def test_resolve_equals_walk(spark, shape):
    rng, n = random.Random(shape), 60
    names = [f"n{i:03}" for i in range(n)]
    if shape == "random":
        links = {x: rng.choice([None, *names]) for x in names}
    elif shape == "chain":
        links = {x: names[i - 1] if i else None for i, x in enumerate(names)}
    elif shape == "star":
        links = {x: names[0] if i else None for i, x in enumerate(names)}
    else:
        links = {x: names[(i + 1) % 30] for i, x in enumerate(names)}
    rows = spark.createDataFrame([("g", x, p) for x, p in links.items()], "g string, id string, parent string")
    contraction = hierarchy.contract(rows)
    resolved = hierarchy.resolve(contraction).collect()
    want = walk(links)
    assert {r.id: (r.status, r.root, r.path) for r in resolved} == want
    assert all(r.depth == len(r.path) - 1 for r in resolved if r.path)
    below = {x: sum(x in (path or []) for _, _, path in want.values()) for x in want}
    assert all(r.size == (below[r.id] if r.status == "tree" else None) for r in resolved)
    bare = hierarchy.resolve(hierarchy.contract(rows, paths=False), paths=False).collect()
    assert sorted((r.id, r.status, r.root, r.depth, r.size) for r in bare) == sorted((r.id, r.status, r.root, r.depth, r.size) for r in resolved)
    members = {r.id for r in hierarchy.circle_members(hierarchy.contract(rows, depths=False, paths=False)).collect()}
    assert members == {x for x, (status, _, _) in want.items() if status == "circle"}


def test_sizes_of_a_long_chain(spark):
    """Neither pairs nor paths are expanded, so the work does not grow with the square of the depth."""
    n = 20_000
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    got = hierarchy.resolve(hierarchy.contract(rows, paths=False), paths=False)
    wrong = got.where((F.col("depth") != F.col("id").cast("bigint")) | (F.col("size") != n - F.col("id").cast("bigint")) | (F.col("root") != "0"))
    assert got.count() == n and wrong.isEmpty()


def test_style_rules(spark):
    rows = [
        style("t", "A", "B"), style("t", " B ", " A"), style("t", "C", "A"), style("t", "D", "E"), style("t", "E", "D", deleted=True), style("t", "F", "F"),
        style("t", "G", "H"), style("t", "H", "G"), style("t", "H", None, revision=2), style("t", "a", "A "), style("u", "A", "B"), style("t", " ", "A"), style("t", None, "A"),
        style(None, "A", "A"), style("t", "A", "B"), style("t", "K", " "), style("t", "L", "gone"),
    ]
    df = spark.createDataFrame(rows, STYLE)
    assert sorted(map(tuple, hierarchy.styles_in_circles(df).collect())) == [("t", "A"), ("t", "B"), ("t", "F")]
    got = {(r.template_key, r.style_id): r for r in hierarchy.style_hierarchy(df).collect()}
    assert len(got) == 11
    assert got["t", "C"].status == "into_circle" and got["t", "C"].depth == -1 and got["t", "C"].root == "A"
    assert (got["t", "G"].path, got["t", "G"].depth, got["t", "H"].n_descendants) == ("H > G", 1, 1)
    assert got["t", "L"].path == "L" and got["t", "D"].path == "D"
    pairs = hierarchy.style_descendants(df).collect()
    assert [tuple(p) for p in pairs] == [("t", "H", "G", 1)]


def test_empty_tables(spark):
    styles = spark.createDataFrame([], STYLE)
    assert hierarchy.styles_in_circles(styles).collect() == [] == hierarchy.style_hierarchy(styles).collect()
    entries = spark.createDataFrame([], "file_key string, entry_id bigint, part_name string, loaded_at timestamp_ntz")
    parts = spark.createDataFrame([], "file_key string, part_name string, revision int, is_deleted boolean, loaded_at timestamp_ntz")
    assert references.orphans(styles, entries, parts).collect() == []


def test_orphans(spark):
    later = NOW + dt.timedelta(days=40)
    styles = [
        style("t", "A", "B", next=" A "), style("t", "B", "Gone", link="C"), style("t", "C", "D", deleted=True), style("t", "D", None, at=later), style("t", "E", "D", at=later),
        style("t", "E", "Gone", revision=0), style("t", "G", "D"), style("u", "A", "B"),
    ]
    entries = [("f", 1, " /word/h.xml ", NOW), ("f", 1, " /word/h.xml ", NOW), ("f", 2, "./word/none.xml", NOW), ("f", 3, "word/del.xml", NOW), ("f", 4, "word/late.xml", NOW), ("f", 5, " ", NOW), ("f", 6, None, NOW), ("f", 7, "word/H.xml", later), ("f", 8, "word/none.xml", None)]
    parts = [("f", "word/h.xml", 1, False, NOW), ("f", "./word/del.xml", 1, False, NOW), ("f", "word/del.xml", 2, True, later), ("f", "/word/late.xml", 1, False, later), ("f", "word/late.xml", 2, None, later), ("g", "word/none.xml", 1, False, NOW)]
    found = references.orphans(
        spark.createDataFrame(styles, STYLE),
        spark.createDataFrame(entries, "file_key string, entry_id bigint, part_name string, loaded_at timestamp_ntz"),
        spark.createDataFrame(parts, "file_key string, part_name string, revision int, is_deleted boolean, loaded_at timestamp_ntz"),
    )
    got = {(r.src_table, r.owner_key, r.item_key, r.ref_field, r.reason, r.period) for r in found.collect()}
    assert got == {
        ("style_defs", "t", "B", "based_on", "missing", "2031-01"), ("style_defs", "t", "B", "link", "deleted", "2031-01"), ("style_defs", "t", "G", "based_on", "later", "2031-01"),
        ("style_defs", "u", "A", "based_on", "missing", "2031-01"), ("hf_entries", "f", "2", "part_name", "missing", "2031-01"), ("hf_entries", "f", "3", "part_name", "deleted", "2031-01"),
        ("hf_entries", "f", "4", "part_name", "later", "2031-01"), ("hf_entries", "f", "7", "part_name", "missing", "2031-02"), ("hf_entries", "f", "8", "part_name", "missing", None),
    }
    assert sum(r.n_references for r in references.orphan_report(found).collect()) == 9


def test_salted_lookup_equals_join(spark):
    many = spark.range(60_000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500)).alias("k"), "id").unionByName(spark.range(3).select(F.lit(None).cast("bigint").alias("k"), "id"))
    one = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how, n in (("left", 60_003), ("inner", None)):
        got = skew.salted_lookup(many, one, ["k"], how=how)
        want = many.join(one, "k", how)
        assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count() and (n is None or got.count() == n)


def test_closure_and_inheritance(spark):
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "b", "a"), ("t", "b", "gone"), ("t", "c", None), ("u", "a", "z")], "t string, src string, dst string")
    seeds = spark.createDataFrame([("t", "a"), ("t", "c"), ("t", "c")], "t string, seed string")
    assert sorted((r.seed, r.id) for r in closure.dependency_closure(seeds, edges, ["t"]).collect()) == [("a", "a"), ("a", "b"), ("a", "gone"), ("c", "c")]
    chain = [("t", f"n{i}", f"n{i + 1}", "x" if i == 60 else None, "y" if i % 7 == 0 else None) for i in range(61)] + [("t", "o", "p", None, None), ("t", "p", "o", None, "q")]
    nodes = spark.createDataFrame(chain, "t string, id string, parent string, v string, w string")
    got = {r.id: r for r in closure.nearest_ancestor(nodes, ["t"], ["v", "w"], max_hops=50).collect()}
    assert got["n11"].v == "x" and got["n11"].v_depth == 49 and got["n10"].v is None
    assert got["n1"].w_depth == 6 and got["o"].w == "q" and got["o"].v is None


def test_clashing_columns(spark):
    rows = [style("t", "A", "B"), style("t", "B", "A"), style("t", "C", "gone")]
    df = spark.createDataFrame(rows, STYLE)
    for name in ("g", "id", "parent", "owner_key", "target", "reason", "period", "row", "r"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted(r.style_id for r in hierarchy.styles_in_circles(df).collect()) == ["A", "B"]
    entries = spark.createDataFrame([("f", 1, "word/a.xml", NOW, "x")], "file_key string, entry_id bigint, part_name string, loaded_at timestamp_ntz, target string")
    parts = spark.createDataFrame([("f", None, 1, False, NOW, "x"), (None, "word/a.xml", None, None, None, "x")], "file_key string, part_name string, revision int, is_deleted boolean, loaded_at timestamp_ntz, owner_key string")
    found = {(r.src_table, r.item_key, r.reason) for r in references.orphans(df, entries, parts).collect()}
    assert found == {("style_defs", "C", "missing"), ("hf_entries", "1", "missing")}


def test_very_deep_and_long(spark):
    names = ["s" * 500 + str(i) for i in range(40)]
    df = spark.createDataFrame([style("t", x, names[i - 1] if i else None) for i, x in enumerate(names)], STYLE)
    got = hierarchy.style_hierarchy(df).agg(F.max("depth").alias("d"), F.max(F.length("path")).alias("n"), F.max("n_descendants").alias("k")).first()
    assert got.d == 39 and got.k == 39 and got.n > 40 * 500
