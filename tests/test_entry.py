"""The driver contract: names, oracles, and the flagship query."""

import __spark_entry__
from docframe.operators import classify, relational


def test_every_oracle_has_a_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    assert "p2_found" in queries and "p4_found" in queries


def test_final_classifications(spark):
    keys = ["f", "i"]
    frame = lambda rows: spark.createDataFrame(rows, "f string, i int, csi_role string")
    fixed, open_rows = frame([("a", 0, "PART"), ("b", 0, "PART"), ("c", 0, "PART")]), frame([("a", 1, None), ("b", 1, None), ("c", 1, None), ("d", 1, None)])
    incoming = frame([("a", 1, "X"), ("b", 0, "Y"), ("b", 1, "X"), ("c", 1, "X"), ("c", 9, "X")])
    rows = {(r.f, r.i): (r.csi_role, r.mode, r.status) for r in classify.final_classifications(fixed, incoming, open_rows.select(*keys), keys, ["f"]).collect()}
    assert rows["a", 0] == ("PART", "merged", "ok") and rows["a", 1] == ("X", "merged", "ok")
    assert rows["b", 0][1:] == ("total", "override") and rows["c", 9][2] == "extra" and rows["d", 1][2] == "missing"


def test_retries():
    calls, waits = [], []

    def fail(error):
        def call():
            calls.append(1)
            if len(calls) < 3:
                raise error
            return ["x"]

        return call

    assert classify.with_retries(fail(ValueError("json")), wait=waits.append) == ["x"] and waits == [1.0, 2.0]
    calls.clear()
    waits.clear()
    assert classify.with_retries(fail(OSError()), wait=waits.append) == ["x"] and waits == [2.0, 4.0]


def test_merge_chunks_conflict(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "A")], "i int, csi_role string")
    try:
        classify.merge_chunks(rows, ["i"])
        raise AssertionError("no conflict seen")
    except ValueError as error:
        assert "chunks disagree" in str(error)
    assert classify.merge_chunks(rows.where("i = 2"), ["i"]).collect()[0].csi_role == "A"


def test_bags_and_maps(spark):
    bag = lambda rows: spark.createDataFrame([(x,) for x in rows], "k string")
    assert [(r.k, r.before_n, r.after_n) for r in relational.missing_from_bag(bag("aab"), bag("abb"), ["k"]).collect()] == [("a", 2, 1)]
    pairs = lambda rows: spark.createDataFrame(rows, "k string, v string")
    got = {r.k: r.change for r in relational.compare_maps(pairs([("a", "1"), ("b", None), ("c", "1")]), pairs([("a", "2"), ("b", None), ("d", None)]), ["k"], "v").collect()}
    assert got == {"a": "changed", "c": "removed", "d": "added"}
    empty = relational.coverage(pairs([]), pairs([]), ["k"], ["k"]).collect()
    assert empty == []
