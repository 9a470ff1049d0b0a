"""Layout, fonts, spans, ranks, steps and tables on small cases, with nulls, empty tables and clashing columns."""

import json

import pytest
from pyspark.sql import functions as F

from docframe import session
from docframe.functions import markup
from docframe.operators import environment, layout, relational, styles
from docframe.sources import registry

TARGET = "file_key string, template_key string, pos bigint, xml string"
CHAIN = "template_key string, pos bigint, source string"


def test_section_sources(spark):
    section = '<w:sectPr><w:pgSz w:w="1"/></w:sectPr>'
    targets = spark.createDataFrame([("a", "t", 0, section), ("a", "t", 1, section), ("b", "u", 0, section), ("c", "u", 0, section), ("c", "u", 1, None), ("d", None, 0, section)], TARGET).withColumn("source", F.lit("clash"))
    chains = spark.createDataFrame([("t", 0, '<w:sectPr><w:pgSz w:w="7"/></w:sectPr>'), ("u", 0, '<w:sectPr><w:pgSz w:w="8"/></w:sectPr>')], CHAIN)
    defaults = spark.createDataFrame([("t", '<w:sectPr><w:pgSz w:w="d"/></w:sectPr>')], "template_key string, source string")
    sources = layout.section_sources(targets, chains, defaults)
    merged = {(r.file_key, r.pos): r.xml for r in layout.merged_sections(targets, sources).collect()}
    assert [merged["a", i][23:24] for i in (0, 1)] == ["7", "d"] and '"8"' in merged["b", 0] and merged["c", 1] is None and merged["d", 0] == section
    wrong = {(r.file_key, r.n_sections, r.n_chain) for r in layout.section_violations(targets, chains, defaults).collect()}
    assert wrong == {("c", 2, 1), ("d", 1, 0)}
    assert layout.merged_sections(targets.limit(0), layout.section_sources(targets.limit(0), chains, defaults)).collect() == []


def test_fonts(spark):
    tables = spark.createDataFrame([("a", '<w:fonts><w:font w:name="X">1</w:font><w:font w:name="Y"></w:font><w:font w:name="X">2</w:font></w:fonts>'), ("b", None), ("c", "")], "k string, xml string").withColumn("name", F.lit("clash"))
    rows = environment.font_rows(tables, ["k"])
    assert sorted((r.k, r.name, r.pos) for r in rows.collect()) == [("a", "X", 0), ("a", "Y", 1)] and ">1<" in rows.where("name = 'X'").first().xml
    have = environment.font_rows(spark.createDataFrame([("a", '<w:fonts><w:font w:name="Y"></w:font></w:fonts>')], "k string, xml string"), ["k"])
    assert [r.name for r in environment.missing_fonts(rows, have, ["k"]).collect()] == ["X"]


def test_placed_spans(spark):
    xml = "<w:p>a</w:p><w:tbl><w:p>b</w:p><w:tbl><w:p>c</w:p></w:tbl><w:p>d</w:p></w:tbl><w:p/><w:p>e</w:p><w:p>open"
    rows = spark.createDataFrame([(0, xml), (1, None), (2, "")], "i int, x string").select("i", markup.placed_spans(F.col("x"), "w:p", "w:tbl").alias("s"))
    got = {r.i: r.s for r in rows.collect()}
    # A table ends at the first closing tag, as blocks do, so what follows an inner table stands outside.
    assert [(s.xml[5:6], s.inside) for s in got[0]] == [("a", False), ("b", True), ("c", True), ("d", False), (">", False)] and all(xml[s.start : s.stop] == s.xml for s in got[0])
    assert got[1] is None and got[2] == []


def test_ranks_of_a_hot_key_and_ties(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") < 300, None).otherwise("b").alias("k"), F.expr("id div 2").alias("v"), F.lit("clash").alias("__n"))
    got = relational.numbered(rows, ["k"], [F.col("v").desc()]).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.pos, r.v))
    assert {k: len(v) for k, v in by.items()} == {"hot": 2000, None: 100, "b": 900}
    for pairs in by.values():
        pairs.sort()
        assert [p for p, _ in pairs] == list(range(len(pairs))) and [v for _, v in pairs] == sorted((v for _, v in pairs), reverse=True)
    assert relational.numbered(rows.limit(0), ["k"], [F.col("v")]).collect() == []


def test_steps_fail_alone(spark):
    template = json.dumps({"headers_footers": {"headers": [{"part_name": "word/header1.xml", "xml": "<w:hdr/>"}]}})
    rows = spark.createDataFrame([("bad", {"a": "x"}, template), ("good", {environment.RELS_PART: "<Relationships/>", "none": None}, template)], "file_key string, parts map<string,string>, template string")
    got = {r.file_key: r for r in environment.step_rows(rows, "headers").collect()}
    assert got["bad"].parts is None and "word/_rels/document.xml.rels" in got["bad"].error
    assert 'Target="header1.xml"' in got["good"].parts[environment.RELS_PART] and got["good"].error is None
    assert environment.step_rows(rows.limit(0), "theme").collect() == []
    sheet = '<w:styles><w:style w:type="paragraph" w:styleId="A"><w:basedOn w:val="Gone"/></w:style></w:styles>'
    done = styles.import_rows(spark.createDataFrame([("x", "<w:styles></w:styles>", sheet, ["A"]), ("y", "<w:styles></w:styles>", sheet, [])], "file_key string, target string, template string, wanted array<string>"))
    assert {r.file_key: (r.error is None, r.done) for r in done.collect()} == {"x": (False, None), "y": (True, {})}


def test_numbering_rows(spark):
    text = json.dumps({"numbering": {"nums": [{"numId": 1, "abstractNumId": 2, "xml": "old"}, {"numId": 1, "abstractNumId": 3, "xml": "new"}, {"numId": None, "abstractNumId": 2}], "abstract_nums": [{"abstractNumId": 2}]}})
    frame = spark.createDataFrame([("t", text), ("none", "{}"), ("null", None)], "k string, json string").select("k", registry.parsed(F.col("json"), registry.TEMPLATE_SCHEMA).alias("j")).select("k", "j.*")
    nums, abstracts = registry.numbering_rows(frame, ["k"])
    assert [tuple(r) for r in nums.collect()] == [("t", 1, 3, "new")] and [tuple(r) for r in abstracts.collect()] == [("t", 2, "")]


def test_raw_parts(spark, tmp_path):
    assert registry.raw_part(spark, str(tmp_path), registry.RAW_STYLES) is None
    (tmp_path / registry.RAW_STYLES).write_text("<w:styles>\n</w:styles>")
    assert registry.raw_part(spark, f"file:{tmp_path}", registry.RAW_STYLES) == "<w:styles>\n</w:styles>"


def test_tables_end_with_their_block(spark):
    import pathlib
    import re

    with session.temporary_tables():
        df, counts = session.cut_counted(spark.range(10), n=F.count(F.lit(1)), low=F.count_if(F.col("id") < 3))
        assert counts == {"n": 10, "low": 3} and df.count() == 10
        path = pathlib.Path(re.sub("^file:/*", "/", df.inputFiles()[0])).parent
        assert path.exists()
    assert not path.exists()


@pytest.mark.parametrize("keys", [(), ("id",)])
def test_spread(spark, keys):
    got = session.spread(spark.range(5), *keys)
    assert got.count() == 5 and got.rdd.getNumPartitions() >= 4
