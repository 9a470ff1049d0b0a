"""Many small packages: what each of them costs beyond the work on it."""

from pyspark.sql import functions as F

from docframe.functions import markup, text
from docframe.operators import pipeline
from docframe.plans import text_queries
from docframe.session import each_group
from docframe.sources import docx


def test_small_packages_share_tasks(spark, tmp_path):
    names = [f"p{i:03}" for i in range(100)]
    rows = spark.createDataFrame([(n, o, p, 8, bytearray(f"<a>{n}</a>".encode())) for n in names for o, p in enumerate(("b.xml", "a.xml"))], "file_key string, ordinal int, part_name string, compress_type int, content binary")
    folder = str(tmp_path / "in")
    assert {(r.file_key, r.path) for r in docx.write_packages(rows, folder).collect()} == {(n, f"{folder}/{n}.docx") for n in names}
    (tmp_path / "in" / "empty.docx").write_bytes(b"")
    for hidden in ("_x.docx", ".x.docx", "x.txt"):
        (tmp_path / "in" / hidden).write_bytes(b"x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        parts = docx.read_packages(spark, folder)
        assert parts.rdd.getNumPartitions() == 4
        got = sorted((r.path, r.ordinal, r.part_name, None if r.content is None else bytes(r.content)) for r in parts.where("error is null").collect())
        assert got == [(f"file:{folder}/{n}.docx", o, p, f"<a>{n}</a>".encode()) for n in names for o, p in enumerate(("b.xml", "a.xml"))]
        assert [r.path for r in parts.where("error is not null").collect()] == [f"file:{folder}/empty.docx"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_groups_across_batches(spark):
    rows = spark.range(0, 3000, 1, 7).select((F.col("id") % 5).cast("string").alias("k"), (-F.col("id")).alias("i"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = each_group(rows, ["k"], [F.col("i")], lambda rows: [(rows[0]["k"], len(rows), [r["i"] for r in rows] == sorted(r["i"] for r in rows))], "k string, n int, sorted boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(str(k), 600, True) for k in range(5)]


def test_breaches_as_the_relations_find_them(spark):
    block = lambda t, p="", r="": f"<w:p>{p}<w:r>{r}<w:t>{t}</w:t></w:r></w:p>"
    before = block("a") + block("b", '<w:pPr><w:jc w:val="x"/></w:pPr>') + block("c", r="<w:rPr><w:sz/><w:b/></w:rPr>") + block("d", "<w:pPr><w:sectPr/></w:pPr>") + block("e")
    changes = {
        "same": before, "styled": before.replace("<w:p><w:r>", '<w:p><w:pPr><w:pStyle w:val="P"/></w:pPr><w:r>'), "bold": before.replace("<w:b/>", ""), "sizes": before.replace("<w:sz/>", '<w:sz w:val="1"></w:sz>'),
        "less": before.replace(block("e"), ""), "more": before + block("f"), "section": before.replace(">d<", ">x<"), "layout": before.replace("w:jc", "w:outlineLvl"),
    }
    frame = lambda texts: spark.createDataFrame([(k, pipeline.DOCUMENT, bytearray(x.encode())) for k, x in texts.items()], "file_key string, part_name string, content binary")
    want = {tuple(r) for r in pipeline.contract_violations(frame(dict.fromkeys(changes, before)), frame(changes)).collect()}
    assert {k for k, _ in want} == {"bold", "less", "more", "layout"}
    assert {(k, e) for k, x in changes.items() for e in pipeline.breaches(before.encode(), x.encode())} == want


def test_paragraph_rows_as_the_columns_give_them(spark):
    block = '<w:p w:x="1"><w:pPr><w:pStyle  w:val="A&amp;b"/><w:numPr><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:t xml:space="preserve"> a&nbsp;&lt;b \t c</w:t><w:tab/><w:t>&amp;amp; d </w:t></w:r></w:p>'
    docs = spark.createDataFrame([("a", f"<w:tbl>{block}</w:tbl>{block}<w:p/><w:p><w:pPr><w:sectPr/></w:pPr></w:p><w:pX></w:pX>{block}"), ("b", None), ("c", ""), ("d", "<w:p><w:t></w:t></w:p><w:tbl><w:p>")], "file_key string, xml string")
    spans = docs.where("xml is not null").select("file_key", F.posexplode(markup.placed_spans(F.col("xml"), "w:p", "w:tbl")).alias("i", "p"))
    x = F.col("p.xml")
    want = spans.where(~markup.has_section_break(x)).select("file_key", "i", "p.inside", markup.block_text(x), markup.attribute(x, "w:pStyle"), markup.attribute(x, "w:numId"), x)
    assert sorted(map(repr, map(tuple, markup.paragraph_rows(docs).collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_rules_hit_only_what_holds_their_texts(spark):
    probes = [*text_queries.PROBES, "SEE the Evaluations here", "PAGE 3 OF 9", "- 4 -", "3 of 7", "REV. A", "= = =", "KEEP (C) 2020", "plain", "", None]
    frame = spark.createDataFrame([(p,) for p in probes], "t string")
    assert len(text.NEEDED) == len(text.BOILERPLATE)
    assert frame.where(~text.strip_boilerplate(F.col("t")).eqNullSafe(text.strip_boilerplate(F.col("t"), text.BOILERPLATE))).collect() == []
