"""Column functions and edits on small cases, nulls and empty texts included."""

import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docframe.functions import edit, ids, markup, text
from docframe.operators import context, relational
from docframe.operators.styles import Sheet, import_styles, same


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_lines(spark):
    assert column(spark, ["a\r\nb\rc\nd", "", None], text.lines) == [["a", "b", "c", "d"], [""], None]


def test_markers(spark):
    values = ["A. x", "12. x", "b. x", "A.x", "1.02 X", "", None, " C. y"]
    assert column(spark, values, text.marker_type) == ["upper_alpha", "number", "lower_alpha", None, None, None, None, "upper_alpha"]
    assert column(spark, ["x", None], lambda v: text.marker_type(v, F.lit("0"))) == ["list_numpr", "list_numpr"]


@pytest.mark.parametrize(
    ("value", "previous", "role"),
    [
        ("SECTION 09 13 29", None, "SectionID"), ("SECTION 091329", None, None), ("Section 01 02 03 - x", None, "SectionID"), ("end of sectional", None, "END_OF_SECTION"),
        ("PART 2 PRODUCTS", None, "PART"), ("PART 4", None, None), ("PARTS", None, None), ("1.02 SUMMARY", None, "ARTICLE"), ("1.2 X", None, None), ("GYPSUM BOARD", "SECTION 09 13 29", "SectionTitle"),
        ("GYPSUM BOARD", "x", None), ("Gypsum board", "SECTION 09 13 29", None), ("A. x", None, "PARAGRAPH"), ("1. x", None, "SUBPARAGRAPH"), ("a. x", None, "SUBSUBPARAGRAPH"), ("", None, None), (None, None, None),
    ],
)
def test_rule_role(spark, value, previous, role):
    make = lambda v: text.rule_role(v, text.marker_type(v), F.lit(previous).cast("string"), F.lit(False))
    assert column(spark, [value], make) == [role]
    assert column(spark, [value], lambda v: text.rule_role(v, text.marker_type(v), F.lit(previous).cast("string"), F.lit(True))) == [None]


def test_available_role(spark):
    have = F.array(F.lit("PARAGRAPH"), F.lit("SectionTitle"))
    assert column(spark, ["SUBSUBPARAGRAPH", "SectionID", "PART", "Odd", None], lambda v: text.available_role(v, have)) == ["PARAGRAPH", "SectionTitle", None, None, None]


def test_strip_boilerplate(spark):
    values = ["Provide boards.", "Page 3 of 12", "Copyright 2031 Somebody", "Boards.\n-----\nMore.", "[Note to specifier: choose one]", "", None, "Provide pages 3 of 12 sets", "REV. 2", "All rights reserved."]
    got = column(spark, values, text.strip_boilerplate)
    assert [(g.text, g.tags) for g in got] == [
        ("Provide boards.", []), ("", ["page_number"]), ("", ["copyright"]), ("Boards.\n\nMore.", ["separator"]), ("", ["specifier_note"]), ("", []), (None, []), ("Provide pages 3 of 12 sets", []),
        ("", ["revision_mark"]), ("", ["copyright"]),
    ]


def test_strip_is_idempotent(spark):
    values = ["a\nPage 2\n\n\n\nb  \nc", "REV 1\nREV 2", "x (c) 2030 y\nz"]
    once = [g.text for g in column(spark, values, text.strip_boilerplate)]
    assert [g.text for g in column(spark, once, text.strip_boilerplate)] == once


def test_case(spark):
    values = ["DIRECT-DIGITAL HVAC", "O'BRIEN AIR", "Mixed CASE", "", "lower words", "Air And water Pipe"]
    assert column(spark, values, text.title_case) == ["Direct-Digital HVAC", "O'Brien Air", "Mixed Case", "", "lower words", "Air And water Pipe"]
    assert column(spark, values, text.case_pattern) == ["upper", "upper", "title", "unknown", "mixed", "title"]


def test_section_number(spark):
    values = ["SECTION 09 13 29 - X", "no 4 and 5", "none", ""]
    assert column(spark, values, text.section_number) == ["09 13 29", "4 5", "", ""]


def test_blocks(spark):
    xml = "<w:p/><w:p>a</w:p>x<w:pPr>no</w:pPr><w:p r='1'>b</w:p><w:p>open"
    assert column(spark, [xml, "", None], lambda v: markup.blocks(v, "w:p")) == [["<w:p/><w:p>a</w:p>", "<w:p r='1'>b</w:p>"], [], None]
    spans = column(spark, [xml], lambda v: markup.block_spans(v, "w:p"))[0]
    assert [xml[s.start : s.stop] for s in spans] == ["<w:p/><w:p>a</w:p>", "<w:p r='1'>b</w:p>"]
    twice = "<w:p>a</w:p><w:p>a</w:p>"
    assert [(s.start, s.stop) for s in column(spark, [twice], lambda v: markup.block_spans(v, "w:p"))[0]] == [(0, 12), (12, 24)]


def test_text_and_hints(spark):
    block = '<w:p><w:pPr><w:jc w:val="left"/><w:ind w:left="3"/></w:pPr><w:r><w:rPr><w:b w:val="0"/><w:i/></w:rPr><w:t xml:space="preserve"> a &amp;lt; </w:t></w:r><w:r><w:t>b&#233;</w:t></w:r></w:p>'
    assert column(spark, [block, "<w:p/>", None], markup.block_text) == ["a &lt; bé", "", None]
    hints = column(spark, [block], markup.run_hints)[0]
    assert (hints.bold, hints.italic, hints.underline) == (False, True, None)
    layout = column(spark, [block], markup.layout_hints)[0]
    assert (layout.jc, layout.ind.left, layout.spacing.after) == ("left", "3", None)


def test_fragment_error(spark):
    values = ["<w:pPr/>", "<w:pPr><w:jc/></w:pPr>", "", None, "<w:pPr>", "<w:rPr/>"]
    assert [e is None for e in column(spark, values, lambda v: markup.fragment_error(v, "w:pPr"))] == [True, True, True, True, False, False]


def test_ids(spark):
    assert column(spark, ["/a/b c.docx", "/x/b c.docx"], ids.file_key) != column(spark, ["/a/b c.docx", "/a/b c.docx"], ids.file_key)
    assert column(spark, ["k__chunk1__chunk12"], ids.request_key) == ["k__chunk1"] and column(spark, ["k__chunk1__chunk12"], ids.request_chunk) == [12]
    first = column(spark, ["x"], ids.short_hash)[0]
    assert column(spark, ["x"], lambda v: ids.free_hash(v, F.array(F.lit(first)))) not in ([first], [None])
    assert column(spark, [" ./media/a ", "../b", None], ids.relative_target) == ["media/a", "b", None]


PARAGRAPHS = ["<w:p><w:r><w:t>x</w:t></w:r></w:p>", "<w:p><w:pPr/><w:r/></w:p>", '<w:p><w:pPr><w:jc w:val="a"/></w:pPr></w:p>', '<w:p><w:pPr><w:pStyle w:val="Old"/></w:pPr></w:p>', '<w:p a="1"/>']


@pytest.mark.parametrize("block", PARAGRAPHS)
def test_with_style(block):
    once = edit.with_style(block, "New")
    assert once.count('<w:pStyle w:val="New"/>') == 1 and "Old" not in once
    assert edit.with_style(once, "New") == once


def test_section_breaks_are_left_alone():
    block = '<w:p><w:pPr><w:jc w:val="a"/><w:sectPr><w:rPr><w:sz/></w:rPr></w:sectPr></w:pPr></w:p>'
    assert block == edit.with_style(block, "N") == edit.without_direct_layout(block) == edit.without_run_fonts(block) == edit.restyle(block, "N", True)


def test_run_fonts():
    block = '<w:p><w:pPr><w:rPr><w:sz w:val="9"/></w:rPr></w:pPr><w:r><w:rPr><w:rFonts a="b"/><w:sz w:val="1"/></w:rPr><w:t>x</w:t></w:r><w:r><w:rPr><w:b/><w:szCs w:val="2"></w:szCs></w:rPr></w:r></w:p>'
    assert edit.without_run_fonts(block) == '<w:p><w:pPr><w:rPr><w:sz w:val="9"/></w:rPr></w:pPr><w:r><w:t>x</w:t></w:r><w:r><w:rPr><w:b/></w:rPr></w:r></w:p>'


def test_edits_keep_the_contract(spark):
    blocks = [*PARAGRAPHS[:4], '<w:p><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr><w:spacing w:after="1"/></w:pPr><w:r><w:rPr><w:sz w:val="3"/></w:rPr><w:t>y</w:t></w:r></w:p>']
    done = edit.column(lambda b: edit.restyle(b, "S", True))
    rows = spark.createDataFrame([(b,) for b in blocks], "b string")
    got = rows.select(markup.contract_form(F.col("b")).alias("a"), markup.contract_form(done("b")).alias("c")).collect()
    assert all(r.a == r.c for r in got)


def test_merge_section():
    target = '<w:sectPr r="1"><w:footerReference/><w:pgSz w:w="1"/><w:titlePg/><w:unknown/></w:sectPr>'
    source = '<w:sectPr><w:pgMar w:top="2"/><w:pgSz w:w="9"/><w:titlePg w:val="0"/></w:sectPr>'
    assert edit.merge_section(target, source) == '<w:sectPr r="1"><w:footerReference/><w:pgSz w:w="9"/><w:pgMar w:top="2"/><w:titlePg/><w:unknown/></w:sectPr>'
    assert edit.merge_section("<w:sectPr/>", source) == "<w:sectPr/>"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab&<", max_size=4), min_size=1, max_size=5), st.text("ab&<", min_size=1, max_size=4))
def test_replace_visible(texts, old):
    block = "<w:p>" + "".join(f"<w:r><w:t>{html.escape(t)}</w:t></w:r>" for t in texts) + "</w:p>"
    got = edit.replace_visible(block, old, "Z", html.escape, html.unescape)
    seen = "".join(html.unescape(edit.inner(got, n)) for n in edit.visible_text_nodes(got))
    assert seen == "".join(texts).replace(old, "Z", 1)


def test_styles():
    sheet = Sheet(
        '<w:styles><w:docDefaults><w:rPrDefault><w:rPr><w:lang w:val="d"/></w:rPr></w:rPrDefault></w:docDefaults>'
        '<w:style w:type="paragraph" w:styleId="A"><w:basedOn w:val="B"/><w:rPr><w:sz w:val="1"/></w:rPr></w:style>'
        '<w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/><w:link w:val="C"/><w:pPr><w:jc/></w:pPr><w:rPr><w:rFonts/></w:rPr></w:style>'
        '<w:style w:type="character" w:styleId="C"><w:next w:val="Gone"/></w:style></w:styles>'
    )
    assert sheet.dependencies(["A"]) == {"A", "B", "C", "Gone"}
    assert sheet.effective_runs("A") == {"w:rFonts": "<w:rFonts/>", "w:sz": '<w:sz w:val="1"/>', "w:lang": '<w:lang w:val="d"/>'}
    assert sheet.effective_paragraph("A") == "<w:jc/>"
    with pytest.raises(ValueError, match="Gone"):
        import_styles("<w:styles></w:styles>", sheet, ["A"])
    fine = Sheet(sheet.xml.replace("Gone", "Normal"))
    once, done = import_styles("<w:styles></w:styles>", fine, ["A"])
    assert done == {"A": "insert", "B": "insert", "C": "insert", "Normal": "implicit"}
    twice, again = import_styles(once, fine, ["A"])
    assert twice == once and set(again.values()) == {"skip", "implicit"}
    assert same("<a>\n b</a>", "<a> b</a>")


@pytest.mark.parametrize("size", [21, 25, 50])
def test_chunks_cover_all_rows(spark, size):
    for n in (1, 20, 21, 50, 51, 77, 130):
        rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("i"))
        chunks = context.overlapping_chunks(rows, ["k"], "i", size).collect()
        by = {}
        for r in chunks:
            by.setdefault(r.chunk, []).append(r.i)
        want, start = {}, 0
        while True:
            want[len(want)] = list(range(start, min(start + size, n)))
            if start + size >= n:
                break
            start += size - 20
        assert {c: sorted(x) for c, x in by.items()} == want


def test_chunks_must_advance(spark):
    with pytest.raises(ValueError, match="larger than the overlap"):
        context.overlapping_chunks(spark.range(3).withColumn("k", F.lit(1)), ["k"], "id", 20)


def test_blocks_do_not_matter(spark, monkeypatch):
    """Neighbours and running sums over small blocks equal those over one window, gaps, nulls and single rows included."""
    from pyspark.sql import Window

    rows = spark.range(200).select(F.when(F.col("id") % 5 == 0, "a").when(F.col("id") < 150, "b").otherwise("c").alias("k"), (F.col("id") * F.col("id")).alias("i"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("v"))
    w = Window.partitionBy("k").orderBy("i")
    want = rows.select("*", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"), (F.row_number().over(w) - 1).cast("bigint").alias("n"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("t"))
    for block in (1, 50, 10_000):
        monkeypatch.setattr(context, "BLOCK", block)
        got = context.running_sum(context.neighbours(rows, ["k"], "i", F.col("v")), ["k"], "i", F.lit(1), "n", "t")
        assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 200


def test_interval_join(spark):
    points = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 3), (None, 3)], "k string, at int")
    ranges = spark.createDataFrame([("a", 2, 5), ("a", 4, 9), ("a", 20, 20), ("a", 25, 99), ("c", 0, 9), ("b", 4, 5)], "k string, start int, stop int")
    for block in (1, 4, 1000):
        got = relational.interval_semi_join(points, ranges, ["k"], "at", block=block).collect()
        assert sorted(r.at for r in got) == [*range(2, 9), *range(25, 30)] and {r.k for r in got} == {"a"}


def test_insert_in_order(spark):
    rows = spark.sql("select array(struct('titlePg' as tag, 'a' as xml), struct('type' as tag, 'b' as xml)) as have, array(struct('pgSz' as tag, 'c' as xml), struct('zzz' as tag, 'd' as xml)) as new")
    put = relational.insert_in_order(F.col("have"), F.col("new"), markup.SECTION_ORDER)
    assert [e.xml for e in rows.select(put.alias("o")).first().o] == ["c", "a", "b", "d"]


def test_allocated_ids_are_disjoint(spark):
    new = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = relational.allocate_ids(new, spark.createDataFrame([], "n long"), "k", "n", -1).collect()
    assert [r.new_id for r in sorted(got, key=lambda r: r.k)] == list(range(1000))
