"""Numbering and footer tokens as relations, against cases worked out by hand."""

import html

from pyspark.sql import functions as F

from docframe.functions import edit
from docframe.operators import footers, numbering, styles

NUMS = "template_key string, num_id int, abstract_id int, xml string"
ABSTRACTS = "template_key string, abstract_id int, xml string"
USAGE = "file_key string, template_key string, style_id string, num_id int"
PART = '<w:numbering><w:abstractNum w:abstractNumId="4"><w:nsid w:val="AAAAAAAA"/></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="4"/></w:num></w:numbering>'


def parts(spark, *rows):
    return spark.createDataFrame(list(rows), "file_key string, xml string")


def test_numbering(spark):
    nums = spark.createDataFrame([("t", 8, 3, '<w:num w:numId="8" w16cid:durableId="1"><w:abstractNumId w:val="3"/></w:num>'), ("t", 9, 3, '<w:num w:numId="9"><w:abstractNumId w:val="3"/></w:num>'), ("t", 7, 77, "<w:num/>")], NUMS)
    abstracts = spark.createDataFrame([("t", 3, '<w:abstractNum w:abstractNumId="3"><w:nsid w:val="00000000"/></w:abstractNum>')], ABSTRACTS)
    usage = spark.createDataFrame(
        [("a", "t", "S", 8), ("a", "t", "S", 8), ("a", "t", "T", 9), ("empty", "t", "S", 9), ("none", "t", "S", 8), ("bad", "t", "X", 5), ("bad", "t", "Y", 5), ("lost", "t", "Z", 7), ("open", "t", "S", 8)], USAGE
    )
    targets = parts(spark, ("a", PART), ("empty", "<w:numbering></w:numbering>"), ("bad", PART), ("lost", PART), ("open", "<w:numbering>"), ("unused", PART))
    made = numbering.plan(usage, nums, abstracts, targets)
    assert sorted((r.file_key, r.rule, r.item, r.styles) for r in made.violations.collect()) == [("bad", "unknown_num", 5, ["X", "Y"]), ("lost", "unknown_abstract", 77, ["Z"]), ("none", "no_numbering_part", 8, ["S"])]
    assert sorted((r.file_key, r.style_id, r.old_id, r.new_id) for r in made.styles.collect()) == [("a", "S", 8, 3), ("a", "T", 9, 4), ("empty", "S", 9, 1), ("open", "S", 8, 1)]
    got = {r.file_key: r for r in numbering.inject(targets, made).collect()}
    assert set(got) == {"a", "empty", "open"} and got["open"].xml is None and "closed" in got["open"].error
    xml = got["a"].xml
    assert xml.index('w:abstractNumId="5"') < xml.index('<w:num w:numId="2"') < xml.index('w:numId="3"') < xml.index('w:numId="4"')
    assert xml.count('<w:abstractNumId w:val="5"/>') == 2 and 'w:nsid w:val="00000000"' not in xml and 'durableId="1"' not in xml
    again = numbering.plan(usage.where("file_key = 'a'"), nums, abstracts, parts(spark, ("a", xml)))
    fresh = again.abstracts.first().xml
    assert fresh.split('nsid w:val="')[1][:8] != xml.split('w:abstractNumId="5"')[1].split('nsid w:val="')[1][:8]  # the hash in use is avoided


def test_style_blocks(spark):
    sheet = '<w:styles><w:style w:styleId="A">1</w:style><w:style w:styleId="B"><w:numId w:val="x"/></w:style><w:style>no id</w:style><w:style w:styleId="A"><w:numId w:val="5"/></w:style></w:styles>'
    blocks = styles.style_blocks(parts(spark, ("k", sheet), ("n", None)), ["file_key"])
    ends = {r.style_id: (r.first_xml, r.last_xml) for r in styles.first_and_last(blocks, ["file_key"]).collect()}
    assert set(ends) == {"A", "B"} and ">1<" in ends["A"][0] and "numId" in ends["A"][1]
    assert [(r.style_id, r.num_id) for r in numbering.style_numbers(blocks, ["file_key"]).collect()] == [("A", 5)]


def test_replace_visible_equals_the_plain_edit(spark):
    texts = [["CON", "CRETE &amp; X - 03", " 30 00"], ["none"], ["a", "", "b"], ["CONCRETE CONCRETE"], ["x &lt;b"], []]
    xml = "<w:ftr>" + "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in ts) + "</w:p>" for ts in texts) + "</w:ftr>"
    wanted = [("k", 0, "Concrete", "no"), ("k", 1, "CONCRETE", "A < B"), ("k", 2, "ab", "c"), ("k", 3, "CON", "late"), ("k", 4, "", "never"), ("k", 5, None, "never")]
    rows = spark.createDataFrame([("k", "word/footer1.xml", xml), ("k", "word/footer2.xml", None), ("other", "word/footer1.xml", xml)], "file_key string, part_name string, xml string")
    got = {(r.file_key, r.part_name): r.xml for r in footers.replace_visible(rows, spark.createDataFrame(wanted, "file_key string, priority int, old string, new string")).collect()}
    want = xml
    for at in reversed(edit.find_all(xml, "w:p")):
        block = edit.outer(xml, at)
        seen = "".join(html.unescape(edit.inner(block, n)) for n in edit.visible_text_nodes(block))
        hit = next(((o, n) for _, _, o, n in wanted if o and o in seen), None)
        want = edit.put(want, at, edit.replace_visible(block, *hit, html.escape, html.unescape) if hit else block)
    assert got["k", "word/footer1.xml"] == want != xml and got["other", "word/footer1.xml"] == xml and got["k", "word/footer2.xml"] is None


def test_tokens(spark):
    final = spark.createDataFrame([("k", 0, "SectionID"), ("k", 1, "SectionTitle"), ("k", 5, "SectionTitle"), ("n", 0, "PART")], "file_key string, paragraph_index int, csi_role string")
    texts = spark.createDataFrame([("k", 0, "SECTION 09 13 29"), ("k", 1, "GYPSUM BOARD"), ("k", 5, "LATER"), ("n", 0, "PART 1")], "file_key string, paragraph_index int, text string")
    tokens = footers.document_tokens(final, texts).withColumn("title", F.lit("CONCRETE WORK")).withColumn("number", F.lit("03 30 00"))
    assert [(r.new_title, r.new_number) for r in tokens.collect()] == [("GYPSUM BOARD", "09 13 29")]
    xml = "<w:ftr><w:p><w:t>Concrete Work - 033000</w:t></w:p><w:p><w:t>CONCRETE WORK 03 30 00</w:t></w:p></w:ftr>"
    rows = spark.createDataFrame([("k", "f", xml)], "file_key string, part_name string, xml string")
    assert footers.patch_tokens(rows, tokens).first().xml == "<w:ftr><w:p><w:t>Gypsum Board - 091329</w:t></w:p><w:p><w:t>GYPSUM BOARD 09 13 29</w:t></w:p></w:ftr>"
    assert footers.patch_tokens(rows, tokens.limit(0)).first().xml == xml
