"""Queries over whole tables, against brute force on small ones made here."""

import re

from pyspark.sql import functions as F

from docframe.functions import text
from docframe.plans import catalog, text_queries


def test_closure_of_every_style(spark, tmp_path):
    rows = [
        ("t", " Body ", "Base", "Body", None, False, 1), ("t", "Base", None, None, "Ring", False, 1), ("t", "Ring", "Base", None, "Gone", False, 1), ("t", "Title1", "Base", None, None, False, 1),
        ("t", "ListItem", "Title1", None, None, False, 1), ("t", "ListItem", "Body", None, None, False, 2), ("t", "Old", "Base", None, None, True, 1), ("u", "Body", "Missing", None, None, False, 1), (None, "Body", "Base", None, None, False, 1),
    ]
    df = spark.createDataFrame(rows, "template_key string, style_id string, based_on string, next string, link string, is_deleted boolean, revision int")
    df.selectExpr("*", "'paragraph' as style_type", "'' as ppr", "'' as rpr", "timestamp '2026-01-01' as loaded_at").write.parquet(f"{tmp_path}/style_defs.parquet")
    edges = {("t", "Body"): {"Base", "Body"}, ("t", "Base"): {"Ring"}, ("t", "Ring"): {"Base", "Gone"}, ("t", "Title1"): {"Base"}, ("t", "ListItem"): {"Body"}, ("u", "Body"): {"Missing"}}
    want = set()
    for template, seed in edges:
        todo = [seed]
        while todo:
            at = todo.pop()
            if (template, seed, at) not in want:
                want.add((template, seed, at))
                todo += edges.get((template, at), ())
    got = [tuple(r) for r in catalog.QUERIES["dep_closure"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


TEXTS = [
    "ÄNDERUNG DER PRÜFUNG", "ПРИЁМКА И ПУСК", "“PART” – ‘TWO’ OF…", "Façade Öl　Über Ärger", "ΟΔΟΣ ΣΣ", "O’BRIEN ÉTÉ-HIVER HVAC-ÜBER", "SECTION 09 21 16 – Ä", "９ und １２", "Straße", "İZMİR İİ", "ǄUNGLA", "ПЕРВЫЙ второй", " ", " ",
    "", None, "PART 1 GENERAL", "line\nTWO\t3", "Été À Côté de", "中文 ABC", "section　０９ ４１", "SECTIONS 5, 6", "no digit", "½ ² ٣",
]
ACRONYMS = {"HVAC", "DDC", "PVC"}


def _title(word):
    if "-" in word:
        return "-".join(map(_title, word.split("-")))
    bare = "".join(c for c in word if c.isascii() and c.isalpha()).upper()
    return word if bare in ACRONYMS or not word.isupper() else word.title()


def _pattern(text):
    stripped = (text or "").strip()
    if not stripped or stripped == stripped.upper():
        return "upper" if stripped else "unknown"
    words = stripped.split()
    return "title" if sum(w[:1].isupper() for w in words) * 10 >= len(words) * 7 else "mixed"


def _number(text):
    named = re.search(r"SECTION\s+(\d[\d\s]*)", text or "", re.I)
    return " ".join(named[1].split() if named else re.findall(r"\d+", text or ""))


def test_cases_and_numbers_of_every_text(spark, tmp_path):
    spark.createDataFrame([("f", [(i, t, False, None) for i, t in enumerate(TEXTS)])], "file_key string, paragraphs array<struct<paragraph_index int, text string, in_table boolean, marker_type string>>").write.parquet(f"{tmp_path}/slim_bundle.parquet")
    cases = {r.idx: (r.pattern, r.title) for r in catalog.QUERIES["case_pattern"](spark, str(tmp_path)).collect()}
    assert cases == {i: (_pattern(t), None if t is None else " ".join(map(_title, t.split()))) for i, t in enumerate(TEXTS)}
    numbers = {r.idx: r.number for r in catalog.QUERIES["section_number"](spark, str(tmp_path)).collect()}
    assert numbers == {i: _number(t) for i, t in enumerate(TEXTS)}


def test_boilerplate_both_ways(spark):
    """All probes but the last four are boilerplate and go as a whole, or leave what stands around them."""
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(text_queries.PROBES)], "i int, t string").withColumn("s", text.strip_boilerplate(F.col("t")))
    got = [(r.t, r.s.text, r.s.tags) for r in frame.orderBy("i").collect()]
    assert all(clean in ("", "before  behind") and tags for _, clean, tags in got[:-4])
    assert all(clean == t and not tags for t, clean, tags in got[-4:])
    assert {t for *_, tags in got for t in tags} == {"specifier_note", "masterspec_instruction", "copyright", "separator", "page_number", "revision_mark", "hidden_text"}
