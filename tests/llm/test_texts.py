"""Characters, residue and quality on texts made here."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import characters, lookalikes, quality, residue

BUNDLE = "file_key string, paragraphs array<struct<paragraph_index int, text string, in_table boolean, marker_type string>>, extra int"


def bundles(spark, rows):
    return spark.createDataFrame([(k, None if ps is None else [(i, t, False, m) for i, t, m in ps], 1) for k, ps in rows], BUNDLE)


ENGLISH = "Provide the circulating pump and the cooling tower before the ceilings are closed. Store all valves near the riser. See Section 09 for boxes."
RUSSIAN = "Перед приёмкой датчик должен быть проверен и очищен. Не допускается крепить насосный узел к подвесному потолку, установить у шахты."


def reader():
    counts = {}
    for text in (ENGLISH, RUSSIAN):
        low = f" {text.lower()} "
        for a, b in zip(low, low[1:], strict=False):
            x, y = (ord(c) if c.isalpha() else 0 for c in (a, b))
            counts[x * lookalikes.ALPHABET + y] = counts.get(x * lookalikes.ALPHABET + y, 0) + 1
    return lookalikes.Reader(counts)


@pytest.mark.parametrize(
    ("odd", "plain", "why"),
    [
        ("Ｐｕｍｐ ２．１", "Pump 2.1", {"width"}), ("ﬁnal ﬂow", "final flow", {"width"}), ("café", "café", {"combining"}), ("pu​mp­", "pump", {"invisible"}), ("a b　c", "a b c", {"space"}),
        ("рump", "pump", {"lookalike"}), ("Тhе tоwеr", "The tower", {"lookalike"}), ("Χ. Provide the pump", "X. Provide the pump", {"lookalike"}), ("ΤΟWER", "TOWER", {"lookalike"}),
        ("Пepeд пpиёмкoй", "Перед приёмкой", {"lookalike"}), ("He допускается крепить", "Не допускается крепить", {"lookalike"}), ("tοwеr​", "tower", {"lookalike", "invisible"}),
        ("йод датчик", "йод датчик", {"combining"}),
    ],
)
def test_repaired(odd, plain, why):
    assert lookalikes.normalise(odd, reader()) == (plain, why)


@pytest.mark.parametrize(
    "text",
    [
        "", None, "plain", "façade für Öl", "“A” – owner’s… •", "½ ¾ m² ™ °C 25 µm 10 kΩ ΔT π-shaped ± ×", RUSSIAN, "T. " + RUSSIAN, "Включите JavaScript для просмотра", "line\nbreak\tand tab", "38 °C " + RUSSIAN, "x̣̂" * 0 + "q́",
    ],
)
def test_ordinary(text):
    assert lookalikes.normalise(text, reader()) == (text, set())


def test_micro_and_ohm_signs_agree():
    assert lookalikes.normalise("25 μm", reader()) == ("25 µm", set()) and lookalikes.normalise("Ω", reader()) == ("Ω", set())


def test_suspects_cover_every_change():
    """Whatever folding or reading may change must be found by the prefilter."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for code in range(0x20, 0x11000):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        changes = characters.fold(ch)[0] != ch or (ch in lookalikes.FORMS and not ch.isascii() and code >= 0x250)
        if changes and code > 0x7E:
            assert pc.match_substring_regex(pa.array([ch]), lookalikes.SUSPECT)[0].as_py(), hex(code)


def test_normalising_twice_changes_nothing():
    for text in ("Тhе ｔｏｗｅｒ​", "Пepeд пpиёмкoй", "a ́"):
        once = lookalikes.normalise(text, reader())[0]
        assert lookalikes.normalise(once, reader()) == (once, set())


def test_lookalike_table(spark):
    rows = [("f", [(0, ENGLISH, "number"), (1, "Тhе рump", "ｎｕｍｂｅｒ"), (1, "Тhе рump", "ｎｕｍｂｅｒ"), (2, None, " NUMBER "), (3, "", None), (None, "ｘ", None), (4, RUSSIAN, None)]), ("f", [(1, "Тhе рump", "ｎｕｍｂｅｒ")]), ("g", None), (None, [(0, "ｘ", None)]), ("h", [])]
    df = bundles(spark, rows)
    assert sorted((r.file_key, r.paragraph_index, r.reasons) for r in lookalikes.found(df).collect()) == [("f", 1, "lookalike,width"), ("f", 2, "space")]
    got = {(r.file_key, r.paragraph_index): (r.text, r.marker_type) for r in lookalikes.consistent(df).collect()}
    assert got == {("f", 0): (ENGLISH, "number"), ("f", 1): ("The pump", "number"), ("f", 2): (None, "number"), ("f", 3): ("", None), ("f", 4): (RUSSIAN, None)}
    assert lookalikes.found(bundles(spark, [])).collect() == []


def test_very_long_text():
    text = "Тhе pump and the tower. " * 4000
    assert lookalikes.normalise(text, reader()) == (text.replace("Т", "T").replace("е pump", "e pump"), {"lookalike"})


AUTOMATON = residue.build_automaton()


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Submit to {{ owner }} now", "slot"), ("Refer to ${phase}.", "slot"), ("For <<OWNER>> only", "slot"), ("as [TBD] on", "slot"), ("by [Insert site address] here", "slot"), ("the [      ] shall", "slot"),
        ("at ____________ today", "slot"), ("in XXXXXX there", "slot"), ("%REVISION%", "slot"), ("«siteAddress»", "slot"), ("the [EQUIPMENT TAG] x", "slot"), ("on <unit mark> it", "slot"), ("Paragraph xxxxxxxx", "slot"),
        ("Error! Bookmark missing.", "error"), ("404 - the page you asked for was not found", "error"), ("Provide pumps. Seite nicht gefunden", "error"), ("Seite nicht gefunden The pump shall run.", "error"), ("#REF!", "error"),
        ("Страница не найдена", "error"), ("A. Access denied. You lack permission to open this document.", "error"), ("Ａｃｃｅｓｓ ｄｅｎｉｅｄ．", "error"), ("Loading, please wait...", "error"),
        ("Lorem ipsum dolor sit amet.", "filler"), ("Provide it. Lorem ipsum brivis vexim.", "filler"), ("Heading 1 Heading 2 Heading 3", "filler"), ("Hier Text eingeben.", "filler"), ("blah blah blah", "filler"), ("A. Text Text Text Text", "filler"), ("Provide it. Text Text Text", "filler"), ("same words same words same words.", "filler"), ("Filler line filler filler", "filler"),
        ("Please enable JavaScript to view this page.", "script"), ("Включите JavaScript для просмотра страницы.", "script"), ("Bключитe JavaScript для пpocмoтpa cтpaницы.", "script"), ("Veuillez activer JavaScript pour afficher ce document.", "script"),
    ],
)
def test_residue_found(text, kind):
    got = residue.scan(text, AUTOMATON)
    assert got and kind in got[0], got


@pytest.mark.parametrize(
    "text",
    [
        "", None, 'The panel shall show the text "page not found" when the web module is offline.', "Error logs shall be kept for 30 days.", "Insert the sleeve before the concrete is placed.", "Stages {1, 2, 4} shall run.",
        "Clearance [900 mm] shall be kept.", "Moisture <0.5 percent at delivery, > 2 later.", "Provide Schedule XXS pipe.", "Enable scripting on the workstation and record each change.", "Replace rejected sample panels with new ones.",
        "Missing bolts shall be found and replaced.", "Placeholder plates shall close unused openings in the rack.", "10 % and 20 % mixes, 5 * 3, a_b.", "Access to the plant room is denied to other trades.", "1. 2. 3.", "1 1 1 1", "No. No. Paint filler boards and dummy plugs at the filler panel edge before the first test.", "pump pump valve",
    ],
)
def test_genuine_text(text):
    assert residue.scan(text, AUTOMATON) is None


def test_residue_table(spark):
    df = bundles(spark, [("f", [(0, "Lorem ipsum dolor.", None), (0, "Lorem ipsum dolor.", None), (1, "Provide pumps.", None), (2, None, None), (3, "pump valve tower riser " * 20_000 + "{{a}}", None)]), ("f", [(0, "Lorem ipsum dolor.", None)])])
    rows = residue.paragraphs(df)
    keys = ["file_key", "paragraph_index"]
    got = residue.find_residue(rows, keys).collect()
    assert sorted((r.paragraph_index, r.kinds) for r in got) == [(0, "filler"), (3, "slot")] and max(r.coverage for r in got) == 1.0
    assert sorted(r.paragraph_index for r in residue.exclude_residue(rows, keys).collect()) == [1, 2]
    assert residue.find_residue(rows.limit(0), keys).collect() == []


COMMON = {"en": ["the", "of", "and", "to", "in", "for", "shall", "be", "is", "with", "at"], "ru": ["и", "в", "не", "к", "быть"]}


def brute(text):
    words = [w for w in "".join(c if c.isalpha() else " " for c in text or "").split()]
    lines = [x for x in (text or "").replace("\r", "\n").split("\n") if x.strip()]
    seen = [c for c in text or "" if not c.isspace()]
    return {
        "n_words": len(words),
        "mean_word_length": sum(map(len, words)) / max(len(words), 1),
        "longest_word": max(map(len, words), default=0),
        "digit_share": sum(c.isdigit() for c in seen) / max(len(seen), 1),
        "letter_share": sum(map(len, words)) / max(len(seen), 1),
        "symbol_share": sum(c in quality.SYMBOLS for c in seen) / max(len(seen), 1),
        "common_share": max(sum(w.lower() in ws for w in words) for ws in COMMON.values()) / max(len(words), 1),
        "distinct_share": len({w.lower() for w in words}) / max(len(words), 1),
        "n_lines": len(lines),
        "ended_line_share": sum(x.rstrip()[-1] in quality.ENDS for x in lines) / max(len(lines), 1),
        "n_common": max(sum(w.lower() in ws for w in words) for ws in COMMON.values()),
        "symbol_word_ratio": len(re.findall(r"#|…|\.{3,}", text or "")) / max(len(words), 1),
        "ellipsis_line_share": sum(x.rstrip().endswith(("…", "...")) for x in lines) / max(len(lines), 1),
        "alpha_word_share": sum(any(map(str.isalpha, w)) for w in (text or "").split()) / max(len((text or "").split()), 1),
    }


PROSE = "Provide the pump at the riser and keep it in service. The valve shall be set with care for the owner.\nIt is to be tested in the order of the drawings, and the log shall be kept."
TEXTS = [PROSE, "", None, "a) pump;\nb) valve;\nc) tank;\nd) fan;", "| A | 1 |\n| B | 2 |\n| C | 3 |", "------", "  \n \r\n ", "Ünïcode Ä и в не к", "x" * 5000, "word", PROSE.replace("\n", "\r\n"), "😀 mixed \U0001f600 text.", "end.\n\n\n", "# one ... two…\n3 4 x5.....\nto be …", "....", "a ..\n... b"]


def test_counts_equal_brute_force():
    texts = [t if t is None else t.encode("utf-16", "surrogatepass").decode("utf-16") for t in TEXTS]
    got = quality.Counter(COMMON).count(texts)
    for i, text in enumerate(texts):
        for name, value in brute(text).items():
            assert got[name][i] == pytest.approx(value), (i, name)


def test_batches_do_not_matter():
    counter = quality.Counter(COMMON)
    whole = counter.count(TEXTS[:9])
    for i in range(9):
        one = counter.count([TEXTS[i]])
        assert all(np.isclose(one[c][0], whole[c][i]) for c in quality.STATISTICS)


def test_assess(spark):
    rows = [(1, PROSE), (2, "- pump\n- valve\n- tank\n- fan\n- filter"), (3, "Mark,Item,Qty\nA-1,pump,3\nA-2,valve,4\nA-3,tank,5"), (4, "e9673b92 c7fce159 ab6aab0c a23a23d7"), (5, None), (6, ""), (7, PROSE + "\n- pump\n- valve"), (7, PROSE)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    common = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws] + [(None, "x")], "lang string, word string")
    got = quality.assess(docs, common)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.reasons for r in by[7]] == ["", ""] and by[1][0].kind == "prose" and by[3][0].kind == "table" and by[2][0].kind == "list" and by[4][0].kind == "junk"
    assert by[5][0].reasons.startswith("empty") and by[6][0].reasons.startswith("empty")
    assert sorted(r.doc_id for r in quality.not_prose(got).collect()) == [2, 3, 4, 5, 6]
    assert quality.assess(docs.limit(0), common).collect() == []


def test_labelled_sample():
    """Held-out accuracy on the labelled documents that annotators agree on."""
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.1"
    try:
        rows = duckdb.sql(f"select any_value(label) as l, any_value(text) as t from '{folder}/doc_labels.parquet' join '{folder}/documents.parquet' using (doc_id) group by doc_id having count(distinct label) = 1").fetchall()
        words = duckdb.sql(f"select lang, list(word) from '{folder}/common_words.parquet' group by lang").fetchall()
    except Exception:
        pytest.skip("no test data")
    reasons, _ = quality.judge(quality.Counter(dict(words)).count([t for _, t in rows]))
    right = sum((label == "prose") == (not r) for (label, _), r in zip(rows, reasons, strict=True))
    assert right / len(rows) >= 0.98
