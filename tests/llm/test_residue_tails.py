"""Messages with a variable tail, prompts, keyboard mash, repeats anywhere and escaped slots."""

import time

import pytest

from docframe.llm import residue

AUTOMATON = residue.build_automaton()


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Something went wrong while loading this section (code 0x56451181).", "error"), ("Provide pumps. Something went wrong while loading this section (code 0xC030BC9C). Provide valves.", "error"), ("L. Something went wrong while reading the part.", "error"), ("An error occurred in the module that prepares the page (ref 7-12).", "error"),
        ("Click or tap here to enter section number.", "filler"), ("G. Click or tap here to enter revision.", "filler"), ("Cliquez ici pour entrer la date de remise.", "filler"),
        ("qwer qwer zxcv zxcv asdfgh zxcv", "filler"), ("1. jkl; zxcv jkl;", "filler"), ("jkl; jkl;", "filler"), ("Provide pumps. asdf hjkl", "filler"), ("qwеr asdf", "filler"),
        ("Provide it. same words same words same words.", "filler"), ("Provide it.\nvexo vexo vexo vexo", "filler"), ("- vexo vexo vexo", "filler"),
        ("The &lt;phase&gt; shall approve the samples.", "slot"), ("Project: (enter phase)", "slot"),
    ],
)
def test_found(text, kind):
    got = residue.scan(text, AUTOMATON)
    assert got and got[0] == kind, got


@pytest.mark.parametrize(
    "text",
    [
        '"Something went wrong (code 0x12)" shall be shown on the operator panel when the web module is offline.', "Under maintenance contract code 12 the pumps and the valves shall be serviced each month.",
        "Provide a QWERTY keyboard.", "Layouts: AZERTY; QWERTY; QWERTZ.", "Types ABC; JKL; MNO.", "Wire phases A A and N to the panel, pump pump valve.", "Access (enter by the north door) is free.", "Moisture &lt; 5 percent and &gt; 2 later.", "Click each terminal home before the cover is closed.",
    ],
)
def test_genuine(text):
    assert residue.scan(text, AUTOMATON) is None


def test_repeats_have_at_most_three_words():
    assert residue.repeated("pump valve tower riser " * 2000, 0) == [] and residue.repeated("a pump valve pump valve pump valve b", 0) == [(2, 35)]


@pytest.mark.parametrize("text", ["[Insert manufacturer, model number and finish as selected from the full range of standard colours and textures of the maker]", "{{" + "a" * 200 + "}}", "<equipment and material schedule of the separately tendered works package for level two>", "[" + "_" * 500 + "]", "<<" + "b" * 300 + ">>", "%" + "A" * 90 + "%"])
def test_slots_of_any_length(text):
    assert residue.scan(f"Provide {text} now", AUTOMATON)[0] == "slot"


def test_short_texts_are_scanned(spark):
    rows = spark.createDataFrame([("f", 0, "[]"), ("f", 1, "ab"), ("f", 2, ""), ("f", 3, None)], "file_key string, paragraph_index int, text string")
    assert [(r.paragraph_index, r.kinds) for r in residue.find_residue(rows, ["file_key", "paragraph_index"]).collect()] == [(0, "slot")]


@pytest.mark.parametrize("opener", ["[", "{{", "<<", "<a", "%A", "(enter x", "[insert ", "@@a", "__a", "«a", "&lt;a"])
def test_unclosed_openers_take_linear_time(opener):
    began = time.time()
    residue.scan(opener * 50_000, AUTOMATON)
    assert time.time() - began < 20
