"""Visually identical text with different characters, brought to one consistent form.

Each text is folded (full-width and ligature forms, odd spaces, ignorable characters, canonical
composition; see :mod:`docframe.llm.characters`). Texts that then mix scripts are read as a
lattice: every letter offers its observed form and its look-alikes in Latin, Cyrillic and Greek,
and a Viterbi search picks the path with the best sum of character bigram scores of its script,
less a cost for each changed letter, for each change of script between words, and a large one
inside a word. So a Cyrillic letter in a Latin word, a Latin word typed with Cyrillic look-alikes
and a lone look-alike in foreign surroundings are all repaired, while words really written in
another script keep their letters. Greek letters without look-alike (symbols such as a delta) are
neutral.

The bigram scores are counted over all texts of the table in one extra pass: one vectorised count
per Arrow batch, summed by code pair. The result is bounded by the square of the alphabet and is
all that reaches the driver.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.characters import CYRILLIC, GREEK, LATIN_OF_CYRILLIC, LATIN_OF_GREEK, fold
from docframe.llm.residue import paragraphs

#: Costs of a changed letter, of another script for the next word, and of another script inside a word.
SWAP, SWITCH, BREAK = 1.5, 6.0, 14.0
#: Alphabet of the model: all letters below this code point (Latin, Greek, Cyrillic); the rest counts as a word border.
ALPHABET = 0x530
SCRIPTS = "LCG"
#: Characters counted together.
PART = 2_000_000

# RE2 pattern: any character that folding or the lattice may change. Plain are ASCII, Latin letters and signs,
# Greek letters without look-alike and typographic punctuation.
SUSPECT = (
    r"[^\t\n\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{180}-\x{1c3}\x{1cd}-\x{1f0}\x{1f4}-\x{24f}"
    r"\x{393}\x{394}\x{398}\x{39b}\x{39e}\x{3a0}\x{3a3}\x{3a6}\x{3a8}\x{3a9}\x{3b2}\x{3b4}-\x{3b8}\x{3bb}\x{3be}\x{3c0}\x{3c2}-\x{3c4}\x{3c6}\x{3c8}\x{3c9}"
    r"\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2025}-\x{2027}\x{2030}-\x{2035}\x{2038}-\x{203a}\x{20ac}\x{2122}\x{2190}-\x{222b}\x{222e}\x{2231}-\x{22ff}]"
)


def _script(ch: str) -> str:
    code = ord(ch)
    if code < 0x250:
        return "L"
    if 0x400 <= code < 0x530:
        return "C"
    if 0x370 <= code < 0x400:
        return "G"
    return ""


def _forms() -> dict[str, dict[str, str]]:
    """For each letter with look-alikes, also accented ones: script to letter."""
    pairs = []
    for other, latin, script in ((CYRILLIC, LATIN_OF_CYRILLIC, "C"), (GREEK, LATIN_OF_GREEK, "G")):
        for o, x in zip(other, latin, strict=True):
            pairs.append((script, o, x))
            for mark in map(chr, range(0x300, 0x32C)):
                accented = unicodedata.normalize("NFC", o + mark), unicodedata.normalize("NFC", x + mark)
                if len(accented[0]) == len(accented[1]) == 1:
                    pairs.append((script, *accented))
    of_latin: dict[str, dict[str, str]] = {}
    for script, o, x in pairs:
        of_latin.setdefault(x, {"L": x}).setdefault(script, o)
    forms = {x: dict(group) for x, group in of_latin.items()}
    for script, o, x in pairs:
        forms[o] = {**of_latin[x], script: o}
    return forms


FORMS = _forms()
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_CYRILLIC = re.compile("[Ѐ-ԯ]")
_CYRILLIC_ONLY = re.compile(f"(?![{''.join(c for c in FORMS if _script(c) == 'C')}])[Ѐ-ԯ]")
_GREEK_ALIKE = re.compile(f"[{''.join(c for c in FORMS if _script(c) == 'G')}]")
_WORDS = re.compile(r"[^\W\d_]+")
_LABEL = re.compile(r"\s*([^\W\d_])[.)]\s")


class Reader:
    """Reads texts under a bigram model ``{prev * ALPHABET + cur: count}``."""

    def __init__(self, counts: dict[int, int]):
        totals: dict[int, int] = {}
        for pair, n in counts.items():
            totals[pair // ALPHABET] = totals.get(pair // ALPHABET, 0) + n
        self.score = {pair: math.log((n + 0.5) / (totals[pair // ALPHABET] + 0.5 * 64)) for pair, n in counts.items()}
        self.unseen = {a: math.log(0.5 / (n + 0.5 * 64)) for a, n in totals.items()}

    def pair(self, a: str, b: str) -> float:
        x = ord(a.lower()) if a else 0
        y = ord(b.lower()) if b else 0
        x, y = (x if x < ALPHABET else 0), (y if y < ALPHABET else 0)
        got = self.score.get(x * ALPHABET + y)
        return got if got is not None else max(self.unseen.get(x, -5.0), -9.0)

    def mixed(self, text: str) -> bool:
        """Whether the lattice may change the (folded) text."""
        cyrillic, greek = _CYRILLIC.search(text), _GREEK_ALIKE.search(text)
        if not cyrillic and not greek:
            return False
        return bool(_LATIN.search(text) or (cyrillic and greek) or not _CYRILLIC_ONLY.search(text))

    def read(self, text: str) -> str:
        """The text with every letter in its most likely script."""
        if not self.mixed(text):
            return text
        latin_only = sum(c not in FORMS for c in _LATIN.findall(text))
        home = "C" if len(_CYRILLIC_ONLY.findall(text)) > latin_only else "L"
        # Each state is a script with its best cost and the words chosen so far, as (earlier, word).
        states: dict[str, tuple[float, tuple]] = {s: (0.0 if s == home else SWITCH, ()) for s in SCRIPTS}
        spans = []
        label = _LABEL.match(text)
        for word in _WORDS.finditer(text):
            spans.append(word.span())
            if label and word.start() == label.start(1):
                # Outline labels are counted in Latin letters in any language.
                letter = FORMS.get(word[0], {}).get("L", word[0]) if home == "L" else word[0]
                states = {s: (cost, (chain, letter)) for s, (cost, chain) in states.items()}
                continue
            states = self._word(word[0], states, unit=word.start() > 0 and text[word.start() - 1] == "°")
        chain = min(states.values(), key=lambda x: x[0])[1]
        words = []
        while chain:
            chain, word = chain
            words.append(word)
        out, at = [], 0
        for (a, b), word in zip(spans, reversed(words), strict=True):
            out += text[at:a], word
            at = b
        return "".join(out) + text[at:]

    def _word(self, word: str, before: dict[str, tuple[float, tuple]], unit: bool) -> dict[str, tuple[float, tuple]]:
        """The states after one word. A letter after a degree sign is a unit and Latin."""
        layer = {}
        for s in SCRIPTS:
            cost, came = min((c + (0.0 if s == t else SWITCH), t) for t, (c, _) in before.items())
            layer[s] = (cost, came, "", "")
        greek_only = sum(_script(c) == "G" and c not in FORMS for c in word)
        for ch in word:
            forms = FORMS.get(ch)
            if forms is None:
                own = _script(ch)
                forms = dict.fromkeys(SCRIPTS, ch) if not own or (own == "G" and greek_only < 2) else {own: ch}
            elif unit and "L" in forms:
                forms = {"L": forms["L"]}
            new = {}
            for s, letter in forms.items():
                change = SWAP if letter != ch else 0.0
                new[s] = min(
                    (cost + change - self.pair(last if s == t else "", letter) + (0.0 if s == t else BREAK), came, done + letter, letter)
                    for t, (cost, came, done, last) in layer.items()
                    if s == t or last
                )
            layer = new
        return {s: (cost - self.pair(last, ""), (before[came][1], done)) for s, (cost, came, done, last) in layer.items()}


def normalise(text: str | None, reader: Reader) -> tuple[str | None, set[str]]:
    """The consistent form of a text and the reasons of its changes."""
    if text is None or text.isascii() and text.isprintable():
        return text, set()
    plain, why = fold(text)
    read = reader.read(plain)
    if read != plain:
        why.add("lookalike")
        plain = read
    return plain, why


def bigrams(texts: DataFrame, column: str) -> dict[int, int]:
    """Counts of adjacent letters of one script over all texts; words begin and end with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = np.zeros(ALPHABET, np.int64)
        kind = np.zeros(ALPHABET, np.int8)
        for code in range(ALPHABET):
            if chr(code).isalpha():
                low = chr(code).lower()
                lower[code] = ord(low) if len(low) == 1 and ord(low) < ALPHABET else code
                kind[code] = " LCG".index(_script(chr(code)) or " ")
        sums = np.zeros(ALPHABET * ALPHABET, np.int64)
        for batch in batches:
            joined = " ".join(t for t in batch.column(0).to_pylist() if t)
            for start in range(0, len(joined), PART):
                codes = np.frombuffer(f" {joined[start : start + PART]} ".encode("utf-32-le"), np.uint32)
                codes = np.where(codes < ALPHABET, codes, 0)
                letters, script = lower[codes], kind[codes]
                one = (script[:-1] == script[1:]) | (script[:-1] == 0) | (script[1:] == 0)
                pairs = letters[:-1] * ALPHABET + letters[1:]
                sums += np.bincount(pairs[one & (pairs > 0)], minlength=ALPHABET * ALPHABET)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])

    counted = texts.where(f"{column} is not null").select(column).mapInArrow(run, "pair long, n long")
    return {r.pair: r.n for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # at most ALPHABET ** 2 rows


def _changes(rows: DataFrame, keys: list[str], counts: dict[int, int], only_found: bool) -> DataFrame:
    """The texts in consistent form with the reasons of their changes; ``only_found`` drops unchanged ones.

    One vectorised pattern scan per Arrow batch picks the texts that need a reading.
    """
    model = rows.sparkSession.sparkContext.broadcast(counts)  # at most ALPHABET ** 2 numbers
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", text string, marker_type string, reasons string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for batch in batches:
            odd = [pc.fill_null(pc.match_substring_regex(batch.column(c), SUSPECT), False) for c in ("text", "marker_type")]
            at = np.flatnonzero(pc.or_(*odd)) if only_found else np.arange(batch.num_rows)
            odd = np.asarray(pc.or_(*odd))
            batch = batch.take(pa.array(at, pa.int64())) if only_found else batch
            keep, texts, markers, reasons = [], [], [], []
            for i, (text, marker) in enumerate(zip(batch.column("text").to_pylist(), batch.column("marker_type").to_pylist(), strict=True)):
                why = set()
                if odd[at[i]]:
                    text, why = normalise(text, reader)
                    marker, more = normalise(marker, reader)
                    why |= more
                if why or not only_found:
                    keep.append(i)
                    texts.append(text)
                    markers.append(marker.strip().lower() if marker is not None else None)
                    reasons.append(",".join(sorted(why)))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in keys), pa.array(texts, pa.string()), pa.array(markers, pa.string()), pa.array(reasons, pa.string())],
                names=[*keys, "text", "marker_type", "reasons"],
            )

    return rows.select(*keys, "text", "marker_type").mapInArrow(run, schema)


def found(bundles: DataFrame) -> DataFrame:
    """``file_key, paragraph_index, reasons`` of paragraphs with look-alike characters, one row each.

    Null and empty texts have none. Repeated deliveries of a paragraph give one row.
    """
    rows = paragraphs(bundles, ("text", "marker_type"))
    keys = ["file_key", "paragraph_index"]
    changed = _changes(rows, keys, bigrams(rows, "text"), only_found=True)
    return changed.groupBy(*keys).agg(F.min("reasons").alias("reasons"))


def consistent(bundles: DataFrame) -> DataFrame:
    """All paragraphs in their consistent form: ``file_key, paragraph_index, text, marker_type, reasons``.

    A paragraph comes out once, of differing deliveries the longest text, of equally long ones the
    greatest; nulls stay null. Marker types are also lower-cased and trimmed.
    """
    rows = paragraphs(bundles, ("text", "marker_type"))
    keys = ["file_key", "paragraph_index"]
    changed = _changes(rows, keys, bigrams(rows, "text"), only_found=False)
    best = F.max_by(F.struct("text", "marker_type", "reasons"), F.struct(F.coalesce(F.length("text"), F.lit(-1)).alias("n"), "text", "marker_type", "reasons"))
    return changed.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*")
