"""Per-document text quality statistics and fixed-threshold rules.

All statistics of an Arrow batch are counted at once over one array of code points: classes by
table lookup, counts per document by differences of running sums, words by the borders of letter
runs, common words by rolling word hashes. No per-character or per-word Python code runs.

The rules are fixed thresholds, each failure recorded as a reason; a document without reason is prose.
``PUBLISHED`` holds those of the published repetition and quality filters for web text (Rae et al.
2021, section A1.1: words, mean word length, symbols per word, bullet and ellipsis lines, words with a
letter, stop words) at their values; their stop words are those of ``common_words`` in the best-fitting
language. ``ADAPTED`` holds own values for specification prose, among them the line-end rule (Raffel
et al. 2020 keep only ended lines; here one ended line is enough, as texts are wrapped). Left out is
the published minimum of 50 words, since short clauses are prose here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Characters that open a list item, end a sentence, separate columns, or count as symbols.
BULLETS = "-*•·▪◦‣–—"
ENDS = ".!?…:"
SENTENCE_ENDS = ".!?…"
SYMBOLS = "#|{}<>~^=+_\\/*@$%&[]`"
STATISTICS = [
    "n_words", "mean_word_length", "longest_word", "symbol_share", "digit_share", "letter_share", "common_share", "distinct_share",
    "n_lines", "ended_line_share", "bullet_line_share", "item_word_share", "columned_line_share", "words_per_sentence", "sentence_word_share", "mean_line_words",
    "n_common", "symbol_word_ratio", "ellipsis_line_share", "alpha_word_share",
]
#: Characters counted together.
PART = 2_000_000
_BASE = np.uint64(0x100000001B3)
_LETTER, _DIGIT, _SPACE, _LINE, _END, _SYMBOL, _OTHER = range(7)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(0x11000, _OTHER, np.uint8)
    lower = np.arange(0x11000, dtype=np.uint32)
    for code in range(0x11000):
        c = chr(code)
        if c.isalpha():
            kind[code] = _LETTER
            low = c.lower()
            if len(low) == 1:
                lower[code] = ord(low)
        elif c.isdigit():
            kind[code] = _DIGIT
        elif c in "\n\r":
            kind[code] = _LINE
        elif c.isspace():
            kind[code] = _SPACE
        elif c in SENTENCE_ENDS:
            kind[code] = _END
        elif c in SYMBOLS:
            kind[code] = _SYMBOL
    return kind, lower


class Counter:
    """Counts the statistics of lists of texts, given the common words by language."""

    def __init__(self, common: dict[str, list[str]]):
        self.kind, self.lower = _tables()
        masks: dict[int, int] = {}
        self.languages = sorted(common)
        for bit, lang in enumerate(self.languages):
            for word in common[lang]:
                h = int(self._hashes(np.array([ord(c) for c in word.lower()], np.uint32), np.array([0]), np.array([len(word)]))[0])
                masks[h] = masks.get(h, 0) | 1 << bit
        self.common = np.array(sorted(masks), np.uint64)
        self.mask = np.array([masks[h] for h in sorted(masks)], np.int64)

    @staticmethod
    def _hashes(lower: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """One 64-bit hash per short slice: the slice as a number in a fixed odd base, modulo 2**64."""
        out = np.zeros(len(starts), np.uint64)
        at, left, active = starts.copy(), stops - starts, np.arange(len(starts))
        while len(active):
            out[active] = out[active] * _BASE + lower[at[active]] + np.uint64(1)
            at[active] += 1
            left[active] -= 1
            active = active[left[active] > 0]
        return out

    def count(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """The statistics by name; null and empty texts give zeros.

        Texts are counted together up to PART characters (a longer one alone), which bounds memory.
        """
        groups: list[list[str | None]] = [[]]
        size = 0
        for text in texts:
            if groups[-1] and size + len(text or "") > PART:
                groups.append([])
                size = 0
            groups[-1].append(text)
            size += len(text or "")
        counted = [self._count(g) for g in groups]
        return counted[0] if len(counted) == 1 else {c: np.concatenate([x[c] for x in counted]) for c in STATISTICS}

    def _count(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        n = len(texts)
        whole = "\n".join(t or "" for t in texts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.minimum(codes, 0x10FFF)
        sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, n)
        last = np.cumsum(sizes)  # behind the final line break of each text
        first = last - sizes
        kind = self.kind[codes]
        lower = self.lower[codes]

        def per(flags: np.ndarray) -> np.ndarray:
            """Sum of flags by document."""
            return np.add.reduceat(flags, first, dtype=np.int64) if n else np.zeros(0, np.int64)

        letter = kind == _LETTER
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        doc = np.searchsorted(last, starts, side="right")
        length = stops - starts
        words = np.bincount(doc, minlength=n)
        letters = np.bincount(doc, weights=length, minlength=n)
        longest = np.zeros(n, np.int64)
        if len(doc):
            heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            longest[doc[heads]] = np.maximum.reduceat(length, heads)
        hashes = self._hashes(lower, starts, stops)
        common = np.zeros(n)
        mask = np.zeros(len(hashes), np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
            mask = np.where(self.common[at] == hashes, self.mask[at], 0)
            for bit in range(len(self.languages)):
                common = np.maximum(common, np.bincount(doc, weights=mask >> bit & 1, minlength=n))
        # Sorted by hash within each document, a word is new where its hash differs from the one before.
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        keyed = (mixed >> np.uint64(24)) | (doc.astype(np.uint64) << np.uint64(40))
        keyed.sort()
        fresh = np.concatenate(([True], keyed[1:] != keyed[:-1])) if len(keyed) else np.zeros(0, bool)
        distinct = np.bincount((keyed[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)

        # Lines: stretches between breaks with at least one visible character.
        breaks = np.flatnonzero(kind == _LINE)
        line_first = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else np.array([], np.int64)
        visible = np.flatnonzero((kind != _LINE) & (kind != _SPACE))
        head_at = np.searchsorted(visible, line_first)
        tail_at = np.searchsorted(visible, breaks) - 1
        full = (tail_at >= head_at) & (head_at < len(visible))
        line_first, line_stop = line_first[full], breaks[full]
        head, tail = visible[head_at[full]], visible[tail_at[full]]
        line_doc = np.searchsorted(last, line_first, side="right")
        lines = np.bincount(line_doc, minlength=n)

        def in_line(positions: np.ndarray) -> np.ndarray:
            return np.searchsorted(positions, line_stop) - np.searchsorted(positions, line_first)

        line_words = in_line(starts)
        ended = np.isin(codes[tail], [ord(c) for c in ENDS])
        after_head = np.minimum(head + 1, len(codes) - 1)
        bullet = np.isin(codes[head], [ord(c) for c in BULLETS]) & (kind[after_head] != _LETTER)
        separators = np.flatnonzero((codes == ord("|")) | (codes == ord("\t")))
        listing = np.flatnonzero((codes == ord(",")) | (codes == ord(";")))
        columned = (in_line(separators) >= 2) | ((in_line(listing) >= 2) & (line_words <= 4 * (in_line(listing) + 1)) & ~np.isin(codes[tail], [ord(c) for c in SENTENCE_ENDS]))
        # An item opens with a bullet, or with a small letter although the line before it was ended.
        opens = np.ones(len(head), bool)
        opens[1:] = ended[:-1] | (line_doc[1:] != line_doc[:-1])
        small = (kind[head] == _LETTER) & (lower[head] == codes[head]) & opens
        item = bullet | small

        # Sentences: a sentence end after a letter, digit or closing sign, with a space or break behind it.
        ends = np.flatnonzero(kind == _END)
        behind = kind[np.minimum(ends + 1, len(kind) - 1)]
        before = kind[np.maximum(ends - 1, 0)]
        true_end = ((behind == _SPACE) | (behind == _LINE)) & (before != _SPACE) & (before != _LINE)
        ends = ends[true_end]
        # A one-letter or numeric label with a dot ("A.", "3.") ends no sentence.
        label = (kind[np.maximum(ends - 2, 0)] == _LINE) | (kind[np.maximum(ends - 2, 0)] == _SPACE) | (ends < 2)
        ends = ends[~label]
        sentences = np.bincount(np.searchsorted(last, ends, side="right"), minlength=n)
        # Words in sentences: stretches up to a sentence end with few line-breaks and enough common words.
        cuts = np.unique(np.concatenate((ends + 1, last)))
        stretch = np.searchsorted(cuts, starts, side="right")
        stretch_words = np.bincount(stretch, minlength=len(cuts) + 1)
        stretch_common = np.bincount(stretch, weights=mask > 0, minlength=len(cuts) + 1)
        is_end = np.zeros(len(cuts) + 1, bool)
        is_end[: len(cuts)] = np.isin(cuts, ends + 1)
        good = is_end & (stretch_words >= 4) & (stretch_words <= 60) & (stretch_common >= 0.12 * stretch_words)
        sentence_words = np.bincount(doc, weights=good[stretch], minlength=n)

        # Signs of cut text: number signs and ellipses, the latter also as three dots.
        dot = codes == ord(".")
        dots = np.zeros(len(codes), bool)
        dots[2:] = dot[2:] & dot[1:-1] & dot[:-2]
        first_dots = dots & ~np.concatenate(([False], dots[:-1]))
        marks = per((codes == ord("#")) | (codes == ord("…")) | first_dots)
        ellipsis = (codes[tail] == ord("…")) | dots[tail]
        # Words between white space, with and without a letter.
        solid = (kind != _SPACE) & (kind != _LINE)
        border = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
        token_start, token_stop = border[::2], border[1::2]
        seen = np.concatenate(([0], np.cumsum(letter)))
        token_doc = np.searchsorted(last, token_start, side="right")
        tokens = np.maximum(np.bincount(token_doc, minlength=n), 1)
        alpha = np.bincount(token_doc, weights=seen[token_stop] > seen[token_start], minlength=n)

        some = np.maximum(words, 1)
        chars = np.maximum(per((kind != _SPACE) & (kind != _LINE)), 1)
        every = np.maximum(lines, 1)
        by_line = lambda flags: np.bincount(line_doc, weights=flags, minlength=n) / every
        return {
            "n_words": words.astype(np.int64),
            "mean_word_length": letters / some,
            "longest_word": longest,
            "symbol_share": per(kind == _SYMBOL) / chars,
            "digit_share": per(kind == _DIGIT) / chars,
            "letter_share": letters / chars,
            "common_share": common / some,
            "distinct_share": distinct / some,
            "n_lines": lines.astype(np.int64),
            "ended_line_share": by_line(ended),
            "bullet_line_share": by_line(bullet),
            "item_word_share": np.bincount(line_doc, weights=item * line_words, minlength=n) / some,
            "columned_line_share": by_line(columned),
            "words_per_sentence": words / np.maximum(sentences, 1),
            "sentence_word_share": sentence_words / some,
            "mean_line_words": words / every,
            "n_common": common.astype(np.int64),
            "symbol_word_ratio": marks / some,
            "ellipsis_line_share": by_line(ellipsis),
            "alpha_word_share": alpha / tokens,
        }


# Reason, statistic, and the least and greatest value of prose, as published.
PUBLISHED = [
    ("too_many_words", "n_words", None, 100_000),
    ("mean_word_length", "mean_word_length", 3.0, 10.0),
    ("symbols_per_word", "symbol_word_ratio", None, 0.1),
    ("mostly_bullets", "bullet_line_share", None, 0.9),
    ("mostly_ellipses", "ellipsis_line_share", None, 0.3),
    ("few_words_with_letters", "alpha_word_share", 0.8, None),
    ("no_stop_words", "n_common", 2, None),
]
# Own values for specification prose.
ADAPTED = [
    ("no_ended_line", "ended_line_share", 1e-9, None),
    ("few_sentences", "sentence_word_share", 0.5, None),
    ("few_common_words", "common_share", 0.12, None),
    ("many_symbols", "symbol_share", None, 0.05),
    ("many_digits", "digit_share", None, 0.3),
    ("few_letters", "letter_share", 0.6, None),
    ("mostly_items", "item_word_share", None, 0.5),
]
RULES = [("empty", "n_words", 1, None), *PUBLISHED, *ADAPTED]


def judge(stats: dict[str, np.ndarray]) -> tuple[list[list[str]], list[str]]:
    """Reasons and kind (prose, table, list, junk) per document."""
    n = len(stats["n_words"])
    reasons: list[list[str]] = [[] for _ in range(n)]
    for reason, name, least, most in RULES:
        bad = np.zeros(n, bool)
        if least is not None:
            bad |= stats[name] < least
        if most is not None:
            bad |= stats[name] > most
        for i in np.flatnonzero(bad):
            reasons[i].append(reason)
    kinds = []
    for i in range(n):
        if not reasons[i]:
            kinds.append("prose")
        elif stats["columned_line_share"][i] > 0.5 and stats["n_lines"][i] > 1 and stats["digit_share"][i] < 0.95:
            kinds.append("table")
        elif stats["letter_share"][i] >= 0.6 and stats["symbol_share"][i] < 0.05 and (stats["n_lines"][i] > 2 or stats["distinct_share"][i] > 0.3) and 2.5 < stats["mean_word_length"][i] < 12:
            kinds.append("list")
        else:
            kinds.append("junk")
    return reasons, kinds


def common_words_by_language(common_words: DataFrame, most: int = 100_000) -> dict[str, list[str]]:
    """The small fixed table of common words; more than ``most`` rows are refused."""
    rows = common_words.where("lang is not null and word is not null").select("lang", "word").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    by: dict[str, list[str]] = {}
    for row in rows:
        by.setdefault(row.lang, []).append(row.word)
    return by


def assess(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, all statistics, ``reasons`` (in the order of RULES, comma-separated) and ``kind``.

    One row per input row, repeats included. Null and empty texts have zero statistics and the
    reason ``empty``. The language column is not used, since it can be wrong: the share of common
    words is that of the best-fitting language.
    """
    common = common_words_by_language(common_words)
    picked = documents.select(key, documents[text].alias("__text"))
    whole = ("n_words", "longest_word", "n_lines", "n_common")
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} {'long' if c in whole else 'double'}" for c in STATISTICS) + ", reasons string, kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(common)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            if not texts:
                continue
            stats = counter.count(texts)
            reasons, kinds = judge(stats)
            columns = [pa.array(stats[c], pa.int64()) if c in whole else pa.array(np.round(stats[c], 6)) for c in STATISTICS]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns, pa.array([",".join(r) for r in reasons], pa.string()), pa.array(kinds, pa.string())], names=[key, *STATISTICS, "reasons", "kind"])

    return picked.mapInArrow(run, schema)


def not_prose(assessed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the documents that fail at least one rule."""
    return assessed.where("reasons <> ''").select(key)
