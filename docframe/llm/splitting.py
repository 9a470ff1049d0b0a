"""Splitting oversized bundles at natural boundaries by recursive bisection.

A bundle's paragraphs, each index once and in order, are atoms with a boundary strength before
each: section, part, article, heading, paragraph. A paragraph too long for a piece is cut into
sentences, an endless sentence at blanks, an unbroken string hard. A stretch that is too large,
with the overlap it will get, is cut at the strongest boundary within a quarter of its size around
its midpoint, nearest first (at the nearest boundary of all if none lies there), and both halves
recursively. Then every piece but the first gets its overlap: the last ``overlap_paragraphs`` whole
paragraphs before it, or ``overlap_chars`` characters when the cut lies inside a paragraph. Only as
many paragraphs are repeated as leave room for the first atom of the piece; if not even the nearest
does, its last ``overlap_chars`` characters are. Sizes are those of the joined text: a line break
stands between paragraphs and counts.

Bisection works on lengths and strengths only, never on texts. Stretches of more than ``MAX_ROWS``
atoms are bisected by distributed aggregation, round by round and by the same rule, so no task ever
holds more than that many rows of one bundle and the cuts do not depend on that number. Texts meet
the pieces in a join on (file_key, paragraph_index) and are collected per piece, whose size is limited.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.residue import paragraphs
from docframe.operators.context import running_sum
from docframe.operators.skew import salted_lookup
from docframe.session import cut

#: The most atoms of one stretch that a task bisects; any value gives the same pieces.
MAX_ROWS = 200_000
# Boundary strengths, strongest first, and the patterns (RE2) of the paragraphs that open them.
STRENGTHS = [
    (6, r"^\s*(END OF )?SECTION\s+[0-9]"),
    (5, r"^\s*PART\s+[0-9]"),
    (4, r"^\s*[0-9]+\.[0-9]{2}\s"),
    (3, r"^\s*[\p{Lu}][\p{Lu}\s,&-]{3,}$"),
]
PARAGRAPH, SENTENCE, BLANK, HARD = 2, 1, 0, -1
_SENTENCE = regex.compile(r"(?<=[.!?…][\"'”»)]*)\s+|\n+")
_BLANK = regex.compile(r"(?<=\s)(?=\S)")
_HARD_STEP = 256


def largest_atom(max_size: int, n_chars: int) -> int:
    """The longest part of a paragraph that is never cut: with ``n_chars`` of overlap and a line break it fits a piece."""
    return max(1, max_size - min(n_chars, max_size // 4) - 1)


def atoms(text: str, most: int) -> list[tuple[int, int]]:
    """(length, strength before) of the parts of a long paragraph; they add up to its length."""

    def cut_at(a: int, b: int, pattern, after: bool) -> list[int]:
        ends = [m.end() if after else m.start() for m in pattern.finditer(text, a, b)]
        return [a, *(e for e in ends if a < e < b), b]

    out: list[tuple[int, int]] = []
    sentences = cut_at(0, len(text), _SENTENCE, True)
    for a, b in zip(sentences, sentences[1:], strict=False):
        strength = SENTENCE if out else PARAGRAPH
        if b - a <= most:
            out.append((b - a, strength))
            continue
        blanks = cut_at(a, b, _BLANK, False)
        for c, d in zip(blanks, blanks[1:], strict=False):
            step = d - c if d - c <= most else min(_HARD_STEP, max(1, most // 4))
            for e in range(c, d, step):
                out.append((min(d, e + step) - e, strength))
                strength = HARD
            strength = BLANK
    return out


def overlap_of(sizes: list[int], room: int, n_paragraphs: int, n_chars: int) -> tuple[int, int, int]:
    """Paragraphs, characters of a cut paragraph, and total size of the overlap with its line breaks.

    ``sizes`` are the lengths of the paragraphs before the cut, nearest first; ``room`` is what the
    first atom of the piece leaves.
    """
    whole = total = 0
    for n in sizes[:n_paragraphs]:
        if total + n + 1 > room:
            break
        whole, total = whole + 1, total + n + 1
    if whole or not sizes[:n_paragraphs]:
        return whole, 0, total
    part = max(0, min(n_chars, room - 1, sizes[0]))
    return 0, part, part + 1 if part else 0


class Bisector:
    """Bisects one stretch given its atoms as (paragraph index, offset, size, strength, paragraph length).

    ``lead`` holds (index, length) of the paragraphs before the stretch, in order.
    """

    def __init__(self, atoms: list[tuple], max_size: int, n_paragraphs: int, n_chars: int, lead: list[tuple[int, int]] = ()):
        self.atoms, self.max_size, self.n_paragraphs, self.n_chars = atoms, max_size, n_paragraphs, n_chars
        self.sums = [0]
        self.before: list[tuple[int, int]] = list(lead)  # (index, length) of all paragraphs
        self.own: list[int] = []  # position there of each atom's paragraph
        for index, offset, size, _, length in atoms:
            if not offset or not self.own:
                self.before.append((index, length))
            self.own.append(len(self.before) - 1)
            self.sums.append(self.sums[-1] + size + (not offset))

    def overlap(self, i: int) -> tuple[int, int, int]:
        """Overlap before atom ``i``: whole paragraphs, characters, size."""
        _, offset, size, *_ = self.atoms[i]
        room = self.max_size - size
        if offset:
            part = min(self.n_chars, offset, room)
            return 0, part, part
        sizes = [n for _, n in self.before[max(0, self.own[i] - self.n_paragraphs) : self.own[i]]]
        return overlap_of(sizes[::-1], room, self.n_paragraphs, self.n_chars)

    def pieces(self) -> list[tuple[int, int]]:
        """Atom ranges of the pieces, in order."""
        out, todo = [], [(0, len(self.atoms))]
        while todo:
            i, j = todo.pop()
            size = self.sums[j] - self.sums[i] - (not self.atoms[i][1])  # no line break at the start
            if j - i < 2 or size + self.overlap(i)[2] <= self.max_size:
                out.append((i, j))
                continue
            k = self.best(i, j)
            todo += [(k, j), (i, k)]
        return out

    def best(self, i: int, j: int) -> int:
        """The atom to cut before: strongest within a quarter of the stretch around its midpoint, then nearest, then first."""
        sums, a, b = self.sums, self.sums[i], self.sums[j]
        low = max(i + 1, bisect_left(sums, -(-(3 * a + b) // 4), i, j))
        high = min(j, bisect_right(sums, (a + 3 * b) // 4, i, j))
        if low < high:
            return min(range(low, high), key=lambda k: (-self.atoms[k][3], abs(2 * sums[k] - a - b), k))
        at = bisect_left(sums, (a + b) / 2, i, j)
        return min((k for k in (at - 1, at) if i < k < j), key=lambda k: (abs(2 * sums[k] - a - b), k))

    def slices(self) -> list[list[tuple[int, int, int, bool]]]:
        """Per piece its (paragraph_index, from, to, is_overlap), overlap first."""
        out = []
        for i, j in self.pieces():
            whole, chars, _ = self.overlap(i)
            own, offset = self.own[i], self.atoms[i][1]
            parts = [(index, 0, n, True) for index, n in self.before[own - whole : own]]
            if chars:
                index, stop = (self.before[own][0], offset) if offset else self.before[own - 1]
                parts.append((index, stop - chars, stop, True))
            last, end = self.own[j - 1], self.atoms[j - 1][1] + self.atoms[j - 1][2]
            for q in range(own, last + 1):
                index, n = self.before[q]
                parts.append((index, offset if q == own else 0, end if q == last else n, False))
            out.append(parts)
        return out


def measure(bundles: DataFrame, max_size: int, overlap_chars: int) -> DataFrame:
    """The atoms of each paragraph, once per index: ``file_key, paragraph_index, n, at, size, strength``.

    ``n`` is the length of the paragraph, ``at`` the offset of the atom in it. Null text has length
    0. If deliveries differ, the longest text counts, of equally long ones that of the greatest hash.
    """
    most = largest_atom(max_size, overlap_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            n = pc.fill_null(pc.utf8_length(text), 0)
            strength = pa.array(np.full(len(text), PARAGRAPH, np.int32))
            for level, pattern in reversed(STRENGTHS):
                strength = pc.if_else(pc.fill_null(pc.match_substring_regex(text, pattern), False), pa.scalar(level, pa.int32()), strength)
            inner = [None] * len(text)
            for i in np.flatnonzero(n.to_numpy(zero_copy_only=False) > most):
                at, found = 0, []
                for size, inside in atoms(text[int(i)].as_py(), most):
                    found.append({"at": at, "size": size, "strength": inside if at else strength[int(i)].as_py()})
                    at += size
                inner[i] = found
            kind = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64()), ("strength", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file_key", "paragraph_index", "h")), n.cast(pa.int64()), strength, pa.array(inner, kind)],
                names=["file_key", "paragraph_index", "h", "n", "strength", "atoms"],
            )

    rows = paragraphs(bundles).select("file_key", "paragraph_index", F.xxhash64("text").alias("h"), "text")
    schema = "file_key string, paragraph_index int, h long, n long, strength int, atoms array<struct<at:long,size:long,strength:int>>"
    best = F.max_by(F.struct("n", "strength", "atoms"), F.struct("n", "h")).alias("m")
    found = rows.mapInArrow(run, schema).groupBy("file_key", "paragraph_index").agg(best).select("file_key", "paragraph_index", "m.*")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("at"), F.col("n").alias("size"), F.col("strength")))
    return found.select("file_key", "paragraph_index", "n", F.inline(F.coalesce("atoms", whole)))


def _presplit(rows: DataFrame, max_size: int, overlap_paragraphs: int, max_rows: int) -> DataFrame:
    """Atoms with their stretch ``seg, seg_at``: that of the whole bundle (-1, 0) unless it has more than ``max_rows`` atoms.

    Those are bisected round by round: positions are running sums of sizes by blocks, the best cut
    of a stretch comes from a partially aggregated ``min_by``. A stretch is named by its first atom.
    The paragraphs before a later stretch, which its overlap needs, come along as ``lead`` rows.
    """
    at_start = lambda df: df.withColumn("seg", F.lit(-1).cast("int")).withColumn("seg_at", F.lit(0).cast("bigint"))
    large = rows.groupBy("file_key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max_rows).select("file_key")
    plain = at_start(rows).withColumn("lead", F.lit(False))
    if large.isEmpty():
        return plain
    huge = rows.join(large, "file_key", "left_semi")
    starts = (F.col("at") == 0).cast("bigint")
    # Atoms of a paragraph stand in one block of the running sums, in the order of their offsets.
    by_paragraph = huge.groupBy("file_key", "paragraph_index").agg(F.sum(F.col("size") + starts).alias("w"))
    placed = running_sum(by_paragraph, ["file_key"], "paragraph_index", F.col("w"), "o")
    placed = cut(running_sum(placed, ["file_key"], "paragraph_index", F.lit(1), "rank").drop("w"))
    # The line break before a paragraph belongs to its first atom.
    position = F.col("o") + F.col("at") + F.when(F.col("at") > 0, 1).otherwise(0)
    at = cut(at_start(huge.join(placed, ["file_key", "paragraph_index"]).withColumn("o", position)))
    keys = ["file_key", "seg", "seg_at"]
    while True:
        first = F.min(F.struct("paragraph_index", "at"))
        stretch = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("o").alias("lo"), F.max(F.col("o") + F.col("size") + starts).alias("hi"), first.alias("first"))
        size = F.col("hi") - F.col("lo") - F.when(F.col("first.at") == 0, 1).otherwise(0)
        stretch = cut(stretch.where((F.col("c") > max_rows) & (size > max_size)))
        if stretch.isEmpty():
            break
        open_rows = salted_lookup(at, stretch.drop("c"), keys, how="inner").where(F.struct("paragraph_index", "at") > F.col("first"))
        away = F.abs(2 * F.col("o") - F.col("lo") - F.col("hi"))
        near = 2 * away <= F.col("hi") - F.col("lo")
        rank = F.struct(F.when(near, -F.col("strength")).otherwise(100).alias("s"), away.alias("d"), "paragraph_index", "at")
        cuts = open_rows.groupBy(*keys).agg(F.min_by(F.struct("paragraph_index", "at"), rank).alias("cut"))
        behind = F.struct("paragraph_index", "at") >= F.col("cut")
        named = {"seg": F.when(behind, F.col("cut.paragraph_index")).otherwise(F.col("seg")), "seg_at": F.when(behind, F.col("cut.at")).otherwise(F.col("seg_at"))}
        at = cut(salted_lookup(at, cuts, keys).withColumns(named).drop("cut"))
    stretched = at.select("file_key", "paragraph_index", "n", "at", "size", "strength", "seg", "seg_at").withColumn("lead", F.lit(False))
    seams = at.where((F.col("paragraph_index") == F.col("seg")) & (F.col("at") == F.col("seg_at"))).select(*keys, F.explode(F.sequence(F.lit(1), F.lit(max(1, overlap_paragraphs)))).alias("back"), "rank")
    lengths = at.where("at = 0").select("file_key", "paragraph_index", "n", "rank")
    lead = seams.withColumn("rank", F.col("rank") - F.col("back")).join(lengths, ["file_key", "rank"])
    lead = lead.select("file_key", "paragraph_index", "n", F.lit(0).cast("bigint").alias("at"), F.col("n").alias("size"), F.lit(0).alias("strength"), "seg", "seg_at", F.lit(True).alias("lead"))
    return plain.join(large, "file_key", "left_anti").unionByName(stretched).unionByName(lead)


_SLICE = "file_key string, seg int, seg_at long, piece int, paragraph_index int, char_from long, char_to long, is_overlap boolean, pos int, n_in_seg int"


def slices(bundles: DataFrame, max_size: int, overlap_paragraphs: int, overlap_chars: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """``file_key, seg, seg_at, piece, paragraph_index, char_from, char_to, is_overlap, pos, n_in_seg``: what each piece holds.

    Pieces are numbered within a stretch; see :func:`pieces` for numbers within the bundle.
    """
    stretches = _presplit(cut(measure(bundles, max_size, overlap_chars)), max_size, overlap_paragraphs, max_rows)
    keys = ["file_key", "seg", "seg_at"]
    ordered = stretches.repartition(*keys).sortWithinPartitions(*keys, "paragraph_index", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = [c.split()[0] for c in _SLICE.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            whose = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
            rows = list(zip(*(table.column(c).to_pylist() for c in ("paragraph_index", "at", "size", "strength", "n")), strict=True))
            is_lead = table.column("lead").to_pylist()
            change = [i for i in range(1, len(whose)) if whose[i] != whose[i - 1]]
            out = []
            for a, b in zip([0, *change], [*change, len(whose)], strict=True):
                lead = [(r[0], r[4]) for r, known in zip(rows[a:b], is_lead[a:b], strict=True) if known]
                own = [r for r, known in zip(rows[a:b], is_lead[a:b], strict=True) if not known]
                got = Bisector(own, max_size, overlap_paragraphs, overlap_chars, lead).slices()
                for piece, parts in enumerate(got):
                    out += [(*whose[a], piece, *part, pos, len(got)) for pos, part in enumerate(parts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            same = np.ones(len(table), bool)
            for k in keys:
                same &= np.asarray(pc.equal(table.column(k), table.column(k)[-1]))
            start = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if start:
                yield from flush(table.slice(0, start))
                held = table.slice(start).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, _SLICE)


def piece_counts(parts: DataFrame) -> DataFrame:
    """``file_key, n_pieces, n_chars``: the pieces of a bundle and the characters of its paragraphs."""
    heads = F.when((F.col("piece") == 0) & (F.col("pos") == 0), F.col("n_in_seg")).otherwise(0)
    own = F.when(F.col("is_overlap"), 0).otherwise(F.col("char_to") - F.col("char_from"))
    return parts.groupBy("file_key").agg(F.sum(heads).alias("n_pieces"), F.sum(own).alias("n_chars"))


def oversized(parts: DataFrame, max_size: int) -> DataFrame:
    """``file_key`` of the bundles in more than one piece whose paragraphs alone, without line breaks, exceed a piece."""
    return piece_counts(parts).where((F.col("n_pieces") > 1) & (F.col("n_chars") > max_size)).select("file_key")


def pieces(bundles: DataFrame, max_size: int, overlap_paragraphs: int, overlap_chars: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """``file_key, piece_no, n_pieces, first_index, last_index, n_overlap_chars, n_chars, text``.

    ``text`` joins paragraphs with line breaks and never exceeds ``max_size`` characters; ``n_chars``
    counts the characters of the paragraphs, overlap included. A bundle without text has one
    piece; one without paragraphs has none.
    """
    parts = cut(slices(bundles, max_size, overlap_paragraphs, overlap_chars, max_rows))
    keys = ["file_key", "seg", "seg_at"]
    stretches = parts.where((F.col("piece") == 0) & (F.col("pos") == 0)).select(*keys, F.col("n_in_seg").alias("n"))
    order = Window.partitionBy("file_key").orderBy("seg", "seg_at")
    base = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.select(*keys, base.alias("base"), F.sum("n").over(Window.partitionBy("file_key")).alias("n_pieces"))
    best = F.max_by("text", F.struct(F.coalesce(F.length("text"), F.lit(0)), F.xxhash64("text")))  # as in measure
    texts = paragraphs(bundles).groupBy("file_key", "paragraph_index").agg(best.alias("text"))
    held = parts.join(texts, ["file_key", "paragraph_index"]).withColumn("text", F.expr("substring(coalesce(text, ''), cast(char_from + 1 as int), cast(char_to - char_from as int))"))
    whole = held.groupBy(*keys, "piece").agg(
        F.min("paragraph_index").alias("first_index"),
        F.max("paragraph_index").alias("last_index"),
        F.sum(F.when(F.col("is_overlap"), F.col("char_to") - F.col("char_from")).otherwise(0)).alias("n_overlap_chars"),
        F.sum(F.col("char_to") - F.col("char_from")).alias("n_chars"),
        F.array_sort(F.collect_list(F.struct("pos", "paragraph_index", "text"))).alias("held"),
    )
    # Slices of one paragraph run on; a line break stands between paragraphs.
    gap = lambda x, i: F.when((i == 0) | (F.get(F.col("held"), i - 1)["paragraph_index"] == x["paragraph_index"]), "").otherwise("\n")
    whole = whole.withColumn("text", F.array_join(F.transform("held", lambda x, i: F.concat(gap(x, i), x["text"])), "")).drop("held")
    return whole.join(stretches, keys).select(
        "file_key", (F.col("base") + F.col("piece") + 1).cast("int").alias("piece_no"), F.col("n_pieces").cast("int").alias("n_pieces"), "first_index", "last_index", "n_overlap_chars", "n_chars", "text"
    )
