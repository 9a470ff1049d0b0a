"""Filling fixed-capacity containers with whole texts: harmonic packing.

Class ``k`` holds the sizes in ``(C/(k+1), C/k]``; a container of class ``k`` takes exactly ``k``
of them. Every worker fills the containers of its own partition in one streaming pass, so the
assignment needs no shuffle at any size; at most one container per class and partition is left
short. What a full container has free is itself classed by the reciprocal of the capacity, and a
later text of a class that surely fits goes there before a container of its own class is opened;
texts arrive largest first within an Arrow batch. Only texts above the capacity are split: into
full containers and one remainder, which is packed like any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.tokens import DEFAULT_VOCABULARY, with_sizes

#: Sizes of C/CLASSES and below share the last class; they fill up free space of other containers first.
CLASSES = 64


class Packer:
    """Assigns sizes to containers of one worker, online, in constant time and bounded by open space."""

    def __init__(self, capacity: int, prefix: str):
        self.capacity, self.prefix, self.made = capacity, prefix, 0
        self.open: list[tuple[int, int, int] | None] = [None] * (CLASSES + 1)  # container, places left, free
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(CLASSES + 1)]  # by class of the free space

    def _class(self, size: int) -> int:
        return min(CLASSES, self.capacity // size)

    def _keep(self, container: int, left: int) -> None:
        # Free space of class j is at least C/j, so every size of class j and above fits.
        if left * CLASSES >= self.capacity:
            self.free[-(-self.capacity // left)].append((container, left))

    def put(self, size: int) -> int:
        """The number of the container for a size of at most the capacity."""
        k = self._class(size)
        if self.open[k] is None:
            for j in range(k, 1, -1):
                if self.free[j]:
                    container, left = self.free[j].pop()
                    self._keep(container, left - size)
                    return container
            self.made += 1
            # The last class holds CLASSES sizes or more; its containers are filled by their space.
            self.open[k] = (self.made, k, self.capacity)
        container, places, left = self.open[k]
        if k == CLASSES:
            if left < size:
                self._keep(container, left)
                self.made += 1
                container, left = self.made, self.capacity
            self.open[k] = (container, k, left - size)
            return container
        places, left = places - 1, left - size
        if places:
            self.open[k] = (container, places, left)
        else:
            self.open[k] = None
            self._keep(container, left)
        return container

    def name(self, container: int) -> str:
        return f"{self.prefix}-{container}"


def pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces of a text: one, or full containers and a remainder."""
    if size <= capacity:
        return [(0, size)]
    return [(a, min(a + capacity, size)) for a in range(0, size, capacity)]


def pack_sizes(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """``key, piece_no, n_pieces, token_from, token_to, n_tokens, container`` for ``sizes(key, n_tokens)``.

    One row per piece; piece numbers start at 1. A text without tokens (null or empty) has one
    row, a null container and no tokens. Repeated keys are separate items.
    """
    kind = sizes.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece_no int, n_pieces int, token_from long, token_to long, n_tokens long, container string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, str(TaskContext.get().partitionId()))
        for batch in batches:
            ids, lengths = batch.column(key).to_pylist(), batch.column("n_tokens").to_pylist()
            items = []
            for i, n in enumerate(lengths):
                cut = pieces(n, capacity)
                items += ((b - a, i, no, len(cut), a, b) for no, (a, b) in enumerate(cut, 1))
            items.sort(key=lambda x: (-x[0], x[1], x[2]))
            rows = [(ids[i], no, n, a, b, size, packer.name(packer.put(size)) if size else None) for size, i, no, n, a, b in items]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            types = [batch.schema.field(key).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[key, "piece_no", "n_pieces", "token_from", "token_to", "n_tokens", "container"],
            )

    return sizes.select(key, "n_tokens").mapInArrow(run, schema)


def pack(documents: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Pack the texts of ``documents``; see :func:`pack_sizes`."""
    return pack_sizes(with_sizes(documents, [key], text, vocabulary), key, capacity)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of the capacity in use."""
    used = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("items"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.max("n"), F.lit(0)).alias("fullest"),
        F.round(F.sum("n") / (F.count(F.lit(1)) * F.lit(capacity)), 4).alias("fill"),
    )


def limit(size_limits: DataFrame, name: str) -> dict:
    """The row of ``size_limits`` with that name, a table of a few fixed rows."""
    rows = size_limits.where(F.col("limit_name") == name).select("max_size", "overlap_paragraphs", "overlap_chars").limit(2).collect()
    if len(rows) != 1 or not rows[0].max_size or rows[0].max_size < 1:
        raise ValueError(f"size_limits needs one row {name} with a positive max_size")
    return rows[0].asDict()
