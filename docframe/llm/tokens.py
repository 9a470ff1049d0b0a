"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies on every executor; a parameter of each operator.
DEFAULT_VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are handed to the tokenizer in parts of about this many characters, cut where no token can span the cut.
PART = 200_000

_encoders: dict[str, object] = {}


def encoder(path: str = DEFAULT_VOCABULARY):
    """The tokenizer of a vocabulary file, once per worker process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def parts(text: str) -> Iterator[str]:
    """``text`` cut before single blanks between words; a stretch of PART characters without one is cut hard.

    Words never span a blank, so only hard cuts, which need 200,000 characters without a blank
    between words, can add a token.
    """
    start = 0
    while len(text) - start > PART:
        stop = start + PART
        at = stop
        while at > start + 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1 : at + 2].isspace() and text[at + 1 : at + 2]):
            at -= 1
        stop = at if at > start + 1 else stop
        yield text[start:stop]
        start = stop
    yield text[start:]


def count(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of a text; null and empty texts have none."""
    if not text:
        return 0
    encode = encoder(path).encode_ordinary
    return len(encode(text)) if len(text) <= PART else sum(len(encode(p)) for p in parts(text))


def with_sizes(rows: DataFrame, keys: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens``; the text travels to Python once and does not come back."""
    picked = rows.select(*keys, rows[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([count(t, path) for t in batch.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), sizes], names=[*keys, "n_tokens"])

    return picked.mapInArrow(run, schema)
