"""Classification of the rows that rules leave open, and the checks around it.

A classifier is any object with ``classify(texts, roles) -> roles``, one per text; it runs batch-wise
in ``mapInPandas`` on the open rows only. The default is an offline rule, so that results do not
depend on retries. A live one is not deterministic: write its result before using it twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.operators.relational import conflicts, duplicates, raise_if_any
from docframe.session import cut, each_group

ATTEMPTS = 3


class Classifier(Protocol):
    def classify(self, texts: list[str], roles: list[str]) -> list[str]: ...


class RuleClassifier:
    """Long sentences are paragraphs, texts with a colon articles, the rest subparagraphs."""

    def classify(self, texts: list[str], roles: list[str]) -> list[str]:
        return ["PARAGRAPH" if len(t) > 60 and t.endswith(".") else "ARTICLE" if ":" in t else "SUBPARAGRAPH" for t in texts]


def with_retries(call: Callable[[], list[str]], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> list[str]:
    """``call()`` with up to ``attempts`` tries and doubling pauses: 1, 2 s after unreadable answers, 2, 4 s after other errors."""
    for turn in range(attempts):
        try:
            return call()
        except Exception as error:
            if turn + 1 == attempts:
                raise
            wait(2.0 ** (turn if isinstance(error, ValueError) else turn + 1))
    raise AssertionError


def classify(open_rows: DataFrame, keys: list[str], roles: list[str], classifier: Classifier | None = None, text: str = "text") -> DataFrame:
    """``keys`` and ``csi_role`` for every open row; a null text counts as empty."""
    model = classifier or RuleClassifier()
    picked = open_rows.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_rows.select(*keys).schema) + ", csi_role string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                texts = batch["__text"].tolist()
                answer = with_retries(lambda texts=texts: model.classify(texts, roles))
                if len(answer) != len(texts):
                    raise ValueError("a classifier must answer once per text")
                yield batch.drop(columns="__text").assign(csi_role=answer)

    return picked.mapInPandas(run, schema)


def classify_chunks(chunks: DataFrame, roles: list[str], classifier: Classifier | None = None) -> DataFrame:
    """``file_key, chunk, paragraph_index, csi_role`` for every row of every chunk.

    ``chunks(file_key, chunk, paragraph_index, text, ...)``; a chunk is one request and bounded by the
    chunk size. A classifier with ``classify_rows(rows, roles)`` gets the rows of a chunk in order
    with all their columns, such as the texts before and after; one without gets the texts.
    """
    model = classifier or RuleClassifier()

    def run(rows: list[dict]) -> list[tuple]:
        if hasattr(model, "classify_rows"):
            answer = with_retries(lambda: model.classify_rows(rows, roles))
        else:
            texts = [r["text"] or "" for r in rows]
            answer = with_retries(lambda: model.classify(texts, roles))
        if len(answer) != len(rows):
            raise ValueError("a classifier must answer once per row")
        return [(r["file_key"], r["chunk"], r["paragraph_index"], a) for r, a in zip(rows, answer, strict=True)]

    kind = {f.name: f.dataType.simpleString() for f in chunks.schema}
    return each_group(chunks, ["file_key", "chunk"], [F.col("paragraph_index").asc_nulls_last()], run, f"file_key string, chunk {kind['chunk']}, paragraph_index {kind['paragraph_index']}, csi_role string")


def payload_violations(payload: DataFrame, allowed: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    """``keys, rule``: null or repeated keys, keys that are not allowed, roles that are not allowed."""
    missing_key = F.lit(False)
    for k in keys:
        missing_key = missing_key | F.col(k).isNull()
    rule = lambda df, name: df.select(*keys, F.lit(name).alias("rule"))
    return (
        rule(payload.where(missing_key), "no_index")
        .unionByName(rule(duplicates(payload.where(~missing_key), keys), "duplicate"))
        .unionByName(rule(payload.where(~missing_key).join(allowed.select(*keys), keys, "left_anti"), "not_classifiable"))
        .unionByName(rule(payload.where(~F.coalesce(F.col("csi_role").isin(roles), F.lit(False))), "bad_role"))
    )


def merge_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One role per key from overlapping chunks; disagreement is an error, not last-wins.

    The chunks are written first, so a classifier behind them answers once.
    """
    chunks = cut(chunks.select(*keys, "csi_role"))
    raise_if_any(conflicts(chunks, keys, "csi_role"), "chunks disagree", 10)
    return chunks.groupBy(*keys).agg(F.min("csi_role").alias("csi_role"))


def final_classifications(fixed: DataFrame, incoming: DataFrame, open_keys: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """``keys, csi_role`` where each ``group`` is complete, with ``mode``; one row per group and problem otherwise.

    A group's payload either covers exactly its open rows (mode ``merged``: the fixed ones are added)
    or all rows without changing a fixed one (mode ``total``). Everything else gives ``status`` rows:
    missing, extra or override, for the keys concerned.
    """
    have = incoming.select(*keys, F.col("csi_role").alias("new"), F.lit(True).alias("__in"))
    rule = fixed.select(*keys, F.col("csi_role").alias("old"), F.lit(True).alias("__fixed"))
    unresolved = open_keys.select(*keys, F.lit(True).alias("__open"))
    rows = have.join(rule, keys, "full_outer").join(unresolved, keys, "full_outer")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("__in", "__fixed", "__open")}
    touched = rows.groupBy(*group).agg(F.max(flags["__in"] & flags["__fixed"]).alias("__total"))
    rows = rows.join(touched, group)
    status = (
        F.when(flags["__in"] & ~flags["__fixed"] & ~flags["__open"], "extra")
        .when(flags["__open"] & ~flags["__in"], "missing")
        .when(F.col("__total") & flags["__fixed"] & ~flags["__in"], "missing")
        .when(flags["__in"] & flags["__fixed"] & ~F.col("new").eqNullSafe(F.col("old")), "override")
        .otherwise("ok")
    )
    return rows.select(*keys, F.coalesce("new", "old").alias("csi_role"), F.when(F.col("__total"), "total").otherwise("merged").alias("mode"), status.alias("status"))
