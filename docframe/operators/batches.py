"""Classifier requests and responses as relations: chunk, ask elsewhere, parse, check, reassemble."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import ids
from docframe.operators.classify import merge_chunks, payload_violations
from docframe.operators.context import MAX_CHARS, MAX_ROWS, chunk_completeness, chunk_rows, overlapping_chunks
from docframe.operators.relational import raise_if_any

MAX_REQUESTS, POLL_SECONDS = 10_000, 30.0
ANSWER = "classifications array<struct<paragraph_index int, csi_role string>>, notes array<string>"


def chunked(rows: DataFrame, overhead: int = 200, max_chars: int = MAX_CHARS, max_rows: int = MAX_ROWS) -> DataFrame:
    """``rows(file_key, paragraph_index, ...)`` with their ``chunk``: one chunk if a file is small, else overlapping ones sized by its mean row."""
    record = F.to_json(F.struct(*(c for c in rows.columns if c != "file_key")))
    sizes = rows.groupBy("file_key").agg((F.sum(F.length(record)) + overhead).alias("chars"), F.count(F.lit(1)).alias("n"))
    small = (F.col("chars") <= max_chars) & (F.col("n") <= max_rows)
    sizes = sizes.select("file_key", F.when(small, F.col("n")).otherwise(chunk_rows(F.col("chars"), F.col("n"), F.lit(overhead), max_chars)).alias("__rows"))
    return overlapping_chunks(rows.join(sizes, "file_key"), ["file_key"], "paragraph_index", F.col("__rows")).drop("rn", "__rows")


def read_prompt(spark: SparkSession, path: str) -> str:
    """An instruction kept as a text file, without surrounding white space."""
    return spark.read.text(path, wholetext=True).first().value.strip()


def request_text(instruction: str, roles: list[str], bundle: Column) -> Column:
    """Instruction, roles and bundle as one message."""
    return F.concat(F.lit(instruction.strip() + "\n\navailable_roles: "), F.to_json(F.array(*map(F.lit, roles))), F.lit("\n\n"), bundle)


def build_requests(chunks: DataFrame, instruction: str, roles: list[str], limit: int = MAX_REQUESTS) -> DataFrame:
    """``custom_id, file_key, chunk, message``, one request per chunk; more than ``limit`` are refused."""
    record = F.struct(*(c for c in chunks.columns if c not in ("file_key", "chunk")))
    grouped = chunks.groupBy("file_key", "chunk").agg(F.array_sort(F.collect_list(F.struct("paragraph_index", record.alias("r")))).alias("rows"))
    bundle = F.to_json(F.struct(F.transform("rows", lambda x: x["r"]).alias("paragraphs"), F.col("chunk").alias("chunk_index")))
    requests = grouped.select(ids.request_id(F.col("file_key"), F.col("chunk")).alias("custom_id"), "file_key", "chunk", request_text(instruction, roles, bundle).alias("message"))
    if chunks.select("file_key", "chunk").distinct().limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} requests; split the run")
    return requests.orderBy("file_key", "chunk")


class Transport(Protocol):
    """A service that takes requests as a batch; any object with these three methods."""

    def submit(self, requests: list[dict]) -> str: ...

    def status(self, batch: str) -> tuple[bool, dict[str, int]]: ...

    def results(self, batch: str) -> list[dict]: ...


def submit_and_poll(
    requests: DataFrame, transport: Transport, poll_seconds: float = POLL_SECONDS, attempts: int = 10_000, progress: Callable[[dict[str, int]], None] | None = None, wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """``custom_id, status, text`` of all requests, asked once the batch has ended.

    ``transport.submit`` takes the requests (at most MAX_REQUESTS, so they fit the driver) and names the
    batch, ``status`` tells whether it has ended and its counts, which ``progress`` receives, and
    ``results`` gives the answers. A request without an answer comes back with status ``missing``, so
    :func:`reassemble` fails its file. Between two polls at least a second passes.
    """
    rows = requests.select("custom_id", "message").limit(MAX_REQUESTS + 1).collect()
    if len(rows) > MAX_REQUESTS:
        raise ValueError(f"more than {MAX_REQUESTS} requests; split the run")
    batch = transport.submit([r.asDict() for r in rows])
    for _ in range(attempts):
        ended, counts = transport.status(batch)
        if progress:
            progress(counts)
        if ended:
            break
        wait(max(1.0, poll_seconds))
    else:
        raise TimeoutError(f"batch {batch} has not ended after {attempts} polls")
    got = requests.sparkSession.createDataFrame([(r["custom_id"], r.get("status"), r.get("text")) for r in transport.results(batch)], "custom_id string, status string, text string")
    return requests.select("custom_id").join(got, "custom_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def notes(responses: DataFrame) -> DataFrame:
    """``file_key, notes``: the notes of all answers of a file, in the order of its chunks."""
    got = responses.select(ids.request_key(F.col("custom_id")).alias("file_key"), ids.request_chunk(F.col("custom_id")).alias("chunk"), answer(F.col("text"))["notes"].alias("n")).where("size(n) > 0")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "n")))
    return got.groupBy("file_key").agg(F.flatten(F.transform(ordered, lambda x: x["n"])).alias("notes"))


def text_of_blocks(blocks: Column) -> Column:
    """The text blocks of an answer ``array<struct<type, text>>`` joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def answer(text: Column) -> Column:
    """The JSON of an answer, with or without a code fence; null if it cannot be read."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), r"^```[A-Za-z0-9_]*\s*", ""), r"\s*```$", "")
    return F.from_json(bare, ANSWER)


def reassemble(chunks: DataFrame, responses: DataFrame, roles: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(file_key, paragraph_index, csi_role)`` of all files whose answers are whole, and ``(file_key, reason)`` of the others.

    ``responses(custom_id, status, text)``. A file fails by a request that did not succeed, an answer
    that cannot be read, a missing chunk, or rows that are missing, repeated or not asked for in a chunk.
    """
    got = responses.select(ids.request_key(F.col("custom_id")).alias("file_key"), ids.request_chunk(F.col("custom_id")).cast("bigint").alias("chunk"), "status", answer(F.col("text")).alias("a"))
    wrong = F.when(F.coalesce(F.col("status"), F.lit("")) != "succeeded", F.concat(F.lit("request "), F.coalesce("status", F.lit("without status")))).when(F.col("a.classifications").isNull(), "unreadable answer")
    rows = got.where(wrong.isNull()).select("file_key", "chunk", F.inline("a.classifications"))
    keys = ["file_key", "chunk", "paragraph_index"]
    asked = chunks.select(*keys).distinct()
    bad = payload_violations(rows, asked, keys, roles).select("file_key", F.col("rule").alias("reason"))
    missing = asked.join(rows.select(*keys), keys, "left_anti").select("file_key", F.lit("missing coverage").alias("reason"))
    short = chunk_completeness(asked, got.where(wrong.isNull()), ["file_key"]).where("not complete").select("file_key", F.format_string("expected %d chunks, got %d", "n_expected", "n_received").alias("reason"))
    failed = got.where(wrong.isNotNull()).select("file_key", wrong.alias("reason")).unionByName(bad).unionByName(missing).unionByName(short)
    failed = failed.groupBy("file_key").agg(F.min("reason").alias("reason"))
    whole = rows.join(failed.select("file_key"), "file_key", "left_anti")
    return merge_chunks(whole, ["file_key", "paragraph_index"]), failed


def require_all(failed: DataFrame) -> None:
    """Batch mode: one failed file stops the whole batch."""
    raise_if_any(failed.orderBy("file_key"), "files could not be classified")


def classification_json(final: DataFrame, notes: list[str] | None = None) -> DataFrame:
    """``file_key, json``: the classifications of a file in index order, as they are stored."""
    items = F.array_sort(F.collect_list(F.struct("paragraph_index", "csi_role")))
    return final.groupBy("file_key").agg(F.to_json(F.struct(items.alias("classifications"), F.lit(notes or []).cast("array<string>").alias("notes"))).alias("json"))


def preflight_report(final: DataFrame, role_styles: DataFrame) -> DataFrame:
    """Rows per role and whether the role has a style."""
    counts = final.groupBy(F.col("csi_role").alias("role")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(role_styles.select("role", "style_id"), "role", "left").withColumn("mapped", F.col("style_id").isNotNull())
