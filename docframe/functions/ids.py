"""Keys, hashes and collision-free identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions.text import squeeze

CHUNK_MARK = "__chunk"


def file_key(path: Column) -> Column:
    """Sanitised stem and the start of a hash of the whole path: equal base names stay apart."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.regexp_replace(stem, "[^A-Za-z0-9_.-]", "_"), F.lit("__"), F.substring(F.sha1(path), 1, 12))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(xml: Column) -> Column:
    """Eight upper-case hex digits of the white-space-squeezed text."""
    return F.upper(F.substring(F.sha1(squeeze(F.coalesce(xml, F.lit("")))), 1, 8))


def durable_id(xml: Column) -> Column:
    """A positive 31-bit number from the same hash."""
    return F.conv(short_hash(xml), 16, 10).cast("bigint") % 2147483646 + 1


def free_hash(xml: Column, taken: Column, make=short_hash, tries: int = 999) -> Column:
    """``make(xml)``, or for taken values the first free one of ``xml`` with a numbered suffix; null if all are taken.

    Only rows whose first value is taken build the list of tries.
    """
    first = make(xml)
    suffixes = F.sequence(F.lit(1), F.lit(tries))
    later = F.filter(F.transform(suffixes, lambda i: make(F.concat(xml, F.lit("__collision_"), i.cast("string")))), lambda x: ~F.array_contains(taken, x))
    return F.when(~F.array_contains(taken, first), first).otherwise(F.get(later, F.lit(0)))


def request_id(key: Column, chunk: Column) -> Column:
    return F.concat(key, F.lit(CHUNK_MARK), chunk.cast("string"))


def request_key(request: Column) -> Column:
    return F.regexp_extract(request, f"^(.*){CHUNK_MARK}([0-9]+)$", 1)


def request_chunk(request: Column) -> Column:
    return F.regexp_extract(request, f"^(.*){CHUNK_MARK}([0-9]+)$", 2).cast("int")


def relative_target(target: Column) -> Column:
    """A relationship target without surrounding blanks and without leading dots and slashes."""
    return F.ltrim(F.trim(target), F.lit("./"))
