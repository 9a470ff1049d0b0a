"""Packages (ZIP archives of parts) as rows, and rows as packages."""

from __future__ import annotations

import fnmatch
import io
import os
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.ids import file_key
from docframe.operators.relational import patch_parts, raise_if_any
from docframe.session import arrow_schema, batched, each_group, spread

PARTS = "file_key string, path string, ordinal int, part_name string, compress_type int, content binary, error string"
#: The archive comment travels as a part of this name and ordinal -1.
COMMENT = "(comment)"
# The parts that a patch may replace, add or leave out.
PATCHABLE = [
    "word/document.xml", "word/styles.xml", "word/theme/theme1.xml", "word/numbering.xml", "word/settings.xml", "word/fontTable.xml", "[Content_Types].xml", "word/_rels/document.xml.rels",
]
PATCHABLE_NUMBERED = r"^word/(header[0-9]+\.xml|footer[0-9]+\.xml|_rels/header[0-9]+\.xml\.rels|_rels/footer[0-9]+\.xml\.rels)$"


def _uri(folder: str) -> str:
    return folder if "://" in folder else os.path.abspath(folder.removeprefix("file:"))


def expand(files: DataFrame) -> DataFrame:
    """``PARTS`` rows of ``files(file_key, path, content)``; an unreadable archive gives one row with ``error``."""

    shape = arrow_schema(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (tuple(batch.column(c)[i].as_py() for c in ("file_key", "path", "content")) for batch in batches for i in range(batch.num_rows))
        return batched((row for file in files for row in _part_rows(*file)), shape)

    return files.select("file_key", "path", "content").mapInArrow(run, PARTS)


def _part_rows(key: str, path: str, content: bytes | None) -> list[tuple]:
    """``PARTS`` rows of one archive."""
    rows: list[tuple] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if archive.comment:
                rows.append((key, path, -1, COMMENT, 0, archive.comment, None))
            for ordinal, info in enumerate(archive.infolist()):
                rows.append((key, path, ordinal, info.filename, info.compress_type, archive.read(info), None))
    except (zipfile.BadZipFile, RuntimeError, OSError, TypeError, ValueError) as error:
        rows = [(key, path, None, None, None, None, f"{type(error).__name__}: {error}")]
    return rows


def list_packages(spark: SparkSession, folder: str, pattern: str = "*.docx") -> DataFrame:
    """``path, place`` of the packages directly in a folder, names that Spark's scans hide left out.

    One task lists the folder: the driver holds no list, however many packages there are. ``place`` is
    the path as Arrow's file system takes it.
    """
    uri = _uri(folder).rstrip("/")
    system, root = pafs.FileSystem.from_uri(uri)
    if system.get_file_info(root).type == pafs.FileType.NotFound:
        raise FileNotFoundError(folder)
    head = "file:" if isinstance(system, pafs.LocalFileSystem) else uri.removesuffix(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, root = pafs.FileSystem.from_uri(uri)
            found = system.get_file_info(pafs.FileSelector(root))
            yield from batched(((head + i.path, i.path) for i in found if i.is_file and not i.base_name.startswith(("_", ".")) and fnmatch.fnmatchcase(i.base_name, pattern)), shape)

    shape = arrow_schema("path string, place string")
    return spark.range(0, 1, 1, 1).mapInArrow(run, "path string, place string")


def read_packages(spark: SparkSession, folder: str, pattern: str = "*.docx") -> DataFrame:
    """The parts of all packages directly in a folder; keys keep equal base names apart.

    Files are dealt out by name to as many tasks as shuffles have; Spark's own scan counts each as 4 MB at
    least, which makes a task of every few small packages, and leaves out empty files.
    """
    uri, shape = _uri(folder), arrow_schema(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(uri)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, path, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with system.open_input_stream(place) as file:  # one archive in memory at a time
                        content = file.read()
                    yield from _part_rows(key, path, content)

        return batched(rows(), shape)

    return spread(list_packages(spark, folder, pattern), "path").select(file_key(F.col("path")).alias("file_key"), "path", "place").mapInArrow(run, PARTS)


def part_text(parts: DataFrame, name: str) -> DataFrame:
    """``file_key, xml`` of one part by name, decoded."""
    return parts.where(F.col("part_name") == name).select("file_key", F.decode("content", "UTF-8").alias("xml"))


def patchable(name: Column) -> Column:
    return name.isin(PATCHABLE) | name.rlike(PATCHABLE_NUMBERED) | name.startswith("word/media/")


@F.pandas_udf(T.StringType())
def _xml_error(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for names, contents in batches:
        out = []
        for name, content in zip(names, contents, strict=True):
            problem = None
            if name is not None and content is not None and name.endswith((".xml", ".rels")):
                try:
                    ET.fromstring(bytes(content))
                except ET.ParseError as error:
                    problem = f"{name}: XML parse error: {error}"
            out.append(problem)
        yield pd.Series(out, dtype=object)


def xml_errors(parts: DataFrame) -> DataFrame:
    """``file_key, part_name, error`` of all parts that should be XML and do not parse."""
    return parts.select("file_key", "part_name", _xml_error("part_name", "content").alias("error")).where("error is not null")


def namespace_errors(parts: DataFrame) -> DataFrame:
    """``file_key, part_name, error`` of parts with prefixes that a serializer made up (``ns0:``), which Word does not take."""
    text = F.decode("content", "UTF-8")
    made_up = F.regexp_extract(text, r"(?:xmlns:|</?)(ns[0-9]+)[:=\s]", 1)
    xml = F.col("part_name").rlike(r"\.(xml|rels)$")
    return parts.where(xml).select("file_key", "part_name", F.when(made_up != "", F.format_string("%s: made-up prefix %s", "part_name", made_up)).alias("error")).where("error is not null")


def patch_violations(replacements: DataFrame, excluded: DataFrame) -> DataFrame:
    """``file_key, part_name, error``: names that must not be patched, replaced parts that do not parse or have made-up prefixes."""
    names = replacements.select("file_key", "part_name").unionByName(excluded.select("file_key", "part_name"))
    forbidden = names.where(~patchable(F.col("part_name"))).select("file_key", "part_name", F.concat("part_name", F.lit(": must not be patched")).alias("error"))
    return forbidden.unionByName(xml_errors(replacements)).unionByName(namespace_errors(replacements))


def patch_packages(base: DataFrame, replacements: DataFrame, excluded: DataFrame, check: bool = True) -> DataFrame:
    """Base parts with replaced contents, without excluded ones, new parts behind them; order and compression kept.

    ``replacements(file_key, part_name, content)``, ``excluded(file_key, part_name)``; a part that is
    both is replaced. With ``check`` nothing is returned unless :func:`patch_violations` finds nothing.
    """
    if check:
        raise_if_any(patch_violations(replacements, excluded), "parts that must not be patched or are not well-formed")
    keys = ["file_key", "part_name"]
    rows = base.select("file_key", "ordinal", "part_name", "compress_type", "content")
    gone = excluded.select(*keys).join(replacements.select(*keys), keys, "left_anti")
    patched = patch_parts(rows, replacements.select(*keys, "content"), gone, keys, "content")
    last = F.coalesce("ordinal", F.lit(2**31 - 1))
    return patched.withColumn("ordinal", last).withColumn("compress_type", F.coalesce("compress_type", F.lit(zipfile.ZIP_DEFLATED)))


def _archive(rows: list[dict]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for row in sorted(rows, key=lambda r: (r["ordinal"] is None, r["ordinal"] or 0, r["part_name"])):
            if row["part_name"] == COMMENT:
                archive.comment = row["content"]
                continue
            info = zipfile.ZipInfo(row["part_name"], date_time=(1980, 1, 1, 0, 0, 0))
            archive.writestr(info, row["content"], compress_type=row["compress_type"])
    return out.getvalue()


def _each_package(parts: DataFrame, run: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``run`` on the parts of each key. A group is one package, which fits a task by nature."""
    kept = parts.where("part_name is not null").select("file_key", "ordinal", "part_name", "compress_type", "content")
    return each_group(kept, ["file_key"], [], run, schema)


def build_packages(parts: DataFrame) -> DataFrame:
    """``file_key, content``: one archive per key."""
    return _each_package(parts, lambda rows: [(rows[0]["file_key"], _archive(rows))], "file_key string, content binary")


def write_packages(parts: DataFrame, folder: str, suffix: str = ".docx") -> DataFrame:
    """Write one archive per key into a folder that all executors share; gives ``file_key, path, n_bytes``.

    The folder may lie in any file system that Arrow knows by its URI. Each file is written under
    another name and then moved, so a repeated task leaves one whole file.
    """
    uri = _uri(folder)
    place: list = []

    def save(rows: list[dict]) -> list[tuple]:
        if not place:  # once per task
            place.extend(pafs.FileSystem.from_uri(uri))
            place[0].create_dir(place[1], recursive=True)
        system, root = place
        key, content = rows[0]["file_key"], _archive(rows)
        path = f"{root}/{key}{suffix}"
        draft = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(content)
        system.move(draft, path)
        return [(key, path, len(content))]

    return _each_package(parts, save, "file_key string, path string, n_bytes long")
