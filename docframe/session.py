"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_written: list[tuple[SparkSession, str]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that setting is always used
    as it is. Only a local master without the setting (tests) gets a temporary folder. On any
    other master a missing setting is an error: a machine-local folder would lose data with its
    machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return
    if context.getCheckpointDir() is not None:
        return
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="docframe-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared checkpoint folder and read it back: its lineage ends here.

    Unlike a checkpointed frame, a table also gives the planner its true size. The size estimate of
    a join is the product of its sides, and a checkpoint keeps it: in a loop of joins that number
    triples its digits each round. Tables live until :func:`release` or the end of the application.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.unregister(_remove_tables)
        atexit.register(_remove_tables)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder name beside the tables, deleted with them."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    if not _written:
        atexit.unregister(_remove_tables)
        atexit.register(_remove_tables)
    _written.append((spark, path))
    return path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as shuffles have, by ``keys``: adaptive execution would put few bytes into few tasks, however long each row takes.

    A group by the same keys behind it needs no further exchange.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


#: Bytes and rows of an Arrow batch that Python gives back; one row may be larger.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 5_000


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held, size = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def each_group(df: DataFrame, keys: list[str], order: list[Column], run: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """``run`` on the rows of each key in ``order``, as a stream of sorted rows.

    A group must fit a task, as with ``applyInPandas``, but costs neither a frame nor an Arrow batch of its
    own, which for small groups take longer than the work on them.
    """
    shape = arrow_schema(schema)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        at, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if rows and key != at:
                    yield rows
                    rows = []
                at = key
                rows.append(row)
        if rows:
            yield rows

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((row for rows in groups(batches) for row in run(rows)), shape)

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut` with aggregates observed while the table is written, without a further pass."""
    seen = Observation()
    written = cut(df.observe(seen, *(c.alias(name) for name, c in counts.items())))
    return written, dict(seen.get)


def release(since: int = 0) -> None:
    """Delete the tables written since the ``since``-th; frames that read them cannot be used any more."""
    while len(_written) > since:
        spark, path = _written.pop()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Delete the tables written inside when the block ends, for long sessions that run one query after another."""
    before = len(_written)
    try:
        yield
    finally:
        release(before)


def _remove_tables() -> None:
    try:
        release()
    except Exception:  # the session is gone; the folder's owner cleans up
        return
