"""The streaming extension on folders made here."""

import datetime as dt

from pyspark.sql import functions as F

from docframe.streaming.packages import for_each_batch, package_stream, windowed_counts
from tests.test_pipeline import package


def test_packages_as_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.docx").write_bytes(package())
    seen = []
    run = lambda: for_each_batch(package_stream(spark, str(source)), lambda df, n: seen.append((n, df.select("file_key").distinct().count())), str(tmp_path / "cp")).awaitTermination(60)
    assert run()
    (source / "b.docx").write_bytes(package())
    assert run() and [n for _, n in seen] == [1, 1]


def test_windows_agree_with_batch(spark, tmp_path):
    start = dt.datetime(2031, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=13 * i), "a" if i % 3 else "b", float(i)) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string, value double")
    events.write.parquet(str(tmp_path / "events"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    query = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = windowed_counts(events)
    got = spark.table("windowed")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() and want.agg(F.sum("n")).first()[0] == 40
