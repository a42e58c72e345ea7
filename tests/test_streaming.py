import datetime

import pytest
from pyspark.sql import functions as F

from echofind.catalog import queries
from echofind.plans import ingest
from echofind.schemas import BUG_REPORTS
from echofind.session import scratch_dir
from echofind.sources import tables
from echofind.streaming import ingest as streaming

SCHEMA = "position bigint, external_id string, summary string, product string"
FIRST = [(0, "a", "one", "p"), (1, None, "two", "p"), (2, "a", "three", "p"), (3, "b", "", "p")]
SECOND = [(4, "a", "four", "p"), (5, "c", "five", "p"), (6, "", "six", "p")]


def _drop(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _stored(spark, table):
    return [(r.id, r.external_id, r.summary) for r in streaming.read_batches(spark, table, BUG_REPORTS).orderBy("id").collect()]


def test_repeats_over_files_and_replay(spark):
    folder, table, checkpoint = (scratch_dir(spark, n) for n in ("in", "table", "checkpoint"))
    for rows in (FIRST, SECOND):
        _drop(spark, folder, rows)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        streaming.ingest_stream(stream, table, checkpoint).awaitTermination()
    wanted = [(1, "a", "one"), (2, None, "two"), (3, "c", "five"), (4, None, "six")]
    assert _stored(spark, table) == wanted
    rejects = spark.read.parquet(f"{table}_rejects")
    assert {(r.position, r.reason) for r in rejects.collect()} == {
        (2, ingest.NOT_UNIQUE), (3, "summary is empty"), (4, ingest.NOT_UNIQUE),
    }
    # Both batches again, as after a lost commit: the same rows, once.
    streaming.ingest_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), table, scratch_dir(spark, "checkpoint")).awaitTermination()
    assert _stored(spark, table) == wanted


@pytest.mark.parametrize("low", [0, 90])  # the last or the first part is small, the second empty
def test_a_part_that_arrives_in_many_files_is_one_batch(monkeypatch, spark, low):
    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    source = scratch_dir(spark, "source")
    spark.range(100).withColumn("text", F.lit("x")).withColumnRenamed("id", "doc_id").write.parquet(f"{source}/documents.parquet")
    cut = [F.col("doc_id") < 95 - low, F.col("doc_id").between(95 - low, 94 - low), F.col("doc_id") >= 95 - low]
    stream, batches = queries._stream(spark, source, "documents", lambda _: cut), []

    def look(batch, _):
        batches.append(sorted(r.doc_id for r in batch.select("doc_id").collect()))
        parts.append(batch.select(F.input_file_name()).distinct().count())

    parts = []
    streaming.run_available(stream, scratch_dir(spark, "checkpoint"), look).awaitTermination()
    assert batches == [list(range(95 - low)), [], list(range(95 - low, 100))]
    assert max(parts) > 5  # one file holds a tenth, not a part


def test_stream_equals_bulk_load(spark):
    folder, table, checkpoint = (scratch_dir(spark, n) for n in ("in", "table", "checkpoint"))
    _drop(spark, folder, FIRST + SECOND)
    streaming.ingest_stream(spark.readStream.schema(SCHEMA).parquet(folder), table, checkpoint).awaitTermination()
    bulk = scratch_dir(spark, "bulk")
    ingest.load_reports(spark.createDataFrame(FIRST + SECOND, SCHEMA), bulk)
    keep = ["id", "external_id", "summary", "cleaned_text", "product", "resolution_status", "embedding"]
    rows = lambda df: sorted(map(tuple, df.select(*keep).collect()))
    assert rows(streaming.read_batches(spark, table, BUG_REPORTS)) == rows(tables.read_table(spark, bulk))


def test_upsert_stream(spark):
    folder, base, checkpoint = (scratch_dir(spark, n) for n in ("in", "base", "checkpoint"))
    schema = "key string, t int, status string"
    for rows in ([("a", 1, "NEW"), ("a", 2, "OPEN"), ("b", 1, "NEW")], [("a", 3, "CLOSED"), ("c", 1, "NEW")]):
        _drop(spark, folder, rows, schema)
        stream = spark.readStream.schema(schema).parquet(folder)
        streaming.upsert_stream(stream, base, checkpoint, "key", ["t", "status"], ["t"]).awaitTermination()
    full = streaming.state_schema(spark.createDataFrame([], schema), "key", ["t", "status"])
    got = {r.key: r for r in streaming.read_latest(spark, base, full, "key").collect()}
    assert {k: (r.t, r.status) for k, r in got.items()} == {"a": (3, "CLOSED"), "b": (1, "NEW"), "c": (1, "NEW")}
    assert got["a"].updated_at > got["a"].created_at and got["b"].updated_at == got["b"].created_at
    assert {r.key for r in streaming.read_latest(spark, base, full, "key", before=1).collect()} == {"a", "b"}
    # A batch writes its changes only, and the same state again is no change.
    _drop(spark, folder, [("a", 3, "CLOSED"), ("b", 1, "NEW"), ("d", 1, "NEW")], schema)
    streaming.upsert_stream(spark.readStream.schema(schema).parquet(folder), base, checkpoint, "key", ["t", "status"], ["t"]).awaitTermination()
    assert [r.key for r in spark.read.parquet(f"{base}/batch_id=2").collect()] == ["d"]
    short = scratch_dir(spark, "short")
    streaming.compact(spark, base, short, full, "key")
    assert {r.key for r in streaming.read_latest(spark, short, full, "key", before=0).collect()} == set("abcd")


def test_watermark_variant_drops_repeats_and_keeps_unkeyed_rows(spark):
    folder, target, checkpoint = (scratch_dir(spark, n) for n in ("in", "out", "checkpoint"))
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t, 1), ("a", t, 2), (None, t, 3), (None, t, 4), ("b", t, 5)]
    schema = "external_id string, ts timestamp, n int"
    _drop(spark, folder, rows, schema)
    stream = streaming.dedupe_within_watermark(spark.readStream.schema(schema).parquet(folder), "external_id", "ts", "1 hour")
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(target)
    assert got.filter("external_id IS NULL").count() == 2
    assert sorted(r[0] for r in got.filter("external_id IS NOT NULL").select("external_id").collect()) == ["a", "b"]
    assert got.select(F.count_distinct("n")).first()[0] == 4
