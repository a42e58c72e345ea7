"""Arriving reports: load, deduplicate, match and upsert.

Every sink writes one folder per micro-batch and overwrites it when a batch
is replayed, so each batch counts once. Earlier batches are what a batch is
checked against.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from echofind.functions.embed import Embedder
from echofind.operators.normalize import with_cleaned_text, with_embedding
from echofind.operators.upsert import assign_ids, changes
from echofind.operators.validate import latest_per_key
from echofind.plans.ingest import ROW, accept_reports, complete
from echofind.plans.search import neighbours
from echofind.schemas import BUG_REPORTS, DIMENSION
from echofind.session import materialize, scratch_scope
from echofind.sources import tables
from echofind.sources.keys import KeyTable

_BATCH = T.StructField("batch_id", T.LongType())


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what has arrived, batch by batch, then stop.

    What ``each`` writes as intermediate tables goes when its batch is done.
    """

    def tidy(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            each(batch, batch_id)

    return (
        stream.writeStream.foreachBatch(tidy)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before a batch; the rest is not read."""
    full = T.StructType(schema.fields + [_BATCH])
    rows = tables.read_table(spark, path, full)
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    return rows.drop("batch_id")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ingest_stream(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    order: Sequence[str] = ("position",),
    keys: KeyTable | None = None,
) -> StreamingQuery:
    """Validate, clean, embed and append arriving reports.

    An external_id that is stored, or came earlier in the batch, is not stored
    again, however late the repeat; a late report is kept. Rejects go to
    ``<table>_rejects``. With ``keys``, a batch opens the buckets of that table which
    may hold its ids instead of reading all that are stored; it is a load there, and
    a replayed batch takes the place of the first.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        stored = read_batches(batch.sparkSession, table, BUG_REPORTS, before=batch_id)
        accepted, rejects = accept_reports(batch, stored, embedder.dim if embedder else DIMENSION, keys, before=batch_id)
        write_batch(rejects, f"{table}_rejects", batch_id)
        numbered = assign_ids(accepted, [*order, ROW], tables.last_id(stored))
        reports = complete(with_embedding(with_cleaned_text(numbered), embedder))
        write_batch(reports, table, batch_id)
        if keys is not None:
            keys.add(accepted.select("external_id"), batch_id)

    return run_available(stream, checkpoint, load)


def match_stream(
    stream: DataFrame, reports: DataFrame | Callable[[], DataFrame], target: str, checkpoint: str, k: int, **options
) -> StreamingQuery:
    """The k nearest stored reports of every arriving vector.

    A function that opens the reports is called for each batch, so that reports
    stored meanwhile are matched too; a DataFrame keeps the files it began with.
    """

    def match(batch: DataFrame, batch_id: int) -> None:
        queries = materialize(batch, "arrivals")
        stored = reports() if callable(reports) else reports
        write_batch(neighbours(queries, stored, k, **options), target, batch_id)

    return run_available(stream, checkpoint, match)


def state_schema(stream: DataFrame, key: str, columns: Sequence[str]) -> T.StructType:
    stamps = [T.StructField(n, T.TimestampType()) for n in ("created_at", "updated_at")]
    return T.StructType([stream.schema[c] for c in (key, *columns)] + stamps)


def upsert_stream(
    stream: DataFrame, table: str, checkpoint: str, key: str, columns: Sequence[str], order: Sequence[str]
) -> StreamingQuery:
    """Keep the latest row per key, by ``order`` (among ``columns``), as a log of changes.

    A batch reads the stored rows of its own keys and writes the rows that are
    new or changed; the rest of the table is not rewritten. A row that arrives
    late does not replace a later one; of rows equal in order the one that came
    last stays. ``read_latest`` gives the table, ``compact`` shortens the log.
    """
    if missing := [c for c in order if c not in columns]:
        raise ValueError(f"the state must hold what orders it: {', '.join(missing)}")
    schema = state_schema(stream, key, columns)

    def merge(batch: DataFrame, batch_id: int) -> None:
        arrived = materialize(latest_per_key(batch, key, order), "latest").select(key, *columns)
        stored = read_latest(
            batch.sparkSession, table, schema, key, order, before=batch_id, only=arrived.select(key)
        )
        stored = materialize(stored, "stored")
        both = stored.select(key, *columns, F.lit(0).alias("_new")).union(arrived.withColumn("_new", F.lit(1)))
        latest = latest_per_key(both, key, [*order, "_new"])
        write_batch(changes(stored, latest, key, columns, F.current_timestamp()), table, batch_id)

    return run_available(stream, checkpoint, merge)


def read_latest(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    key: str,
    order: Sequence[str] = (),
    before: int | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """The last change of every key by ``order`` and batch, or of the keys in ``only``."""
    log = tables.read_table(spark, table, T.StructType(schema.fields + [_BATCH]))
    if before is not None:
        log = log.filter(F.col("batch_id") < before)
    if only is not None:
        log = log.join(only, key, "left_semi")
    return latest_per_key(log, key, [*order, "batch_id"]).select(*schema.fieldNames())


def compact(
    spark: SparkSession, table: str, target: str, schema: T.StructType, key: str, order: Sequence[str] = ()
) -> None:
    """The table as a new log of one batch, older than any batch of a stream."""
    write_batch(read_latest(spark, table, schema, key, order), target, -1)


def dedupe_within_watermark(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Bounded-state variant: repeats of a key within ``delay`` are dropped.

    Unlike :func:`ingest_stream` it forgets old keys and drops late keyed rows.
    Rows without a key all pass.
    """
    keyed = stream.filter(F.col(key).isNotNull()).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark([key]).unionByName(stream.filter(F.col(key).isNull()))
