"""Latest state per key, and ids for new rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofind.session import materialize


def upsert(stored: DataFrame, batch: DataFrame, key: str, columns: Sequence[str], now: Column) -> DataFrame:
    """The table after the batch: one full outer join by ``key``.

    Both sides hold each key at most once (see ``latest_per_key``). New rows
    get both time stamps; ``updated_at`` of a stored row moves only when one of
    ``columns`` changes.
    """
    return _merged(stored, batch, key, columns, now).drop("_changed")


def changes(stored: DataFrame, batch: DataFrame, key: str, columns: Sequence[str], now: Column) -> DataFrame:
    """Only the rows of :func:`upsert` that are new or changed."""
    return _merged(stored, batch, key, columns, now).filter("_changed").drop("_changed")


def _merged(stored: DataFrame, batch: DataFrame, key: str, columns: Sequence[str], now: Column) -> DataFrame:
    old, new = stored.alias("old"), batch.select(key, *columns).alias("new")
    arrived, known = F.col(f"new.{key}").isNotNull(), F.col(f"old.{key}").isNotNull()
    differs = reduce(
        lambda a, b: a | b, [~F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in columns], F.lit(False)
    )
    changed = ~known | (arrived & differs)
    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(
        F.coalesce(f"new.{key}", f"old.{key}").alias(key),
        *[F.when(arrived, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns],
        F.when(known, F.col("old.created_at")).otherwise(now).alias("created_at"),
        F.when(changed, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
        changed.alias("_changed"),
    )


def assign_ids(df: DataFrame, order: Sequence[str], last_id: int = 0, id_column: str = "id") -> DataFrame:
    """Dense ids ``last_id + 1 ...`` in the given order, without a global window.

    The rows are range-sorted and written once, so their places are fixed even
    if a task is lost later. Only one count per task reaches the driver.
    """
    placed = materialize(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "places")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, total = [], last_id
    for row in counts:
        starts.append((row["_part"], total))
        total += row["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(id_column, F.col("_start") + place + 1)
        .drop("_part", "_start", "_place")
    )
