"""Stored keys by hash bucket, with a Bloom filter per bucket and load.

Tells which keys of a batch a table holds already, without a scan of the table: the
batch first meets the filters of its own buckets, and only the buckets and loads that
may hold one of its keys are opened. A load's keys and filters stand in folders of
their own, and are overwritten when the load is run again::

    <path>/layout                        one row: the number of buckets
    <path>/keys/load=<n>/bucket=<b>      the distinct keys of a load
    <path>/filters/load=<n>/bucket=<b>   rows (words, word, bits): 64 bits of a filter

Filters are rows, not objects: they are built by ``bit_or`` per word and probed by a
join, so neither the driver nor a task holds a whole filter, and all of it stays in
the JVM. NULL is not a key. One writer at a time, as for the report table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofind.session import materialize
from echofind.sources import tables

BUCKETS = 256
BITS_PER_KEY = 12
HASHES = 5

_KEYS = "key string, load bigint, bucket int"
_FILTERS = "words int, word int, bits bigint, load bigint, bucket int"


@dataclass
class KeyTable:
    spark: SparkSession
    path: str
    buckets: int

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def stored(self) -> DataFrame:
        """(key, load, bucket) of all loads."""
        return _read(self.spark, f"{self.path}/keys", _KEYS)

    def filters(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/filters", _FILTERS)

    def next_load(self) -> int:
        """A number above all loads. Filters hold fewer rows than keys, and one column is read."""
        last = self.filters().agg(F.max("load")).first()[0]
        return 0 if last is None else last + 1

    def add(self, keys: DataFrame, load: int) -> None:
        """Store the distinct non-NULL values of the one column of ``keys`` as one load, or put them in its place."""
        key = F.col(keys.columns[0]).cast("string").alias("key")
        distinct = keys.select(key).where("key IS NOT NULL").distinct()
        rows = materialize(distinct.withColumn("bucket", self._bucket(F.col("key"))), "keys")
        words = filter_words(rows.count(), self.buckets)
        _write(rows, f"{self.path}/keys/load={load}")
        spots = rows.select("bucket", F.explode(_spots(F.col("key"), F.lit(words))).alias("spot"))
        spots = spots.select("bucket", F.lit(words).alias("words"), *_place("spot"))
        bits = spots.groupBy("bucket", "words", "word").agg(F.bit_or("bit").alias("bits"))
        _write(bits, f"{self.path}/filters/load={load}")

    def candidates(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """(key, bucket, load): where the filters say that a key may stand."""
        wanted = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).where("key IS NOT NULL").distinct()
        wanted = materialize(wanted.withColumn("bucket", self._bucket(F.col("key"))), "wanted")
        filters = self.filters()
        if before is not None:
            filters = filters.where(F.col("load") < before)
        filters = filters.where(F.col("bucket").isin(_values(wanted, "bucket")))
        # Sizes are powers of two: a few dozen values however many loads there are.
        sizes = _values(filters, "words")
        if not sizes:
            return wanted.withColumn("load", F.lit(None).cast("bigint")).where(F.lit(False))
        spots = wanted.withColumn("words", F.explode(F.array(*[F.lit(n) for n in sizes])))
        spots = spots.withColumn("spot", F.explode(F.array_distinct(_spots(F.col("key"), F.col("words")))))
        spots = spots.select("key", "bucket", "words", *_place("spot"))
        asked = spots.groupBy("key", "bucket", "words", "word").agg(F.bit_or("bit").alias("mask"))
        asked = asked.withColumn("asked", F.sum(F.bit_count("mask")).over(Window.partitionBy("key", "words")))
        met = asked.join(filters, ["bucket", "words", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        found = met.groupBy("key", "bucket", "load").agg(F.sum(F.bit_count("mask")).alias("met"), F.first("asked").alias("asked"))
        return found.where("met = asked").select("key", "bucket", "load")

    def known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The values of ``keys`` that are stored (by loads below ``before``): a column of the same name.

        Only the folders of the candidates' buckets and loads are read; both lists
        are bounded, by the number of buckets and of loads since :meth:`compact`.
        """
        name = keys.columns[0]
        maybe = materialize(self.candidates(keys, before), "maybe")
        here = self.stored().where(
            F.col("bucket").isin(_values(maybe, "bucket")) & F.col("load").isin(_values(maybe, "load"))
        )
        return here.join(maybe, ["bucket", "load", "key"], "left_semi").select(F.col("key").alias(name)).distinct()

    def compact(self, target: str) -> KeyTable:
        """All keys as one load, numbered -1, in a new folder."""
        table = create_keys(self.spark, target, self.buckets)
        table.add(self.stored().select("key"), -1)
        return table


def create_keys(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyTable:
    """An empty key table. ``buckets`` is fixed for its life: about the table's keys over ten million."""
    if buckets < 1:
        raise ValueError("a key table needs at least one bucket")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("errorifexists").parquet(f"{path}/layout")
    return KeyTable(spark, path, buckets)


def open_keys(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyTable:
    """The key table of a folder; one with ``buckets`` is made if there is none."""
    if not tables.table_exists(spark, f"{path}/layout"):
        return create_keys(spark, path, buckets)
    return KeyTable(spark, path, spark.read.parquet(f"{path}/layout").first()["buckets"])


def filter_words(keys: int, buckets: int) -> int:
    """Words of 64 bits in each bucket's filter: a power of two, for the mean bucket with a quarter to spare."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, 1.25 * keys / buckets * BITS_PER_KEY / 64))))


def _spots(key: Column, words: Column) -> Column:
    """The bits of a key: two hashes of other seeds than the bucket's, combined."""
    first, second = F.xxhash64(key, F.lit("first")), F.xxhash64(key, F.lit("second"))
    bits = words.cast("bigint") * 64
    # both hashes are cut first, so that no sum leaves 64 bits
    return F.array(*[F.pmod(F.pmod(first, bits) + F.lit(i) * F.pmod(second, bits), bits) for i in range(HASHES)])


def _place(spot: str) -> list[Column]:
    word = F.shiftright(spot, 6).cast("int").alias("word")
    return [word, F.expr(f"shiftleft(1L, cast({spot} & 63L AS int))").alias("bit")]


def _values(df: DataFrame, column: str) -> list:
    """The distinct values of a column that has few."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not tables.table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    """One file per bucket or so: rows of a bucket meet before they are written."""
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
