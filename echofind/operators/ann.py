"""Approximate search: which rows are worth scoring.

Both methods give every vector integer keys; :func:`knn.knn_join` then scores
only pairs that share a key, exactly. ``IvfIndex`` clusters the vectors into
lists and probes the nearest lists of a query (index type ``ivfflat``).
``LshIndex`` signs them by random hyperplanes, in several tables (it answers
the index type ``hnsw``, whose graph has no counterpart in Spark).

Only centroids and hyperplanes reach the driver; their size is checked.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofind.functions.vectors import distance_units, matrix, unit_rows
from echofind.operators import knn
from echofind.operators.evaluate import first_by_hash
from echofind.session import materialize

# The dials of the two index types.
LISTS = 100
PROBES = 20
TABLES = 8
BITS = 8
FLIPS = 2
INDEX_BYTES = 64 * 1024 * 1024
MOST_BITS = 48

_KEYS = T.ArrayType(T.LongType(), containsNull=False)


def suggest_lists(rows: int) -> int:
    """sqrt(n) lists up to a million rows, n / 1000 beyond."""
    return max(1, round(math.sqrt(rows)) if rows <= 1_000_000 else rows // 1000)


@dataclass
class IvfIndex:
    centroids: np.ndarray

    def __post_init__(self):
        if self.centroids.nbytes > INDEX_BYTES:
            raise ValueError("too many lists: the centroids must stay small enough to broadcast")

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def nearest_lists(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists per row; ties and zero vectors go to the lower list."""
        units = distance_units(unit_rows(vectors), unit_rows(self.centroids))
        return np.argsort(units, axis=1, kind="stable")[:, :n]

    def list_id(self, vector: Column) -> Column:
        return F.element_at(self.probe(vector, 1), 1).cast("int")

    def probe(self, vector: Column, probes: int) -> Column:
        shared = _share(self)
        width = min(probes, self.lists)

        @F.arrow_udf(_KEYS)
        def keys(column: pa.Array) -> pa.Array:
            if len(column) == 0:
                return pa.array([], pa.list_(pa.int64()))
            return _fixed_lists(shared.value.nearest_lists(matrix(column), width))

        return keys(vector)


def train_ivf(reports: DataFrame, lists: int = LISTS, iterations: int = 2, fraction: float | None = None) -> IvfIndex:
    """Cosine k-means over the vectors, as DataFrame passes.

    Seeds are the distinct vectors first in md5 order of their ids. A pass sums
    vectors per list inside each task, then per list over tasks: one row per
    task and list is shuffled, however many rows a list holds. ``fraction``
    trains on a sample; every row is assigned in any case.
    """
    vectors = reports.select("id", "embedding")
    index = IvfIndex(unit_rows(_seeds(vectors, lists)))
    training = vectors.sample(fraction, seed=0) if fraction else vectors
    for _ in range(iterations):
        index = IvfIndex(_new_centroids(training.select("embedding"), index))
    return index


def _seeds(vectors: DataFrame, lists: int) -> np.ndarray:
    """The first ``lists`` distinct vectors in md5 order of the ids.

    A bound on the hash leaves a few times as many rows; it is raised while
    copies crowd out the rest. Warns if the table has fewer distinct vectors.
    """
    mark = F.md5(F.col("id").cast("string"))
    marked = vectors.where(F.exists("embedding", lambda x: x != 0)).select(mark.alias("mark"), "id", "embedding")

    def distinct(some: DataFrame) -> DataFrame:
        return some.groupBy("embedding").agg(F.min(F.struct("mark", "id")).alias("first"))

    some = first_by_hash(marked, F.col("mark"), lists, lambda rows: distinct(rows).count())
    seeds = matrix(distinct(some).orderBy("first").limit(lists).select("embedding").toArrow()["embedding"])
    if len(seeds) == 0:
        raise ValueError("there are no vectors to train on")
    if len(seeds) < lists:
        warnings.warn(f"only {len(seeds)} distinct vectors for {lists} lists", stacklevel=3)
    return seeds


def _new_centroids(vectors: DataFrame, index: IvfIndex) -> np.ndarray:
    shared = _share(index)
    shape = index.centroids.shape

    def sums_of_rows(batches):
        total = np.zeros(shape)
        for batch in batches:
            rows = matrix(batch.column("embedding"))
            if len(rows):
                np.add.at(total, shared.value.nearest_lists(rows, 1)[:, 0], np.nan_to_num(unit_rows(rows)))
        yield _sum_rows(total)

    def sums_of_sums(batches):
        total = np.zeros(shape)
        for batch in batches:
            rows = matrix(batch.column("total"))
            if len(rows):
                np.add.at(total, batch.column("list_id").to_numpy(), rows)
        yield _sum_rows(total)

    schema = "list_id bigint, total array<double>"
    sums = vectors.mapInArrow(sums_of_rows, schema).repartition("list_id").mapInArrow(sums_of_sums, schema).toArrow()
    centroids = index.centroids.copy()  # an empty list stays where it was
    if sums.num_rows:
        centroids[sums["list_id"].to_numpy()] = unit_rows(matrix(sums["total"]))
    return centroids


def ivf_search(
    queries: DataFrame,
    reports: DataFrame,
    index: IvfIndex,
    k: int,
    probes: int = PROBES,
    filters: tuple[str, ...] = (),
    **limits,
) -> DataFrame:
    """k nearest among the reports in the ``probes`` nearest lists of a query.

    ``reports`` may carry ``list_id`` from :func:`write_ivf`; the scan is then
    pruned to the probed lists. A probe of every list meets every report, so no
    list is named for it: its keys would be queries times lists.
    """
    if probes >= index.lists:
        return knn.knn_join(queries, reports.drop("list_id"), k, filters, **limits)
    queries = queries.withColumn("keys", index.probe(F.col("embedding"), probes))
    if "list_id" in reports.columns:
        return knn.knn_join(queries, reports, k, filters, key_column="list_id", **limits)
    return knn.knn_join(queries, reports.withColumn("keys", index.probe(F.col("embedding"), 1)), k, filters, **limits)


def write_ivf(reports: DataFrame, index: IvfIndex, path: str) -> None:
    """Store the reports by list; run again after a bulk load to rebuild.

    The rebalance hint splits large lists over several files and tasks.
    """
    (
        reports.withColumn("list_id", index.list_id(F.col("embedding")))
        .hint("rebalance", "list_id")
        .write.mode("overwrite")
        .partitionBy("list_id")
        .parquet(path)
    )


def candidate_counts(queries: DataFrame, reports: DataFrame, index: IvfIndex, probes: int) -> DataFrame:
    """(query_id, candidates): report rows a probe of that many lists scans."""
    sizes = (
        reports.select(index.list_id(F.col("embedding")).cast("bigint").alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("rows"))
    )
    probed = queries.select("query_id", F.explode(index.probe(F.col("embedding"), probes)).alias("key"))
    # One row per list, and the number of lists is bounded by the index size.
    return (
        probed.join(F.broadcast(sizes), "key", "left")
        .groupBy("query_id")
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("candidates"))
    )


@dataclass
class LshIndex:
    dim: int
    tables: int = TABLES
    bits: int = BITS

    def __post_init__(self):
        if not 1 <= self.bits <= MOST_BITS:
            raise ValueError(f"bits must be between 1 and {MOST_BITS}")

    def planes(self) -> np.ndarray:
        """One +1/-1 normal per table and bit, the same in every session."""
        names = (f"{t}:{b}:{d}" for t in range(self.tables) for b in range(self.bits) for d in range(self.dim))
        signs = [1.0 if hashlib.md5(n.encode()).hexdigest()[0] < "8" else -1.0 for n in names]
        return np.array(signs).reshape(self.tables * self.bits, self.dim)

    def keys(self, vector: Column, flips: int = 0) -> Column:
        """One bucket per table, plus those with one of the ``flips`` closest bits turned."""
        shared = _share(self.planes())
        tables, bits = self.tables, self.bits
        flips = min(flips, bits)

        @F.arrow_udf(_KEYS)
        def signatures(column: pa.Array) -> pa.Array:
            if len(column) == 0:
                return pa.array([], pa.list_(pa.int64()))
            margins = (matrix(column) @ shared.value.T).reshape(len(column), tables, bits)
            places = 1 << np.arange(bits, dtype=np.int64)
            bucket = ((margins >= 0) * places).sum(axis=2) + (np.arange(tables, dtype=np.int64) << bits)
            closest = np.argsort(np.abs(margins), axis=2, kind="stable")[:, :, :flips]
            turned = bucket[:, :, None] ^ (1 << closest.astype(np.int64))
            return _fixed_lists(np.concatenate([bucket[:, :, None], turned], axis=2).reshape(len(column), -1))

        return signatures(vector)


def lsh_search(
    queries: DataFrame,
    reports: DataFrame,
    index: LshIndex,
    k: int,
    flips: int = FLIPS,
    filters: tuple[str, ...] = (),
    complete: bool = False,
    **limits,
) -> DataFrame:
    """k nearest among the reports that share a bucket with the query.

    ``reports`` may come from :func:`write_lsh`; nothing is signed anew then,
    and the scan is pruned to the probed buckets. With ``complete``, queries that
    found fewer than k probe all neighbouring buckets, and those still short go
    through the exact search, so that no query comes up short.
    """
    stored = "bucket" in reports.columns

    def probe(asking: DataFrame, flips: int) -> DataFrame:
        asking = asking.withColumn("keys", index.keys(F.col("embedding"), flips))
        if stored:
            return knn.knn_join(asking, reports, k, filters, key_column="bucket", **limits)
        signed = reports.withColumn("keys", index.keys(F.col("embedding")))
        return knn.knn_join(asking, signed, k, filters, **limits)

    found = probe(queries, flips)
    if not complete:
        return found
    # of a stored table, the first hash table holds every report once
    once = reports.where(F.col("bucket") < (1 << index.bits)) if stored else reports
    steps = [lambda short: probe(short, index.bits)] if flips < index.bits else []
    for step in [*steps, lambda short: knn.knn_join(short, once, k, filters, **limits)]:
        found = materialize(found, "lsh")
        enough = found.filter(F.col("rank") == k).select("query_id")
        short = queries.join(enough, "query_id", "left_anti")
        if short.isEmpty():
            return found
        found = found.join(enough, "query_id", "left_semi").unionByName(step(short))
    return found


def write_lsh(reports: DataFrame, index: LshIndex, path: str) -> None:
    """Store the reports once per hash table, in order of their ``bucket``; run again to rebuild.

    Files hold ranges of buckets, so a search reads those that hold its own; a
    large bucket spreads over several files.
    """
    signed = reports.withColumn("bucket", F.explode(index.keys(F.col("embedding"))))
    signed.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id").write.mode("overwrite").parquet(path)


def suggest_bits(rows: int) -> int:
    """Bits per hash table that leave about a thousand rows in a bucket."""
    return max(1, min(MOST_BITS, round(math.log2(max(rows, 2) / 1000)) if rows > 2000 else 1))


def _share(value):
    return SparkSession.active().sparkContext.broadcast(value)


def _fixed_lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.int64).ravel()))


def _sum_rows(total: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(total.any(axis=1))
    offsets = np.arange(len(used) + 1, dtype=np.int32) * total.shape[1]
    totals = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[used].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), totals], names=["list_id", "total"])
