"""Filtered search in inverted lists that neither comes up short nor misses a nearer report.

Beside the lists stand counts: per list and filter value (or any value) its reports
and the largest angle between one of them and the list's centroid. A query first
probes as many of its nearest lists as hold k matching reports, at least ``probes``.
Its k-th distance then decides whether to go on: by the triangle inequality no report
of a list is nearer than the angle to the centroid less that radius, so only lists
whose bound lies below are read as well. The result equals exact search.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofind.functions.vectors import matrix, unit_rows
from echofind.operators import ann, knn
from echofind.session import broadcast_if_small, materialize

ANY = "*"
#: Angles are compared with this much to spare, distances with the last digit kept.
SLACK, DIGIT = 1e-6, 2e-9
BROADCAST_COUNTS = 1_000_000


def _angles(index: ann.IvfIndex):
    """An Arrow function: the angles of a vector to all centroids, NaN without a direction."""
    shared = ann._share(index)

    @F.arrow_udf(T.ArrayType(T.DoubleType(), containsNull=False))
    def angles(column: pa.Array) -> pa.Array:
        if len(column) == 0:
            return pa.array([], pa.list_(pa.float64()))
        found = np.arccos(np.clip(unit_rows(matrix(column)) @ unit_rows(shared.value.centroids).T, -1.0, 1.0))
        offsets = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel(), from_pandas=False))

    return angles


def list_counts(stored: DataFrame, index: ann.IvfIndex, filters: tuple[str, ...]) -> DataFrame:
    """(list_id, one key per filter, rows, radius) of reports stored with their ``list_id``.

    A key is ``*`` for any value, else ``=`` and the value. NULL values match no
    filter, so they count under ``*`` only; zero vectors count, but have no angle.
    """
    angle = F.element_at(_angles(index)("embedding"), F.col("list_id") + 1)
    rows = stored.withColumn("_angle", angle).select("list_id", F.when(~F.isnan("_angle"), F.col("_angle")).alias("_angle"), *filters)
    names = list(filters)
    sets = [["list_id", *some] for n in range(len(names) + 1) for some in itertools.combinations(names, n)]
    keys = [
        F.when(F.grouping(f) == 1, F.lit(ANY)).otherwise(F.concat(F.lit("="), F.col(f).cast("string"))).alias(f"{f}_key")
        for f in filters
    ]
    if not names:
        return rows.groupBy("list_id").agg(F.count("*").alias("rows"), F.max("_angle").alias("radius"))
    counted = rows.groupingSets(sets, "list_id", *names).agg(F.count("*").alias("rows"), F.max("_angle").alias("radius"), *keys)
    return counted.select("list_id", *[f"{f}_key" for f in filters], "rows", "radius").dropna(subset=[f"{f}_key" for f in filters])


def write_filtered(reports: DataFrame, index: ann.IvfIndex, path: str, filters: tuple[str, ...]) -> None:
    """Store the reports by list, and their counts in a folder that scans of ``path`` pass over."""
    ann.write_ivf(reports, index, path)
    stored = reports.sparkSession.read.parquet(path)
    list_counts(stored, index, filters).write.mode("overwrite").parquet(f"{path}/_counts")


def read_counts(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_counts")


def filtered_search(
    queries: DataFrame,
    stored: DataFrame,
    index: ann.IvfIndex,
    counts: DataFrame,
    k: int,
    probes: int = ann.PROBES,
    filters: tuple[str, ...] = (),
    bounded: bool = True,
    **limits,
) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest reports that match, from few lists.

    ``queries`` as for :func:`knn.knn_join`. Without ``bounded`` the lists of the
    first step are all: k rows wherever k exist, but not always the nearest. A
    query meets the counts of all lists, a row each, so batches of queries times
    lists should stay below what a shuffle can carry.
    """
    names = [f"{f}_key" for f in filters]
    if "exclude_id" not in queries.columns:
        queries = queries.withColumn("exclude_id", F.lit(None).cast("bigint"))
    queries = materialize(queries.select("query_id", "exclude_id", "embedding", *filters), "queries")
    wanted = [F.when(F.coalesce(F.col(f), F.lit("")) == "", ANY).otherwise(F.concat(F.lit("="), F.col(f))).alias(f"{f}_key") for f in filters]
    each = queries.select("query_id", "exclude_id", *wanted, F.posexplode(_angles(index)("embedding")).alias("list_id", "angle"))
    counts = counts.withColumn("list_id", F.col("list_id").cast("int"))
    lists = each.join(broadcast_if_small(materialize(counts, "counts"), BROADCAST_COUNTS), ["list_id", *names])
    nearest = Window.partitionBy("query_id").orderBy("angle", "list_id")  # a row per list; NaN last
    before = F.coalesce(F.sum("rows").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = F.lit(k) + F.when(F.col("exclude_id").isNull(), 0).otherwise(1)
    lists = lists.withColumn("first", (before < need) | (F.row_number().over(nearest) <= probes))
    lists = materialize(lists.select("query_id", "list_id", "angle", "radius", "first"), "lists")

    def probe(some: DataFrame) -> DataFrame:
        keys = some.groupBy("query_id").agg(F.collect_list(F.col("list_id").cast("bigint")).alias("keys"))
        return knn.knn_join(queries.join(keys, "query_id"), stored, k, filters, key_column="list_id", **limits)

    found = probe(lists.where("first"))
    if not bounded:
        return found
    found = materialize(found, "found")
    last = found.where(F.col("rank") == k).select("query_id", "distance")
    bound = F.acos(F.greatest(F.lit(-1.0), 1 - F.col("distance") - DIGIT)) + SLACK
    may = F.isnan("distance") | F.isnan("angle") | (F.col("angle") - F.col("radius") <= bound)
    more = materialize(lists.where("NOT first").join(last, "query_id").where(may).select("query_id", "list_id"), "more")
    if more.isEmpty():
        return found
    return knn.rank_hits(found.drop("rank").unionByName(probe(more).drop("rank")), k)


def pruned_join(
    queries: DataFrame, reports: DataFrame, k: int, filters: tuple[str, ...] = (), lists: int | None = None, **limits
) -> DataFrame:
    """The rows of :func:`knn.knn_join`, from the cells of the reports that can hold them.

    The cells are lists of a fresh index (:func:`ann.suggest_lists` of them, within
    an index's size). A query is sent to its nearest cells until they hold k
    reports, and then to those that the triangle inequality does not rule out;
    where vectors lie in clusters that is few of them. A report is sent once per
    chunk of queries in its cell.
    """
    rows = reports.select("id", "embedding", *filters)
    n = rows.count()
    if n == 0:
        return knn.knn_join(queries, rows, k, filters, **limits)
    usable = rows.where(F.exists("embedding", lambda x: x != 0))
    width = rows.select(F.size("embedding")).first()[0]
    most = max(1, ann.INDEX_BYTES // (8 * max(width, 1)))
    if usable.isEmpty():
        return knn.knn_join(queries, rows, k, filters, **limits)
    index = ann.train_ivf(usable, min(lists or ann.suggest_lists(n), most), iterations=1)
    stored = materialize(rows.withColumn("list_id", index.list_id(F.col("embedding"))), "cells")
    return filtered_search(queries, stored, index, list_counts(stored, index, filters), k, 1, filters, **limits)
