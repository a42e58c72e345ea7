"""Inverted lists that grow: loads under frozen centroids, drift, merge and split.

A load is a folder of its own, ``<path>/load=<n>/list_id=<l>``, and is overwritten when
it is run again. Its reports go to the nearest of the centroids that stand, so a search
over all loads finds what it would after a rebuild with those centroids. ``drift`` tells
when they no longer fit; ``merge_ivf`` writes all loads as one and halves lists that
have grown beyond a bound, rewriting no centroid of another list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofind.functions.vectors import NAN_UNITS, UNITS, distance_units, matrix, unit_rows
from echofind.operators import ann, tree
from echofind.session import materialize


def append_ivf(reports: DataFrame, index: ann.IvfIndex, path: str, load: int) -> None:
    """Store a load of reports by list, in place of an earlier run of the same load."""
    _write(reports.withColumn("list_id", index.list_id(F.col("embedding"))), f"{path}/load={load}")


def read_ivf(spark: SparkSession, path: str) -> DataFrame:
    """The reports of all loads, with ``load`` and ``list_id``; for :func:`ann.ivf_search`."""
    return spark.read.parquet(path)


def drift(stored: DataFrame, index: ann.IvfIndex) -> DataFrame:
    """(load, list_id, reports, mean_distance): how well each load fits the centroids.

    Vectors of length zero are counted, but have no distance.
    """
    shared = ann._share(unit_rows(index.centroids))

    @F.arrow_udf(T.DoubleType())
    def to_own(vectors: pa.Array, lists: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.float64())
        cosine = np.einsum("ij,ij->i", unit_rows(matrix(vectors)), shared.value[lists.to_numpy()])
        return pa.array(np.rint(np.clip(1.0 - cosine, 0.0, 2.0) * UNITS) / UNITS, from_pandas=True)

    own = stored.select("load", "list_id", to_own(F.col("embedding"), F.col("list_id")).alias("distance"))
    return own.groupBy("load", "list_id").agg(F.count("*").alias("reports"), F.avg("distance").alias("mean_distance"))


def merge_ivf(stored: DataFrame, index: ann.IvfIndex, target: str, most_rows: int | None = None) -> ann.IvfIndex:
    """Write the reports of all loads as load 0 of a new folder; the index they are stored by.

    With ``most_rows``, a list with more reports is halved, and its halves again, until
    none has more or its vectors are all equal. One half keeps the list's number, the
    other gets a new one; only reports of split lists move. The halves are trained by
    one grouped pass a round over a bounded sample per list (:data:`tree.SAMPLE`); all
    of a list's reports are assigned.
    """
    rows = stored.drop("load")
    if most_rows is not None:
        if most_rows < 1:
            raise ValueError("most_rows must be at least 1")
        split = _too_large(rows, most_rows, set())
        if split:
            moving, rest = rows.where(F.col("list_id").isin(sorted(split))), rows.where(~F.col("list_id").isin(sorted(split)))
            moving, index = _halved(moving, index, most_rows)
            rows = rest.unionByName(moving)
    _write(rows, f"{target}/load=0")
    return index


def _too_large(rows: DataFrame, most_rows: int, whole: set[int]) -> set[int]:
    """Lists beyond the bound that may still be split: at most as many as there are lists."""
    sizes = rows.groupBy("list_id").agg(F.count("*").alias("rows")).where(F.col("rows") > most_rows)
    return {r.list_id for r in sizes.select("list_id").collect()} - whole


def _halved(moving: DataFrame, index: ann.IvfIndex, most_rows: int) -> tuple[DataFrame, ann.IvfIndex]:
    whole: set[int] = set()
    moving = materialize(moving, "moving")
    while split := _too_large(moving, most_rows, whole):
        halves = _halves(moving.where(F.col("list_id").isin(sorted(split))))
        whole |= {n for n in split if n not in halves}  # copies of one vector
        if not halves:
            continue
        centroids, other = index.centroids.copy(), {}
        for place, n in enumerate(sorted(halves), len(centroids)):
            centroids[n] = halves[n][0]
            other[n] = place
        index = ann.IvfIndex(np.concatenate([centroids, [halves[n][1] for n in sorted(halves)]]))
        moving = materialize(moving.withColumn("list_id", _half(index, other)), "moving")
        # a sample may not tell a list's vectors apart
        still = {r.list_id for r in moving.select("list_id").distinct().collect()}
        whole |= {n for n, place in other.items() if n not in still or place not in still}
    return moving, index


def _halves(rows: DataFrame) -> dict[int, np.ndarray]:
    """Two centroids for each list that has two different vectors."""
    marked = rows.select("id", "embedding", "list_id", F.md5(F.col("id").cast("string")).alias("mark"))
    sizes = rows.groupBy("list_id").agg(F.count("*").alias("rows"))  # one row per list, which are few
    share = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / float(1 << 32)
    some = marked.join(F.broadcast(sizes), "list_id").where(share * F.col("rows") < F.lit(2.0 * tree.SAMPLE))
    some = some.select("list_id", "mark", F.col("id").cast("bigint").alias("id"), "embedding")
    found = some.groupBy("list_id").applyInArrow(tree._new_leaves(2, 2), "list_id int, leaf bigint, centroid array<double>")
    table = found.orderBy("list_id", "leaf").toArrow()  # two rows per list
    halves: dict[int, list] = {}
    for n, row in zip(table["list_id"].to_pylist(), matrix(table["centroid"])):
        halves.setdefault(n, []).append(row)
    return {n: np.array(two) for n, two in halves.items() if len(two) == 2}


def _half(index: ann.IvfIndex, other: dict[int, int]) -> Column:
    """The nearer half of a report's list; ties and zero vectors stay. Lists not split keep their reports."""
    shared = ann._share((unit_rows(index.centroids), other))

    @F.arrow_udf(T.IntegerType())
    def choose(vectors: pa.Array, lists: pa.Array) -> pa.Array:
        here = lists.to_numpy().astype(np.int32)
        if len(here) == 0:
            return pa.array([], pa.int32())
        centroids, places = shared.value
        units, chosen = unit_rows(matrix(vectors)), here.copy()
        for n in np.unique(here):
            if int(n) in places:
                spots = np.flatnonzero(here == n)
                distance = distance_units(units[spots], centroids[[n, places[int(n)]]])
                moves = (distance[:, 1] < distance[:, 0]) & (distance[:, 0] < NAN_UNITS)
                chosen[spots[moves]] = places[int(n)]
        return pa.array(chosen)

    return choose(F.col("embedding"), F.col("list_id"))


def _write(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)
