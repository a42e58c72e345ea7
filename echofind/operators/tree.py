"""Inverted lists in two levels, for more lists than a broadcast can carry.

The upper level is an ordinary ``IvfIndex`` whose centroids are sent to all tasks. Each
of its lists is clustered again into leaves by one grouped pass over a bounded sample;
the leaves' centroids stay a table. A vector finds its list by broadcast and then its
leaf by a join with the leaves of that list, where a list with many rows is cut into
chunks. A query spreads its probes over both levels: the leaves of its nearest lists
compete for the nearest leaves overall.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofind.functions.vectors import NAN_UNITS, distance_units, matrix, unit_rows
from echofind.operators import ann, knn
from echofind.session import materialize

#: Training rows per leaf, about; a list with more rows is sampled by a hash of the id.
SAMPLE = 256


@dataclass
class IvfTree:
    """``top``: the lists; ``leaves``: a written table (list_id, leaf, centroid); ``width``: leaves per list at most."""

    top: ann.IvfIndex
    leaves: DataFrame
    width: int


def _new_leaves(width: int, iterations: int):
    """Cosine k-means of one list, from its first distinct vectors."""

    def train(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("mark", "ascending"), ("id", "ascending")])
        vectors = matrix(rows["embedding"])
        units = unit_rows(vectors)
        usable = np.flatnonzero(vectors.any(axis=1))
        first = np.sort(np.unique(vectors[usable], axis=0, return_index=True)[1])[:width]
        centroids = units[usable[first]]
        for _ in range(iterations if len(centroids) else 0):
            nearest = distance_units(units, unit_rows(centroids)).argmin(axis=1)
            total = np.zeros_like(centroids)
            np.add.at(total, nearest, np.nan_to_num(units))
            used = total.any(axis=1)
            centroids[used] = unit_rows(total[used])
        offsets = np.arange(len(centroids) + 1, dtype=np.int32) * vectors.shape[1]
        lists = rows["list_id"].to_numpy()[: len(centroids)]
        leaf = lists.astype(np.int64) * width + np.arange(len(centroids))
        return pa.table(
            {"list_id": lists, "leaf": leaf, "centroid": pa.ListArray.from_arrays(pa.array(offsets), pa.array(centroids.ravel()))}
        )

    return train


def train_tree(reports: DataFrame, lists: int, width: int, iterations: int = 2, fraction: float | None = None) -> IvfTree:
    """``lists`` lists of up to ``width`` leaves each.

    A list's leaves are trained on about ``SAMPLE`` rows per leaf at most, taken
    by a hash of the id; every row is assigned in any case.
    """
    top = ann.train_ivf(reports, lists, iterations, fraction)
    placed = reports.select("id", "embedding", top.list_id(F.col("embedding")).alias("list_id"))
    placed = materialize(placed.withColumn("mark", F.md5(F.col("id").cast("string"))), "placed")
    sizes = placed.groupBy("list_id").agg(F.count("*").alias("rows"))  # one row per list, which are few
    share = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / float(1 << 32)
    some = placed.join(F.broadcast(sizes), "list_id").where(share * F.col("rows") < F.lit(float(SAMPLE * width)))
    some = some.select("list_id", "mark", F.col("id").cast("bigint").alias("id"), "embedding")
    found = some.groupBy("list_id").applyInArrow(_new_leaves(width, iterations), "list_id int, leaf bigint, centroid array<double>")
    return IvfTree(top, materialize(found, "leaves"), width)


def _meet(rows: DataFrame, tree: IvfTree, spot: str, function, schema) -> DataFrame:
    """``function(rows, leaves)`` for the rows of each list and its leaves; large lists in chunks."""
    sizes = rows.groupBy("list_id").agg(F.ceil(F.count("*") / knn.CELL_ROWS).cast("int").alias("chunks"))
    rows = rows.join(F.broadcast(sizes), "list_id").withColumn("chunk", F.pmod(F.xxhash64(spot), F.col("chunks")).cast("int"))
    leaves = tree.leaves.join(F.broadcast(sizes), "list_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    left, right = rows.drop("chunks").groupBy("list_id", "chunk"), leaves.drop("chunks").groupBy("list_id", "chunk")
    return left.cogroup(right).applyInArrow(function, schema)


def assign(reports: DataFrame, tree: IvfTree) -> DataFrame:
    """``reports`` with the ``list_id`` and ``leaf`` of their vectors.

    In a list that has no leaves, as none of its rows was there at training,
    rows get the first leaf's number.
    """
    rows = materialize(reports.withColumn("list_id", tree.top.list_id(F.col("embedding"))), "reports")
    schema = T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())])
    width = tree.width

    def nearest(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        leaf = rows["list_id"].to_numpy().astype(np.int64) * width
        if leaves.num_rows and rows.num_rows:
            leaves = leaves.sort_by("leaf")
            units = distance_units(unit_rows(matrix(rows["embedding"])), unit_rows(matrix(leaves["centroid"])))
            leaf = leaves["leaf"].to_numpy()[units.argmin(axis=1)]
        return rows.drop_columns("chunk").append_column("leaf", pa.array(leaf, pa.int64()))

    return _meet(rows, tree, "id", nearest, schema)


def probe(queries: DataFrame, tree: IvfTree, lists: int, probes: int) -> DataFrame:
    """(query_id, keys): the ``probes`` nearest leaves among those of the ``lists`` nearest lists."""
    each = queries.select("query_id", "embedding", F.explode(tree.top.probe(F.col("embedding"), lists)).alias("list_id"))
    each = materialize(each.withColumn("list_id", F.col("list_id").cast("int")), "probed")
    width = tree.width

    def nearest(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        ids = rows["query_id"].to_numpy()
        if leaves.num_rows == 0 or rows.num_rows == 0:
            leaf = rows["list_id"].to_numpy().astype(np.int64) * width
            return pa.table({"query_id": ids, "leaf": leaf, "units": np.full(len(ids), NAN_UNITS)})
        leaves = leaves.sort_by("leaf")
        units = distance_units(unit_rows(matrix(rows["embedding"])), unit_rows(matrix(leaves["centroid"])))
        order = np.argsort(units, axis=1, kind="stable")[:, :probes]
        row = np.repeat(np.arange(len(ids)), order.shape[1])
        return pa.table({"query_id": ids[row], "leaf": leaves["leaf"].to_numpy()[order.ravel()], "units": units[row, order.ravel()]})

    found = _meet(each, tree, "query_id", nearest, "query_id bigint, leaf bigint, units bigint")
    best = Window.partitionBy("query_id").orderBy("units", "leaf")  # lists x probes rows a query
    kept = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= probes)
    return kept.groupBy("query_id").agg(F.collect_list("leaf").alias("keys"))


def write_tree(reports: DataFrame, tree: IvfTree, path: str) -> None:
    """Store the reports in order of their leaves; files hold ranges of leaves, a large leaf spreads over several."""
    assigned = assign(reports, tree)
    assigned.repartitionByRange("leaf", "id").sortWithinPartitions("leaf", "id").write.mode("overwrite").parquet(path)


def tree_search(
    queries: DataFrame,
    stored: DataFrame,
    tree: IvfTree,
    k: int,
    lists: int = 4,
    probes: int = ann.PROBES,
    filters: tuple[str, ...] = (),
    **limits,
) -> DataFrame:
    """k nearest among the reports in the probed leaves; ``stored`` comes from :func:`assign` or :func:`write_tree`."""
    keyed = queries.join(probe(queries, tree, lists, probes), "query_id")
    return knn.knn_join(keyed, stored, k, filters, key_column="leaf", **limits)
