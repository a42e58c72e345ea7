"""Connected components of a graph given by its edges, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofind.session import broadcast_if_small, materialize

#: A node with fewer edges is never split over tasks.
LEAST_HUB = 1_000
_HUBS = 1_000_000


def _with_least(pairs: DataFrame, wanted: DataFrame, rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The least ``b`` of each ``a`` in ``pairs`` (about ``rows``), and the ``wanted`` ones of them joined to it.

    A node with more than a fair share of a task's rows is a hub; there are
    fewer hubs than tasks. Its pairs are dealt by hash of their other end and
    meet a copy of its one row.
    """
    best = pairs.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
    share = max(LEAST_HUB, rows // max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    if rows > share:
        best = materialize(best, f"{name}-least")
        hubs = best.where(F.col("n") > share).select("a", F.ceil(F.col("n") / share).cast("int").alias("parts"))
        hubs = materialize(hubs, f"{name}-hubs")
        if not hubs.isEmpty():
            hubs, parts = broadcast_if_small(hubs, _HUBS), F.coalesce("parts", F.lit(1))
            dealt = wanted.join(hubs, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
            copies = best.join(hubs, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
            return best, dealt.join(copies, ["a", "part"]).drop("part")
    return best, wanted.join(best, "a")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, from edges ``a`` and ``b`` of an ordered type.

    Larger neighbours are hung on the smallest neighbour, then the smaller ones,
    in turn, until nothing moves (two-phase star contraction): rounds grow with
    the logarithm of a component's size. Minima are combined before the shuffle
    and hubs are split. Each round's edges are written under the checkpoint
    folder. Nodes without an edge to another node are absent.
    """

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def large(pairs: DataFrame, rows: int) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        _, met = _with_least(both, both.where("b > a"), 2 * rows, name)
        return met.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()

    def small(pairs: DataFrame, rows: int) -> DataFrame:  # every pair has a > b
        best, met = _with_least(pairs, pairs, rows, name)
        moved = met.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return moved.union(best.select("a", F.col("least").alias("b"))).distinct()

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, name)
    seen = state(now)
    while True:
        hung = materialize(large(now, seen[0]), name)
        now = materialize(small(hung, seen[0]), name)
        found = state(now)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
