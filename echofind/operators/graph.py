"""A neighbour graph: approximate search without lists, with one dial.

Built by NN-descent: every vector starts with a few partners at fixed steps along an
order by hash, and in each round the partners of a vector, in both directions, are
introduced to each other and the nearest are kept. One grouped pass per round compares
the vectors that meet at a node; both directions are bounded by ``degree``, so a group
never holds more than 2 * degree + 1 vectors, however popular one is.

To these come a few of the first steps, in both directions: they lead from one cluster
to others, between which nearest partners alone leave no way.

Searched by rounds of joins: a query keeps its ``ef`` best, and in each round those that
were not opened yet are opened, until none is left; a node that left the best can never
come back. A larger ``ef`` finds more and reads more. A query without such
nodes takes no part in later rounds. In a round, stripes of queries meet
stripes of nodes with the edges that lead there, so a vector is sent once per stripe of the
other side, not once per node that a query meets; only nodes that may enter the best leave
a meeting.

Equal vectors are one node; hits are led back to the reports that share it. Reports
without a direction (NULL or zero vectors) are not in the graph.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofind.functions.vectors import NAN_UNITS, UNITS, distance_units, matrix, unit_rows
from echofind.operators import knn
from echofind.operators.groups import _marks
from echofind.operators.scoring import HITS, _rough_error
from echofind.operators.upsert import assign_ids
from echofind.session import materialize

# The dials of the graph.
DEGREE, ROUNDS, EF, ENTRIES, SHORTCUTS = 16, 4, 80, 32, 4
#: Reports of one vector that a search can return; more than the largest k.
COPIES = 101
#: Meetings of stripes in a round for every core, and bytes of vectors that a meeting holds.
WAVES, STRIPE_BYTES = 2, 128 * 1024 * 1024
#: Queries that are looked at together, and pairs of them with nodes that are scored at a time.
QUERIES, PAIRS = 1024, 1 << 16

_STATE = "query_id bigint, node bigint, units bigint, weight bigint, opened boolean"


@dataclass
class GraphIndex:
    """``nodes`` (node, place, embedding), ``edges`` (v, u) in both directions, ``members`` (node, id)."""

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame


@F.arrow_udf(T.LongType())
def _units(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distance of two vectors in a row, in whole billionths."""
    if len(a) == 0:
        return pa.array([], pa.int64())
    distance = np.clip(1.0 - np.einsum("ij,ij->i", unit_rows(matrix(a)), unit_rows(matrix(b))), 0.0, 2.0)
    missing = np.isnan(distance)
    distance[missing] = 0.0
    return pa.array(np.where(missing, NAN_UNITS, np.rint(distance * UNITS).astype(np.int64)))


def _introduce(degree: int):
    """The nearest ``degree`` partners of each vector within its group; groups come in order of ``v``."""

    def compare(nodes, vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        units = unit_rows(vectors)
        apart = distance_units(units, units)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        order = np.argsort(apart, axis=1, kind="stable")[:, : min(degree, len(nodes) - 1)]
        row = np.repeat(np.arange(len(nodes)), order.shape[1])
        return nodes[row], nodes[order.ravel()], apart[row, order.ravel()]

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            v = rows["v"].to_numpy()
            cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
            last = cuts[-1] if len(cuts) else 0
            yield from done(rows.slice(0, last), cuts)
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield from done(held, np.array([held.num_rows]))

    def done(rows, cuts):
        if rows.num_rows:
            nodes, vectors = rows["u"].to_numpy(), matrix(rows["embedding"])
            parts = [compare(nodes[a:b], vectors[a:b]) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts)], ["a", "b", "units"])

    return run


def _both_ways(edges: DataFrame, degree: int) -> DataFrame:
    """(v, u): the edges, and of those that come in to a node the nearest ``degree``."""
    nearest = Window.partitionBy("b").orderBy("units", "a")
    back = edges.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= degree)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(back.select("b", "a")).distinct()


def build_graph(
    reports: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, shortcuts: int = SHORTCUTS
) -> GraphIndex:
    """The graph of all reports with a direction."""
    usable = reports.select("id", "embedding").where(F.exists("embedding", lambda x: x != 0))
    marked = usable.withColumn("mark", _marks("embedding"))
    found = marked.groupBy("mark").agg(F.min("id").alias("node"), F.min_by("embedding", "id").alias("embedding"))
    found = materialize(found.withColumn("spot", F.md5(F.col("node").cast("string"))), "nodes")
    nodes = assign_ids(found, ["spot", "node"], -1, "place")
    nodes = materialize(nodes.select("node", F.col("place").cast("bigint").alias("place"), "embedding", "mark"), "nodes")
    few = knn.lowest_ids_per_vector(usable, COPIES)
    members = few.withColumn("mark", _marks("embedding")).join(nodes.select("node", "mark"), "mark").select("node", "id")
    members, nodes = materialize(members, "members"), nodes.drop("mark")
    n = nodes.count()

    steps = F.explode(F.array(*[F.lit(1 << j).cast("bigint") for j in range(degree)]))
    first = nodes.select(F.col("node").alias("a"), "place", F.col("embedding").alias("x"), steps.alias("step"))
    first = first.withColumn("to", (F.col("place") + F.col("step")) % max(n, 1)).drop("place", "step").distinct()
    other = nodes.select(F.col("node").alias("b"), F.col("place").alias("to"), F.col("embedding").alias("y"))
    edges = first.join(other, "to").where("a <> b").select("a", "b", _units("x", "y").alias("units"))
    edges = materialize(edges, "edges")
    nearest = Window.partitionBy("a").orderBy("units", "b")  # 2 * degree + 1 groups of a vector, degree rows each
    for _ in range(rounds):
        meet = _both_ways(edges, degree).union(nodes.select(F.col("node").alias("v"), F.col("node").alias("u")))
        vectors = meet.join(nodes.select(F.col("node").alias("u"), "embedding"), "u").select("v", "u", "embedding")
        groups = vectors.repartition("v").sortWithinPartitions("v", "u")
        pairs = groups.mapInArrow(_introduce(degree), "a bigint, b bigint, units bigint").distinct()
        edges = pairs.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= degree).drop("place")
        edges = materialize(edges, "edges")
    steps = F.explode(F.array(*[F.lit(1 << j).cast("bigint") for j in range(shortcuts)])) if shortcuts else F.lit(0)
    ways = nodes.select(F.col("node").alias("v"), "place", steps.alias("step"))
    ways = ways.select("v", ((F.col("place") + F.col("step")) % max(n, 1)).alias("place"))
    ways = ways.join(nodes.select(F.col("node").alias("u"), "place"), "place").where("u <> v").select("v", "u")
    both = _both_ways(edges, degree).union(ways).union(ways.select("u", "v")).distinct()
    return GraphIndex(nodes, materialize(both, "graph"), members)


def write_graph(index: GraphIndex, path: str) -> None:
    """Store the graph; edges lie in order of the node they leave."""
    index.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    index.edges.repartitionByRange("v").sortWithinPartitions("v", "u").write.mode("overwrite").parquet(f"{path}/edges")
    index.members.write.mode("overwrite").parquet(f"{path}/members")


def read_graph(spark: SparkSession, path: str) -> GraphIndex:
    return GraphIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "members")))


def graph_search(
    queries: DataFrame, index: GraphIndex, k: int, ef: int = EF, entries: int = ENTRIES, rounds: int | None = None
) -> DataFrame:
    """(query_id, rank, id, distance): the nearest reports that a walk over the graph meets.

    ``queries`` holds query_id, embedding and optionally exclude_id. The walk ends
    once all of the ``ef`` best are open, whatever number of rounds that takes;
    ``rounds``, if given, ends it before.
    """
    if ef < k:
        raise ValueError("ef must be at least k")
    if "exclude_id" not in queries.columns:
        queries = queries.withColumn("exclude_id", F.lit(None).cast("bigint"))
    # A query_id that comes n times stands n times behind every node it meets, n * n times behind an entry.
    same = F.count("*").over(Window.partitionBy("query_id")).alias("weight")
    asked = queries.where("query_id IS NOT NULL")
    asked = materialize(asked.select("query_id", F.col("embedding").alias("asked"), "exclude_id", same), "queries")
    entry = index.nodes.where(F.col("place") < entries).select("node").join(index.nodes.select("node", "embedding"), "node")
    entry = entry.toArrow()  # as many rows as there are entries
    if entry.num_rows == 0:
        return knn.rank_hits(queries.sparkSession.createDataFrame([], HITS), k)
    most = max(ef, k + 1)
    state = asked.select("query_id", "asked", "weight").mapInArrow(_entered(entry), _STATE)
    meet = _meetings(asked, index, most)
    order = Window.partitionBy("query_id").orderBy("units", "node", F.desc("opened"))
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ended = []
    for _ in itertools.count() if rounds is None else range(rounds):
        ranked = state.withColumn("before", before).where(F.col("before") < most)
        near = F.col("before") < ef
        ranked = ranked.withColumn("fresh", near & ~F.col("opened")).withColumn("opened", F.col("opened") | near)
        going = F.max("fresh").over(Window.partitionBy("query_id"))
        ranked = materialize(ranked.withColumn("going", going), "walk")
        fresh = ranked.agg(F.count_if("fresh")).first()[0]
        ended.append(ranked.where("NOT going").select(*state.columns))
        ranked = ranked.where("going")
        state = ranked.select(*state.columns)
        if fresh == 0:
            break
        full = F.max(F.col("before") + F.col("weight")) >= most
        opening = ranked.groupBy("query_id").agg(
            F.collect_list(F.when(F.col("fresh"), F.col("node"))).alias("fresh"), F.when(full, F.max("units")).alias("bound")
        )
        new = meet(opening, fresh).join(ranked.select("query_id", "node"), ["query_id", "node"], "left_anti")
        state = state.union(new.select("query_id", "node", "units", F.lit(1).cast("bigint"), F.lit(False)))
    for part in ended:
        state = state.union(part)
    best = state.withColumn("before", before).where(F.col("before") <= k)
    best = best.groupBy("query_id", "node").agg(F.min("units").alias("units"))
    # one id may be excluded, so k + 1 of a node are enough
    copies = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    members = index.members.distinct().withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy")
    hits = best.join(members, "node").join(asked.select("query_id", "exclude_id"), "query_id")
    hits = hits.where(F.col("exclude_id").isNull() | (F.col("id") != F.col("exclude_id")))
    distance = F.when(F.col("units") >= NAN_UNITS, float("nan")).otherwise(F.col("units") / UNITS)
    return knn.rank_hits(hits.select("query_id", "id", distance.alias("distance")), k)


def _entered(entry: pa.Table):
    """Where the walks begin: every query with every entry."""
    nodes, vectors = entry["node"].to_numpy(), unit_rows(matrix(entry["embedding"]))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                units = distance_units(unit_rows(matrix(batch.column("asked"))), vectors)
                row, col = np.divmod(np.arange(units.size), len(nodes))
                query, weight = (batch.column(c).to_numpy()[row] for c in ("query_id", "weight"))
                columns = [query, nodes[col], units.ravel(), weight, np.zeros(len(row), bool)]
                yield pa.record_batch([pa.array(c) for c in columns], ["query_id", "node", "units", "weight", "opened"])

    return run


def _meetings(asked: DataFrame, index: GraphIndex, most: int):
    """A function of the nodes that queries open (query_id, fresh, bound) to those they meet (query_id, node, units).

    Stripes of queries meet stripes of nodes by hash of the ids. A row of a node is
    sent to every stripe of queries, and the other way round; a task holds the nodes
    and reads its queries as they come. Nodes beyond a query's ``bound``, if it has
    one, and beyond the best ``most`` of a meeting stay behind. Where queries open
    few nodes, only these nodes' edges and the ends of them are sent.
    """
    n, values = index.nodes.agg(F.count("*"), F.sum(F.size("embedding").cast("bigint"))).first()
    side = math.isqrt(WAVES * asked.sparkSession.sparkContext.defaultParallelism - 1) + 1
    tall, wide = side, max(side, -(-12 * values // STRIPE_BYTES))  # single and double precision are held
    kind = index.nodes.schema["embedding"].dataType
    if asked.schema["asked"].dataType != kind:
        kind = T.ArrayType(T.DoubleType())

    def stripe(spot: str, stripes: int) -> Column:
        return F.pmod(F.xxhash64(spot), F.lit(stripes)).cast("int")

    def dealt(rows: DataFrame, part: int, spot: str, vector: Column, nodes: Column, bound: Column, cell: Column) -> DataFrame:
        vector, nodes = vector.cast(kind).alias("vector"), nodes.cast("array<bigint>").alias("nodes")
        return rows.select(cell.alias("cell"), F.lit(part).alias("part"), F.col(spot).alias("id"), vector, nodes, bound.cast("bigint").alias("bound"))

    def everywhere(rows: DataFrame, stripes: int) -> DataFrame:
        return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

    none, there = F.lit(None), F.col("other") * wide + F.col("stripe")
    nodes = index.nodes.where("node IS NOT NULL").withColumn("stripe", stripe("node", wide))
    links = index.edges.groupBy("v", stripe("u", wide).alias("stripe")).agg(F.collect_set("u").alias("us"))
    links = materialize(links, "links")  # a node has few edges
    edges = links.agg(F.sum(F.size("us"))).first()[0] or 0

    def sent(opening: DataFrame, fresh: int) -> DataFrame:
        """Nodes and edges for the meetings that ``fresh`` opened nodes ask for."""
        if 2 * fresh * edges >= n * n * tall:
            ways, ends = everywhere(links, tall), everywhere(nodes, tall)
        else:
            asks = opening.select(stripe("query_id", tall).alias("other"), F.explode("fresh").alias("v")).distinct()
            ways = links.join(asks, "v")
            ends = nodes.join(ways.select("other", F.explode("us").alias("node")).distinct(), "node")
        return dealt(ends, 0, "node", F.col("embedding"), none, none, there).union(dealt(ways, 1, "v", none, F.col("us"), none, there))

    def meet(opening: DataFrame, fresh: int) -> DataFrame:
        rows = asked.select("query_id", "asked").join(opening, "query_id").withColumn("stripe", stripe("query_id", tall))
        rows = everywhere(rows, wide)
        rows = dealt(rows, 2, "query_id", F.col("asked"), F.col("fresh"), F.col("bound"), F.col("stripe") * wide + F.col("other"))
        met = sent(opening, fresh).union(rows).repartitionById(tall * wide, F.col("cell")).sortWithinPartitions("cell", "part")
        return met.mapInArrow(_walked(most), "query_id bigint, node bigint, units bigint")

    return meet


def _walked(most: int):
    def run(batches):
        cell, held, stripe = None, ([], []), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            place = 3 * rows["cell"].to_numpy().astype(np.int64) + rows["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                here, part = divmod(int(place[low]), 3)
                if here != cell:
                    cell, held, stripe = here, ([], []), None
                some = rows.slice(low, high - low)
                if part < 2:
                    held[part].append(some)
                    continue
                if stripe is None and all(held):
                    stripe, held = _Stripe(*map(pa.concat_tables, held)), ([], [])
                for at in range(0, some.num_rows if stripe else 0, QUERIES):
                    yield stripe.nearest(some.slice(at, QUERIES), most)

    return run


class _Stripe:
    """Nodes with their vectors, and the edges that lead to them."""

    def __init__(self, nodes: pa.Table, links: pa.Table):
        order = np.argsort(nodes["id"].to_numpy(), kind="stable")
        self.node = nodes["id"].to_numpy()[order]
        self.vectors = unit_rows(matrix(nodes["vector"])[order])
        self.rough = self.vectors.astype(np.float32)
        lists = links["nodes"].combine_chunks()
        to, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        low, high = (np.searchsorted(self.node, to, side) for side in ("left", "right"))
        self.to = _ranges(low, high - low)
        ends = np.concatenate([[0], np.cumsum(high - low)])[ends]
        order = np.argsort(links["id"].to_numpy(), kind="stable")
        self.v = links["id"].to_numpy()[order]
        self.start, self.count = ends[:-1][order], np.diff(ends)[order]

    def nearest(self, asked: pa.Table, most: int) -> pa.RecordBatch:
        """The nodes that the opened ones of each query lead to, as far as they may be among its best."""
        lists = asked["nodes"].combine_chunks()
        row, v = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.v, v), len(self.v) - 1)
        row, at = row[self.v[at] == v], at[self.v[at] == v]
        pairs = np.repeat(row, self.count[at]) * len(self.node) + self.to[_ranges(self.start[at], self.count[at])]
        row, to = np.divmod(np.unique(pairs), len(self.node))
        vectors, bound = unit_rows(matrix(asked["vector"])), asked["bound"].fill_null(NAN_UNITS).to_numpy()
        least = 1.0 - (bound + 1) / UNITS - _rough_error(vectors.shape[1])
        far = _products(vectors.astype(np.float32), self.rough, row, to) < least[row]
        row, to = row[~far], to[~far]
        distance = np.clip(1.0 - _products(vectors, self.vectors, row, to), 0.0, 2.0)
        missing = np.isnan(distance)
        distance[missing] = 0.0
        units = np.where(missing, NAN_UNITS, np.rint(distance * UNITS).astype(np.int64))
        row, to, units = row[units <= bound[row]], to[units <= bound[row]], units[units <= bound[row]]
        order = np.lexsort((self.node[to], units, row))
        row, to, units = row[order], to[order], units[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < most
        columns = [asked["id"].to_numpy()[row[kept]], self.node[to[kept]], units[kept]]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query_id", "node", "units"])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each ``start`` on."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _products(a: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    found = np.empty(len(row), a.dtype)
    for at in range(0, len(row), PAIRS):
        some = slice(at, at + PAIRS)
        found[some] = np.einsum("ij,ij->i", a[row[some]], b[column[some]])
    return found
