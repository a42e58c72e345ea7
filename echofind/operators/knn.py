"""Nearest neighbours by cosine distance.

Three physical forms, one result:

* one vector: a distance column, ``orderBy`` and ``limit`` (a top-k heap per
  task, nothing shuffled but k rows each);
* a batch of queries under a checked size: the queries are broadcast, each
  task scores its reports and emits at most k rows per query;
* any larger batch: queries and reports are cut into stripes by hash of their
  ids, and every stripe of queries meets every stripe of reports. There are as
  many meetings as keep the cluster busy, so a row is sent a fixed number of
  times; a task holds its queries and reads its reports as they come.

The last two also take candidate keys (inverted lists, hash buckets): then
only rows that share a key are scored. A large batch is then cut into cells of
bounded size; the rows of a larger key lie in packed blocks that meet each other.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofind.functions.vectors import distance_to
from echofind.operators import blocks
from echofind.operators.scoring import HITS, QueryBlock, ReportBlock, TopK, score
from echofind.operators.validate import check_k, check_vector
from echofind.session import broadcast_if_small, materialize

BROADCAST_QUERIES = 20_000
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_KEYS = 4_000_000
CELL_ROWS = 50_000
LEAST_CELL_ROWS = 4_096
MOST_TASKS = 10_000
#: Bytes of vectors in double precision: of a block, and of the report blocks that a task keeps for its next queries.
BLOCK_BYTES = 24 * 1024 * 1024
KEPT_BYTES = 32 * 1024 * 1024
STRIPE_BYTES = 128 * 1024 * 1024
WAVES = 4
TASK_BYTES = 1 << 30


def nearest(reports: DataFrame, vector: Sequence[float], k: int = 5, dim: int | None = None) -> DataFrame:
    """The k reports nearest to one vector, with their ``distance``.

    Filters set on ``reports`` beforehand reach the scan.
    """
    check_k(k)
    check_vector(vector, dim)
    return (
        reports.withColumn("distance", distance_to(vector)(F.col("embedding")))
        .orderBy("distance", "id")
        .limit(k)
    )


def knn_join(
    queries: DataFrame,
    reports: DataFrame,
    k: int,
    filters: tuple[str, ...] = (),
    key_column: str | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    cell_rows: int = CELL_ROWS,
    least: float | None = None,
) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest reports of every query.

    With ``least``, only those whose cosine reaches it; a zero vector has none.

    ``queries`` holds query_id, embedding, optionally exclude_id, and one
    column per name in ``filters`` (NULL or '' = any). ``reports`` holds id,
    embedding and the filter columns. A ``keys`` array column on both sides
    limits scoring to rows with a common key; reports may instead name a scalar
    ``key_column`` (such as a stored list id), which then prunes the scan.
    """
    check_k(k)
    keyed = "keys" in queries.columns
    if "exclude_id" not in queries.columns:
        queries = queries.withColumn("exclude_id", F.lit(None).cast("bigint"))
    extra = list(filters) + (["keys"] if keyed else [])
    if key_column:
        reports = reports.withColumn("keys", F.array(F.col(key_column).cast("bigint")))
    # Aliases give each side columns of its own when a table is joined with itself.
    queries = queries.select(
        F.col("query_id").cast("bigint").alias("query_id"),
        F.col("exclude_id").cast("bigint").alias("exclude_id"),
        *[F.col(c).alias(c) for c in ["embedding", *extra]],
    )
    # their size is known before any of them comes to the driver
    queries = materialize(queries, "queries")
    n, values = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding").cast("bigint")), F.lit(0))).first()
    small = n <= broadcast_queries and values * 8 <= BROADCAST_BYTES
    head = queries.toArrow() if small else None
    if small and key_column:
        reports = reports.filter(F.col(key_column).isin(head["keys"].combine_chunks().flatten().unique().to_pylist()))
    reports = reports.select(
        F.col("id").cast("bigint").alias("id"), *[F.col(c).alias(c) for c in ["embedding", *extra]]
    )
    if n == 0:
        hits = queries.sparkSession.createDataFrame([], HITS)
    elif small:
        hits = _broadcast_hits(QueryBlock.of(head, filters, keyed), reports, k, filters, keyed, least)
    elif keyed:
        hits = _cell_hits(queries, reports, k, filters, cell_rows, least)
    else:
        hits = _stripe_hits(queries, reports, n, values, k, filters, cell_rows, least)
    return rank_hits(hits, k)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Best k per query; a report found several times counts once.

    Both steps use the one partitioning by query.
    """
    once = hits.repartition("query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        once.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "distance")
    )


def _broadcast_hits(block: QueryBlock, reports: DataFrame, k: int, filters, keyed: bool, least: float | None) -> DataFrame:
    shared = reports.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        queries = shared.value
        best = TopK(len(queries.ids), k, least)
        for batch in batches:
            score(queries, ReportBlock(batch, k, filters, keyed), best, keyed)
        yield best.to_batch(queries.ids)

    # A task emits k rows per query however much it reads, so small splits are
    # read together: a task for every TASK_BYTES of input, by Spark's estimate.
    size = int(str(reports._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least_tasks = reports.sparkSession.sparkContext.defaultParallelism
    return reports.coalesce(max(least_tasks, min(size // TASK_BYTES, 1 << 20))).mapInArrow(run, HITS)


def _stripe_hits(
    queries: DataFrame, reports: DataFrame, n: int, values: int, k: int, filters, cell_rows: int, least: float | None
) -> DataFrame:
    """All pairs: stripes of queries meet stripes of reports, ``cell_rows`` reports at a time.

    About :data:`WAVES` meetings for every core, in a square, so a row goes to as
    many tasks as the root of that number. Only stripes of queries are held, and
    there are more of them where one would pass :data:`STRIPE_BYTES`.
    """
    side = math.isqrt(WAVES * queries.sparkSession.sparkContext.defaultParallelism - 1) + 1
    tall = max(min(side, n), -(-(8 * values + 16 * n * k) // STRIPE_BYTES))

    def dealt(rows: DataFrame, spot: str, own: int, other: int, cell: Column) -> DataFrame:
        rows = rows.withColumn("_own", F.pmod(F.xxhash64(spot), F.lit(own)).cast("int"))
        return rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).withColumn("_cell", cell)

    asked = dealt(queries, "query_id", tall, side, F.col("_own") * side + F.col("_other"))
    found = dealt(reports, "id", side, tall, F.col("_other") * side + F.col("_own"))
    none = F.lit(None)
    types = {(df, f): df.schema[f].dataType for df in (queries, reports) for f in filters}
    asked = asked.select(
        "_cell", F.lit(0).alias("_side"), "query_id", "exclude_id", none.cast("bigint").alias("id"), "embedding",
        *[F.col(f).alias(f"_asked_{f}") for f in filters], *[none.cast(types[reports, f]).alias(f"_found_{f}") for f in filters],
    )
    found = found.select(
        "_cell", F.lit(1).alias("_side"), none.cast("bigint").alias("query_id"), none.cast("bigint").alias("exclude_id"), "id", "embedding",
        *[none.cast(types[queries, f]).alias(f"_asked_{f}") for f in filters], *[F.col(f).alias(f"_found_{f}") for f in filters],
    )
    met = asked.union(found).repartitionById(tall * side, F.col("_cell")).sortWithinPartitions("_cell", "_side")

    def renamed(rows: pa.Table, prefix: str) -> pa.Table:
        return rows.rename_columns([c.removeprefix(prefix) for c in rows.column_names])

    def run(batches):
        cell, held, block, best = None, [], None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            place = 2 * rows["_cell"].to_numpy().astype(np.int64) + rows["_side"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                here, reported = divmod(int(place[low]), 2)
                if here != cell:
                    if best is not None:
                        yield best.to_batch(block.ids)
                    cell, held, block, best = here, [], None, None
                part = rows.slice(low, high - low)
                if not reported:
                    held.append(renamed(part, "_asked_"))
                elif held:
                    if best is None:
                        block = QueryBlock.of(pa.concat_tables(held), filters)
                        best = TopK(len(block.ids), k, least)
                    part = renamed(part, "_found_")
                    for at in range(0, part.num_rows, cell_rows):
                        score(block, ReportBlock(part.slice(at, cell_rows), k, filters), best)
        if best is not None:
            yield best.to_batch(block.ids)

    return met.mapInArrow(run, HITS)


def _cell_hits(
    queries: DataFrame, reports: DataFrame, k: int, filters, cell_rows: int, least: float | None
) -> DataFrame:
    """Score rows that share a key, in cells of about ``cell_rows`` x ``cell_rows`` rows at most.

    Cells have fewer rows where that takes about :data:`WAVES` cells for every core
    to share the pairs evenly, but :data:`LEAST_CELL_ROWS` if they may.
    The rows of a key with more are packed into blocks, and every block of its
    queries meets every block of its reports; no row is copied for it. The many
    smaller keys share cells by hash of the key.

    A group of exact copies would sit under one key and meet itself. Only its
    k + 1 lowest ids can ever be among the best k (one id may be excluded), so
    the rest of the group goes no further. Reports are written once, as they
    are counted by key before they are cut; queries come as a stored table.
    """
    queries = queries.withColumn("key", F.explode("keys")).drop("keys")
    reports = materialize(lowest_ids_per_vector(reports, k + 1, filters), "reports")
    reports = reports.withColumn("key", F.explode("keys")).drop("keys")
    sizes = materialize(_key_sizes(queries, reports), "key-sizes")
    both, pairs = sizes.agg(F.count("*"), F.sum(F.col("queries").cast("double") * F.col("reports"))).first()
    even = math.isqrt(int(pairs or 0) // (WAVES * queries.sparkSession.sparkContext.defaultParallelism))
    cell_rows = min(cell_rows, max(even, LEAST_CELL_ROWS))
    # A hot key has over cell_rows rows, so there are rows / cell_rows of them at most.
    hot = sizes.where((F.col("queries") > cell_rows) | (F.col("reports") > cell_rows)).select("key")
    n_hot, hot = hot.count(), broadcast_if_small(hot, BROADCAST_KEYS)
    if n_hot == 0:
        return _shared_cells(queries, reports, k, filters, cell_rows, least)
    many = _block_hits(*(side.join(hot, "key", "left_semi") for side in (queries, reports)), k, filters, cell_rows, least)
    if n_hot == both:
        return many
    few = (side.join(hot, "key", "left_anti") for side in (queries, reports))
    return _shared_cells(*few, k, filters, cell_rows, least).unionByName(many)


def _shared_cells(queries: DataFrame, reports: DataFrame, k: int, filters, cell_rows: int, least: float | None) -> DataFrame:
    """Cells by hash of the key."""
    rows = [side.count() for side in (queries, reports)]
    cells = max(-(-max(rows) // cell_rows), int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return TopK(0, k).to_table([])
        block = QueryBlock.of(left, filters, True)
        best = TopK(len(block.ids), k, least)
        score(block, ReportBlock(right, k, filters, True), best, True)
        return best.to_table(block.ids)

    # By number: few bytes of a cell mean much work, so tasks must not be joined by bytes.
    cell = F.pmod(F.xxhash64("key"), F.lit(cells)).alias("cell")
    queries, reports = (side.select("*", cell).repartition(min(cells, MOST_TASKS), "cell") for side in (queries, reports))
    return queries.groupBy("cell").cogroup(reports.groupBy("cell")).applyInArrow(run, HITS)


def _block_hits(queries: DataFrame, reports: DataFrame, k: int, filters, cell_rows: int, least: float | None) -> DataFrame:
    """Blocks of queries and of reports of one key meet, some sixteen pairs of them in the place of a cell."""
    side = math.isqrt(WAVES * queries.sparkSession.sparkContext.defaultParallelism - 1) + 1
    width = max(reports.agg(F.max(F.size("embedding"))).first()[0] or 1, 1)
    size = max(1, min(cell_rows // 4, BLOCK_BYTES // (8 * width)))

    def run(batches):
        known, room = {}, KEPT_BYTES
        for _, key, mine, others in blocks.met(batches):
            block = QueryBlock.of(blocks.unpack(mine), filters, True)
            best = TopK(len(block.ids), k, least)
            for b, _, other in (o for o in others if o[1] == key):
                part = known.get(b)
                if part is None:
                    part = ReportBlock(blocks.unpack(other), k, filters, True)
                    if part.vectors.nbytes <= room:
                        known[b], room = part, room - part.vectors.nbytes
                score(block, part, best, True)
            yield best.to_batch(block.ids)

    asked, found = (blocks.packed(rows, size, "key") for rows in (queries, reports))
    return blocks.meetings(asked, found, side).mapInArrow(run, HITS)


def lowest_ids_per_vector(reports: DataFrame, n: int, filters: tuple[str, ...] = ()) -> DataFrame:
    """Keep the n lowest ids among reports with equal vector and filter values.

    Vectors are told apart by 96 bits of hash. Groups of over n rows are counted
    first, combined before the shuffle; only their rows are put in order, and
    Spark applies the row limit per task before it shuffles them. All other
    reports stay where they are.
    """
    marked = reports.withColumn("_mark", F.struct(F.xxhash64("embedding").alias("a"), F.hash("embedding").alias("b")))
    keys = ["_mark", *filters]
    counts = marked.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > n)
    crowded = materialize(counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]), "crowded")
    if crowded.isEmpty():
        return reports
    crowded = broadcast_if_small(crowded, BROADCAST_KEYS)
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    copies = Window.partitionBy(*keys).orderBy("id")
    many = marked.join(crowded, same, "left_semi").withColumn("_copy", F.row_number().over(copies))
    many = many.filter(F.col("_copy") <= n).drop("_copy")
    return marked.join(crowded, same, "left_anti").unionByName(many).drop("_mark")


def _key_sizes(queries: DataFrame, reports: DataFrame) -> DataFrame:
    """Keys that both sides have, with the rows of each."""
    q = queries.groupBy("key").agg(F.count("*").alias("queries"))
    r = reports.groupBy("key").agg(F.count("*").alias("reports"))
    return q.join(r, "key")


def equal_to(
    filters: dict[str, object] | None, allowed: Sequence[str], stored: dict[str, str] | None = None
) -> Column:
    """AND of equality tests on allowed columns; no filters gives TRUE.

    ``stored`` names the columns that are kept under another name.
    """
    filters = filters or {}
    unknown = sorted(set(filters) - set(allowed))
    if unknown:
        raise ValueError(f"cannot filter on {', '.join(unknown)}; allowed: {', '.join(allowed)}")
    condition = F.lit(True)
    for name, value in filters.items():
        condition = condition & (F.col((stored or {}).get(name, name)) == value)
    return condition
