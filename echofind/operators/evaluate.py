"""How good and how fast approximate search is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofind.session import broadcast_if_small, materialize

_ACCURACY = 100_000  # rank error of the sketch: 1 / 100,000 of the rows
_MOST_GROUPS = 1_000_000

CUTOFFS = (1, 5, 10)
MIN_DEPTH = 10


def search_depth(k: int) -> int:
    """Search at least to rank 10, so that every cutoff exists."""
    return max(k, MIN_DEPTH)


def first_by_hash(df: DataFrame, mark: Column, size: int, enough=None) -> DataFrame:
    """The rows among which the ``size`` smallest by the hex hash ``mark`` are.

    A bound on the hash keeps a few times ``size`` rows, so a following sort and
    limit sees few rows however large the table is. The bound is raised until
    ``enough`` (rows, if not given) counts ``size`` or the whole table is in.
    """
    total = df.count()
    kept = 4 * size + 64
    while kept < total:
        bound = f"{int(kept / total * 0xFFFFFFFF):08x}"
        some = df.where(F.substring(mark, 1, 8) <= bound)
        if (enough(some) if enough else some.count()) >= size:
            return some
        kept *= 4
    return df


def sample_reports(reports: DataFrame, size: int, seed: str = "") -> DataFrame:
    """``size`` reports in md5 order of their ids: the same rows on every run."""
    mark = F.md5(F.concat(F.lit(seed), F.col("id").cast("string")))
    return first_by_hash(reports, mark, size).orderBy(mark, "id").limit(size)


def compare(truth: DataFrame, actual: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Per query: hit_at_n (any shared id among the first n) and found_at_n (share found).

    An id both lists hold within n has both ranks <= n, so the larger of the
    two ranks says from which cutoff on it counts. One join on (query, id).
    """
    t = truth.select("query_id", "id", F.col("rank").alias("truth_rank"))
    a = actual.select("query_id", "id", F.col("rank").alias("actual_rank"))
    both = F.when(F.col("actual_rank").isNotNull(), F.greatest("truth_rank", "actual_rank"))
    columns = []
    for n in cutoffs:
        shared = F.count_if(both <= n)
        columns.append(F.when(shared > 0, 1.0).otherwise(0.0).alias(f"hit_at_{n}"))
        columns.append((shared / F.count_if(F.col("truth_rank") <= n)).alias(f"found_at_{n}"))
    return t.join(a, ["query_id", "id"], "left").groupBy("query_id").agg(*columns)


def hit_rate(per_query: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """recall_at_n as the reports define it: the share of queries with a hit."""
    return per_query.agg(
        F.count("*").alias("queries_evaluated"), *[F.avg(f"hit_at_{n}").alias(f"recall_at_{n}") for n in cutoffs]
    )


def true_recall(per_query: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """The mean share of true neighbours found; stricter than the hit rate."""
    return per_query.agg(
        F.count("*").alias("queries_evaluated"), *[F.avg(f"found_at_{n}").alias(f"true_recall_at_{n}") for n in cutoffs]
    )


def latency_summary(log: DataFrame, latency: str, *groups: str, p: float = 0.95) -> DataFrame:
    """Count, mean and 95th percentile (interpolated, exact) of a latency column."""
    tails = percentile(log, latency, p, *groups).withColumnRenamed("percentile", "p95_latency_ms")
    return tails.select(
        *groups,
        F.col("rows").alias("queries_evaluated"),
        F.col("mean").alias("average_latency_ms"),
        "p95_latency_ms",
    )


def percentile(df: DataFrame, value: str, p: float, *groups: str, accuracy: int = _ACCURACY) -> DataFrame:
    """(groups, rows, mean, percentile), interpolated and exact.

    NULL and NaN count as rows only; a group without any other value has a NULL
    mean and percentile. A sketch first brackets the percentile of each group
    between two values closely around it. A second pass counts what lies below
    the bracket and the distinct values within, a tiny share of the rows; only
    those are put in order.
    """
    number = F.col(value).cast("double")
    values = df.select(F.struct(F.lit(0), *groups).alias("_group"), F.when(~F.isnan(number), number).alias("_x"))
    margin = 3 / accuracy
    ends = F.array(F.lit(max(p - margin, 0.0)), F.lit(min(p + margin, 1.0)))
    brackets = values.groupBy("_group").agg(
        F.count("*").alias("_all"),
        F.count("_x").alias("rows"),
        F.avg("_x").alias("mean"),
        F.percentile_approx("_x", ends, accuracy).alias("_ends"),
    )
    # A small group is ordered whole: there the next rank may lie outside the bracket.
    everything = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    brackets = brackets.withColumn("_ends", F.when(F.col("rows") <= accuracy, everything).otherwise(F.col("_ends")))
    brackets = materialize(brackets, "brackets")
    low, high = F.col("_ends")[0], F.col("_ends")[1]
    # Values under the bracket count under one stand-in, so that they combine before the shuffle.
    known = values.where("_x IS NOT NULL")
    placed = known.join(broadcast_if_small(brackets.select("_group", "_ends"), _MOST_GROUPS), "_group")
    placed = placed.withColumn("_at", F.when(F.col("_x") >= low, F.col("_x")).otherwise(F.lit(float("-inf"))))
    counts = placed.filter(F.col("_x") <= high).groupBy("_group", "_at").agg(F.count("*").alias("_n"))
    through = F.sum("_n").over(Window.partitionBy("_group").orderBy("_at"))
    ordered = counts.withColumn("_through", through).join(brackets.select("_group", "rows"), "_group")
    place = (F.col("rows") - 1) * p
    lower = F.min(F.when(F.col("_through") > F.floor(place), F.col("_at")))
    upper = F.min(F.when(F.col("_through") > F.ceil(place), F.col("_at")))
    found = ordered.groupBy("_group").agg(lower.alias("_lower"), upper.alias("_upper"))
    share = place - F.floor(place)
    return brackets.join(found, "_group", "left").select(
        *[F.col("_group")[g].alias(g) for g in groups],
        F.col("_all").alias("rows"),
        "mean",
        (F.col("_lower") + share * (F.col("_upper") - F.col("_lower"))).alias("percentile"),
    )


def vector_audit(reports: DataFrame, dim: int) -> DataFrame:
    """Rows, and rows whose vector has the right dimension."""
    return reports.agg(
        F.count("*").alias("total_rows"), F.count_if(F.size("embedding") == dim).alias("valid_vectors")
    )
