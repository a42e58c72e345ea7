"""Approximate search against exact search on a sample, stored as a run."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofind.functions.embed import Embedder, embed_report
from echofind.operators import evaluate, knn
from echofind.operators.validate import check_benchmark
from echofind.plans.search import neighbours
from echofind.session import materialize
from echofind.sources import tables

TIMED_BATCHES = 5


def compare_on_sample(
    reports: DataFrame,
    sample_size: int,
    k: int,
    index_type: str,
    index=None,
    embedder: Embedder | None = None,
    **options,
) -> DataFrame:
    """Per sampled report: hits of a text search against the exact neighbours.

    The search starts from the cleaned text, the truth from the stored vector;
    both leave the report itself out.
    """
    sample = evaluate.sample_reports(reports, sample_size)
    sample = materialize(sample.select(F.col("id").alias("query_id"), "cleaned_text", "embedding"), "sample")
    stored = sample.select("query_id", "embedding", F.col("query_id").alias("exclude_id"))
    truth = knn.knn_join(stored, reports, evaluate.MIN_DEPTH)
    return evaluate.compare(truth, _searched(sample, reports, k, index_type, index, embedder, **options))


def _searched(sample, reports, k, index_type, index, embedder, **options) -> DataFrame:
    queries = sample.select(
        "query_id",
        embed_report(F.col("cleaned_text"), embedder).alias("embedding"),
        F.col("query_id").alias("exclude_id"),
    )
    return neighbours(queries, reports, evaluate.search_depth(k), index_type, index, **options)


def run_benchmark(
    reports: DataFrame,
    runs: str,
    sample_size: int = 20,
    k: int = 10,
    index_type: str = "exact",
    index=None,
    embedder: Embedder | None = None,
    **options,
) -> DataFrame:
    """Measure, append one row to the runs table and return it.

    A Spark job answers many queries at once, so latency is the time of a
    batch of sampled queries divided by its size; mean and 95th percentile are
    taken over a few batches.
    """
    check_benchmark(sample_size, k, index_type)
    quality = compare_on_sample(reports, sample_size, k, index_type, index, embedder, **options)
    measured = evaluate.hit_rate(quality).first()
    if measured.queries_evaluated < 2:
        raise ValueError("a benchmark needs at least 2 reports")
    sample = evaluate.sample_reports(reports, sample_size).select(F.col("id").alias("query_id"), "cleaned_text")
    sample = materialize(sample, "timed")
    times = []
    for part in range(TIMED_BATCHES):
        batch = sample.filter(F.pmod(F.xxhash64("query_id"), F.lit(TIMED_BATCHES)) == part)
        size = batch.count()
        if size:
            started = time.perf_counter()
            _searched(batch, reports, k, index_type, index, embedder, **options).write.format("noop").mode(
                "overwrite"
            ).save()
            times += [(time.perf_counter() - started) * 1000 / size] * size
    run = {
        "index_type": index_type,
        "k": k,
        "queries_evaluated": measured.queries_evaluated,
        "recall_at_1": measured.recall_at_1,
        "recall_at_5": measured.recall_at_5,
        "recall_at_10": measured.recall_at_10,
        "average_latency_ms": float(np.mean(times)),
        "p95_latency_ms": float(np.percentile(times, 95)),
    }
    return tables.append_run(reports.sparkSession, runs, run)
