import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofind.operators import ann, evaluate, knn, pairs, scoring
from echofind.plans import search
from echofind.session import scratch_dir

DIM, N, K = 8, 120, 5
CELLS = {"broadcast_queries": 0, "cell_rows": 17}


def rounded(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return float("nan") if na == 0 or nb == 0 else abs(round(1 - float(a @ b) / (na * nb), 9))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(N, DIM)).astype(np.float32)
    vectors[40:80] = vectors[40]  # a third of all rows are copies
    vectors[90] = 0
    products = [["p", "q", None][i % 3] for i in range(N)]
    return vectors.astype(np.float64), products


@pytest.fixture(scope="module")
def reports(spark, data):
    rows = [(i, [float(x) for x in v], p) for i, (v, p) in enumerate(zip(*data))]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>, product string").repartition(3)


@pytest.fixture(scope="module")
def queries(reports):
    wanted = F.when(F.col("id") % 4 == 0, F.lit("p")).when(F.col("id") % 4 == 1, F.lit(""))
    return reports.select(
        F.col("id").alias("query_id"), "embedding", F.col("id").alias("exclude_id"), wanted.alias("product")
    )


def brute(data, k, candidates=lambda q, r: True, filtered=False):
    vectors, products = data
    out = set()
    for q in range(N):
        found = [
            (rounded(vectors[q], vectors[r]), r)
            for r in range(N)
            if r != q and candidates(q, r) and not (filtered and q % 4 == 0 and products[r] != "p")
        ]
        found.sort(key=lambda f: (math.inf if math.isnan(f[0]) else f[0], f[1]))
        out |= {(q, rank + 1, r) for rank, (_, r) in enumerate(found[:k])}
    return out


def ranks(df):
    return {(r.query_id, r["rank"], r.id) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, CELLS], ids=["broadcast", "cells"])
@pytest.mark.parametrize("filters", [(), ("product",)], ids=["all", "filtered"])
def test_join_equals_brute_force(data, reports, queries, limits, filters):
    got = ranks(knn.knn_join(queries, reports, K, filters, **limits))
    assert got == brute(data, K, filtered=bool(filters))


def test_k_beyond_the_table_returns_all_rows(reports, queries):
    assert knn.knn_join(queries, reports, N + 50).count() == N * (N - 1)
    assert knn.knn_join(queries, reports, N + 50, **CELLS).count() == N * (N - 1)


def test_small_cells_send_no_row_more_often(monkeypatch, data, reports, queries):
    sent = []
    ranked = knn.rank_hits
    monkeypatch.setattr(knn, "rank_hits", lambda hits, k: sent.append(hits.count()) or ranked(hits, k))
    got = ranks(knn.knn_join(queries, reports, K, broadcast_queries=0, cell_rows=2))
    assert got == brute(data, K)
    assert sent[0] < N * (N - 1) / 2  # K from each of a few stripes, not all pairs


def test_nearly_equal_distances_are_told_apart(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=DIM) + rng.normal(size=(60, DIM)) * 3e-5  # apart by less than single precision shows
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, embedding array<double>")
    asked = rows.select(F.col("id").alias("query_id"), "embedding", F.col("id").alias("exclude_id"))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    apart = np.rint((1 - units @ units.T) * 1e9)
    expected = {(q, n + 1, r) for q in range(60) for n, r in enumerate(sorted((r for r in range(60) if r != q), key=lambda r: (apart[q, r], r))[:K])}
    for limits in ({}, CELLS):
        assert ranks(knn.knn_join(asked, rows, K, **limits)) == expected


def test_single_vector_equals_join(data, reports):
    got = [r.id for r in knn.nearest(reports, list(data[0][3]), K, DIM).collect()]
    assert [(3, i + 1, r) for i, r in enumerate([g for g in got if g != 3])] == sorted(
        x for x in brute(data, K - 1) if x[0] == 3
    )


def test_top_k_heap_and_pushed_filter(spark, reports):
    path = scratch_dir(spark, "reports")
    reports.write.parquet(path)
    found = search.hybrid_search(spark.read.parquet(path), [1.0] * DIM, {"product": "p"}, 3, allowed=("product",))
    plan = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert "TakeOrderedAndProject" in plan and "EqualTo(product,p)" in plan
    assert {r.product for r in found.collect()} == {"p"}


def test_zero_vectors_come_last(reports, queries):
    last = knn.knn_join(queries.filter("query_id = 1"), reports, N).orderBy(F.desc("rank")).first()
    assert last.id == 90 and math.isnan(last.distance)


def test_no_queries(reports, queries):
    assert knn.knn_join(queries.filter("query_id < 0"), reports, K).count() == 0


def test_arguments(reports):
    with pytest.raises(ValueError):
        knn.nearest(reports, [1.0] * 3, 5, DIM)
    with pytest.raises(ValueError):
        knn.nearest(reports, [1.0] * DIM, 0, DIM)
    with pytest.raises(ValueError):
        search.hybrid_search(reports, [1.0] * DIM, {"nope": 1})
    with pytest.raises(ValueError):
        search.neighbours(reports, reports, 5, "flat")
    for query, k, mode in (("x", 5, "exact"), ("xy", 0, "exact"), ("xy", 101, "exact"), ("xy", 5, "other")):
        with pytest.raises(ValueError):
            search.search_text(reports, query, k, index_type=mode)


# approximate search


@pytest.fixture(scope="module")
def index(reports):
    return ann.train_ivf(reports, lists=6, iterations=2)


def test_all_lists_probed_equals_exact(reports, queries, index):
    exact = ranks(knn.knn_join(queries, reports, K))
    assert ranks(ann.ivf_search(queries, reports, index, K, probes=index.lists)) == exact
    assert ranks(ann.ivf_search(queries, reports, index, K, probes=99, **CELLS)) == exact


@pytest.mark.parametrize("probes", [1, 3])
def test_lists_equal_brute_force_over_probed_lists(data, reports, queries, index, probes):
    vectors = data[0]
    near = index.nearest_lists(vectors, probes)
    own = index.nearest_lists(vectors, 1)[:, 0]
    wanted = brute(data, K, lambda q, r: own[r] in near[q])
    assert ranks(ann.ivf_search(queries, reports, index, K, probes)) == wanted
    assert ranks(ann.ivf_search(queries, reports, index, K, probes, **CELLS)) == wanted


def test_recall_grows_with_probes(reports, queries, index):
    exact = knn.knn_join(queries, reports, 10)
    shares = [
        evaluate.true_recall(evaluate.compare(exact, ann.ivf_search(queries, reports, index, 10, p))).first().true_recall_at_10
        for p in (1, 2, 4, 6)
    ]
    assert shares == sorted(shares) and shares[-1] == 1.0


def test_candidate_counts(data, reports, queries, index):
    own = index.nearest_lists(data[0], 1)[:, 0]
    near = index.nearest_lists(data[0], 2)
    got = {r.query_id: r.candidates for r in ann.candidate_counts(queries, reports, index, 2).collect()}
    assert got == {q: sum(own[r] in near[q] for r in range(N)) for q in range(N)}


def test_stored_lists_are_pruned(spark, reports, queries, index):
    path = scratch_dir(spark, "ivf")
    ann.write_ivf(reports, index, path)
    stored = spark.read.parquet(path)
    few = queries.filter("query_id < 2")
    found = ann.ivf_search(few, stored, index, K, 1)
    assert ranks(found) == {x for x in ranks(ann.ivf_search(queries, reports, index, K, 1)) if x[0] < 2}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [list_id" in plan


@pytest.mark.parametrize("limits", [{}, CELLS], ids=["broadcast", "cells"])
def test_hash_buckets_equal_brute_force(data, reports, queries, limits):
    lsh = ann.LshIndex(DIM, tables=3, bits=4)
    planes = lsh.planes()
    margins = (data[0] @ planes.T).reshape(N, 3, 4)
    bucket = ((margins >= 0) * (1 << np.arange(4))).sum(axis=2)
    flip = np.abs(margins).argmin(axis=2)
    turned = bucket ^ (1 << flip)

    def shares(q, r):
        return bool(((bucket[r] == bucket[q]) | (bucket[r] == turned[q])).any())

    got = ranks(ann.lsh_search(queries, reports, lsh, K, flips=1, **limits))
    assert got == brute(data, K, shares)


def test_complete_hash_search_never_comes_up_short(reports, queries):
    lsh = ann.LshIndex(DIM, tables=1, bits=8)
    plain = ann.lsh_search(queries, reports, lsh, 10, flips=0).count()
    assert plain < N * 10
    assert ann.lsh_search(queries, reports, lsh, 10, flips=0, complete=True).count() == N * 10
    by_name = search.neighbours(queries, reports, 10, "hnsw", lsh, flips=0)
    assert by_name.count() == N * 10


def test_copies_do_not_take_all_seeds(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i < 90 else [float(i), 1.0 + i % 7]) for i in range(100)], "id bigint, embedding array<float>")
    assert ann.train_ivf(rows, lists=3, iterations=1).lists == 3


def test_empty_tables(reports, queries):
    nothing = reports.filter("id < 0")
    assert knn.knn_join(queries, nothing, K).count() == 0
    assert knn.knn_join(queries, nothing, K, **CELLS).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        ann.train_ivf(nothing, 4)


def test_list_count_heuristic():
    assert ann.suggest_lists(10_000) == 100
    assert ann.suggest_lists(50_000_000) == 50_000


def test_pairs(data, reports, index):
    got = {(r.id_a, r.id_b): r.similarity for r in pairs.duplicate_pairs(reports, 3, 0.99).collect()}
    wanted = {}
    for q, _, r in brute(data, 3):
        s = round(1 - rounded(data[0][q], data[0][r]), 5)
        if s >= 0.99:
            wanted[(min(q, r), max(q, r))] = s
    assert got == wanted and all(a < b for a, b in got)
    assert {(r.id_a, r.id_b) for r in pairs.duplicate_pairs(reports, 3, 0.99, index, probes=1).collect()} == set(wanted)


@pytest.mark.parametrize("form", [{}, CELLS, {"keyed": True}, {"keyed": True, **CELLS}])
def test_a_least_cosine_leaves_the_nearest_that_reach_it(queries, reports, form):
    form = dict(form)
    if form.pop("keyed", False):
        queries, reports = (df.withColumn("keys", F.array(F.lit(1).cast("bigint"))) for df in (queries, reports))
    found = knn.knn_join(queries, reports, K, ("product",), least=0.4, **form)
    every = knn.knn_join(queries, reports, K, ("product",), **form)
    near = every.filter(~F.isnan("distance") & (F.col("distance") <= 0.6))
    assert 0 < near.count() < every.count()
    assert ranks(found) == ranks(near)


def test_tiles_of_any_size_find_the_same(monkeypatch, queries, reports):
    found = ranks(knn.knn_join(queries, reports, K, ("product",), least=-0.5))
    block = scoring.QueryBlock.of(queries.toArrow(), ("product",))
    for tall, wide in ((7, 11), (200, 3), (1, 200)):
        monkeypatch.setattr(scoring, "_TALL", tall)
        monkeypatch.setattr(scoring, "_WIDE", wide)
        best = scoring.TopK(len(block.ids), K, -0.5)
        scoring.score(block, scoring.ReportBlock(reports.toArrow(), K, ("product",)), best)
        row, place = np.nonzero(best.units != scoring.EMPTY)
        assert {(int(block.ids[r]), int(p) + 1, int(best.ids[r, p])) for r, p in zip(row, place)} == found


def test_pairs_of_one_key_are_shared_by_many_tasks(monkeypatch, queries, reports):
    monkeypatch.setattr(knn, "LEAST_CELL_ROWS", 8)
    queries, reports = (df.withColumn("keys", F.array(F.lit(1).cast("bigint"))) for df in (queries, reports))
    hits = knn._cell_hits(queries, reports, K, (), knn.CELL_ROWS, None)
    assert hits.select(F.spark_partition_id()).distinct().count() >= queries.sparkSession.sparkContext.defaultParallelism
    assert ranks(knn.rank_hits(hits, K)) == ranks(knn.knn_join(queries.drop("keys"), reports.drop("keys"), K))


def test_large_keys_meet_in_blocks_and_small_ones_in_cells(monkeypatch, queries, reports):
    monkeypatch.setattr(knn, "LEAST_CELL_ROWS", 8)
    monkeypatch.setattr(knn, "KEPT_BYTES", 500)

    few, many = F.floor(F.col("embedding")[0] * 4), 500 + (F.col("embedding")[1] > 0).cast("bigint")
    queries, reports = (df.withColumn("keys", F.array(few.cast("bigint"), many)) for df in (queries, reports))
    hits = knn._cell_hits(queries, reports, K, ("product",), 20, None)
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "sequence(" not in plan  # no row is copied to chunks
    assert ranks(knn.rank_hits(hits, K)) == ranks(knn.knn_join(queries, reports, K, ("product",)))


def test_duplicate_pairs_judge_similarities_as_rounded(spark):
    angles = [0.0, math.acos(0.899996), math.acos(0.89999) + 3.0]
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)]
    made = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    assert [tuple(r) for r in pairs.duplicate_pairs(made, 2, 0.9).collect()] == [(0, 1, 0.9)]
