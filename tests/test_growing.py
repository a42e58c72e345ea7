"""Lists that grow by loads, against a rebuild with the same centroids and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofind.operators import ann, growing, knn
from echofind.session import scratch_dir

DIM, N, K = 8, 240, 4


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    found = rng.normal(size=(N, DIM)).astype(np.float32)
    found[100:160] = found[100]  # copies
    found[7] = 0
    return found


@pytest.fixture(scope="module")
def reports(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(3).cache()


@pytest.fixture(scope="module")
def index(reports):
    return ann.train_ivf(reports.where("id % 2 = 0"), 6)


@pytest.fixture(scope="module")
def path(spark, reports, index):
    path = scratch_dir(spark, "growing")
    growing.append_ivf(reports.where("id % 2 = 0"), index, path, 0)
    growing.append_ivf(reports.where("id % 4 = 3"), index, path, 1)
    growing.append_ivf(reports.where("id % 2 = 1"), index, path, 1)  # the load once more
    growing.append_ivf(reports.where("id < 0"), index, path, 2)
    return path


def _queries(reports):
    return reports.select(F.col("id").alias("query_id"), "embedding", F.col("id").alias("exclude_id"))


def _rows(hits):
    return {(r.query_id, r["rank"], r.id) for r in hits.collect()}


def test_loads_equal_a_rebuild(spark, reports, index, path):
    whole = scratch_dir(spark, "whole")
    ann.write_ivf(reports, index, whole)
    search = lambda stored: _rows(ann.ivf_search(_queries(reports), stored, index, K, 2))
    assert search(growing.read_ivf(spark, path)) == search(spark.read.parquet(whole))


def test_drift(spark, vectors, index, path):
    got = {(r.load, r.list_id): (r.reports, r.mean_distance) for r in growing.drift(growing.read_ivf(spark, path), index).collect()}
    lists = index.nearest_lists(vectors.astype(np.float64), 1)[:, 0]
    for (load, n), (count, mean) in got.items():
        own = [i for i in range(N) if lists[i] == n and i % 2 == load]
        assert count == len(own)
        unit = [v / np.linalg.norm(v) for v in (vectors[i].astype(float) for i in own if i != 7)]
        centre = index.centroids[n] / np.linalg.norm(index.centroids[n])
        assert mean == pytest.approx(np.mean([1 - u @ centre for u in unit]), abs=1e-8)
    assert sum(count for count, _ in got.values()) == N


def test_merge_without_a_bound_moves_nothing(spark, reports, index, path):
    target = scratch_dir(spark, "merged")
    same = growing.merge_ivf(growing.read_ivf(spark, path), index, target)
    assert same is index
    pairs = lambda p: {(r.id, r.list_id) for r in growing.read_ivf(spark, p).collect()}
    assert pairs(target) == pairs(path)
    assert [r.load for r in growing.read_ivf(spark, target).select("load").distinct().collect()] == [0]


def test_large_lists_are_split(spark, reports, vectors, index, path):
    target = scratch_dir(spark, "split")
    grown = growing.merge_ivf(growing.read_ivf(spark, path), index, target, most_rows=20)
    stored = growing.read_ivf(spark, target)
    assert sorted(r.id for r in stored.select("id").collect()) == list(range(N))
    old = {r.id: r.list_id for r in growing.read_ivf(spark, path).collect()}
    sizes = {n: sum(1 for v in old.values() if v == n) for n in set(old.values())}
    for r in stored.collect():
        if sizes[old[r.id]] <= 20:
            assert r.list_id == old[r.id]
    assert grown.lists > index.lists
    for r in stored.groupBy("list_id").agg(F.count("*").alias("n"), F.countDistinct("embedding").alias("kinds")).collect():
        assert r.n <= 20 or r.kinds <= 2  # copies stay together, with the zero vector at most
    exact = _rows(knn.knn_join(_queries(reports), reports, K))
    assert _rows(ann.ivf_search(_queries(reports), stored, grown, K, grown.lists)) == exact
    # reports to come go to the new lists
    growing.append_ivf(reports, grown, target, 1)
    assert growing.read_ivf(spark, target).count() == 2 * N


def test_bounds(reports, index):
    with pytest.raises(ValueError):
        growing.merge_ivf(reports, index, "/nowhere", most_rows=0)


def test_a_probe_of_every_list_names_no_list(monkeypatch, spark, reports, index, path):
    def named(*_):
        raise AssertionError("queries times lists")

    monkeypatch.setattr(ann.IvfIndex, "probe", named)
    stored, exact = growing.read_ivf(spark, path), _rows(knn.knn_join(_queries(reports), reports, K))
    for limits in ({}, {"broadcast_queries": 0}):
        assert len(exact) == N * K
        got = ann.ivf_search(_queries(reports), stored.where("load = 0").unionByName(stored.where("load > 0")), index, K, index.lists, **limits)
        assert _rows(got) == _rows(knn.knn_join(_queries(reports), stored.select("id", "embedding"), K))
