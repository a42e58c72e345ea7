import random

import numpy as np
import pyarrow as pa
import pytest

from echofind.llm import near_vectors
from echofind.llm.near_vectors import calibrate


def test_calibration_reaches_the_recall():
    window, need = calibrate(0.93, 48, 0.999999)
    r = np.random.default_rng(2)
    gaps = r.normal(size=(20_000, 48)) * np.sqrt(2 - 2 * 0.93)
    assert ((np.abs(gaps) <= window).sum(1) >= need).all()
    assert need > 36  # far pairs collide half the time, 24 of 48


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 40)  # many blocks per label
    r = np.random.default_rng(4)
    centres = r.normal(size=(25, 16))
    vectors = [centres[k % 25] + r.normal(size=16) * 0.07 * (k % 5) for k in range(200)]
    vectors += [vectors[3]] * 30 + [vectors[0] * 2, vectors[0] * -1, vectors[1] * 1e300, vectors[2] * 1e-300]
    labels = [k % 3 for k in range(len(vectors))]
    rows = [(k, [float(x) for x in v], labels[k]) for k, v in enumerate(vectors)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {x["vec_id"]: x for x in near_vectors.near_duplicates(df).collect()}
    unit = np.array([v / np.abs(v).max() for v in vectors])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(len(vectors))
    for _ in range(len(vectors)):
        root = np.minimum(root, np.where(linked, root[None, :], 10**6).min(1))
    assert linked.sum() > 500
    for k in range(len(vectors)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (linked[k].sum(), root[k], root[k] == k)


def test_edges(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 0), (1, v, 0), (2, v, None), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0)]
    rows += [(7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [1.0, 2.0, 3.0], 0), (None, v, 0), (10, v, 1), (11, [2.0, 4.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS vector")
    got = sorted((tuple(r) for r in near_vectors.near_duplicates(df).collect()), key=str)
    alone = [(k, 0, k, True) for k in range(2, 11)]
    wanted = [(1, 3, 1, True), (1, 3, 1, True), (11, 3, 1, False), (None, 3, 1, False), *alone]
    assert got == sorted(wanted, key=str)
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [1, 50, 1 << 17])
@pytest.mark.parametrize("same", [True, False])
def test_a_block_compares_pairs_across_its_chunks_only(monkeypatch, same, tile):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    r = np.random.default_rng(8)
    x = np.repeat(r.normal(size=(6, 12)), 10, axis=0) + r.normal(size=(60, 12)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    chunk = np.zeros(60, int) if same else np.arange(60) % 2
    rows = pa.record_batch([pa.array([v.tobytes() for v in x]), pa.array(chunk), pa.array([same] * 60)], ["vector", "chunk", "same"])
    wanted = x @ x.T >= 0.93
    wanted &= ~np.eye(60, dtype=bool) if same else chunk[:, None] != chunk[None, :]
    linked = near_vectors.collision_links(rows, 0.93, 48, 0.999999)
    assert wanted.sum() > 100 and (linked == wanted).all()
