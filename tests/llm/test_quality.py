import math
import random
import zlib
from itertools import product

import edges
import numpy as np
import pytest

import __spark_entry__ as entry_module
from echofind.llm import line_crf


def test_marginals_equal_enumeration():
    r = np.random.default_rng(5)
    first = np.array([0, 1, 4, 9])
    score, moves = r.normal(size=9), r.normal(size=(2, 2))
    good, joint, whole = line_crf.marginals(score, first, moves)
    wanted, pairs, total = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:]):
        weights = {}
        for states in product((0, 1), repeat=b - a):
            s = sum(score[a + i] for i, y in enumerate(states) if y) + sum(moves[x, y] for x, y in zip(states, states[1:]))
            weights[states] = math.exp(s)
        z = sum(weights.values())
        total += math.log(z)
        for states, w in weights.items():
            for i, y in enumerate(states):
                wanted[a + i] += y * w / z
            for x, y in zip(states, states[1:]):
                pairs[x, y] += w / z
    assert np.allclose(good, wanted) and np.allclose(joint, pairs) and abs(whole - total) < 1e-9


def test_gradient_learns_a_chain():
    r = random.Random(3)
    samples = []
    for k in range(60):
        lines = "\n".join((edges.prose(r.randint(0, 999), 8) if k % 2 else "### $$$ @@ !!") for _ in range(r.randint(1, 6)))
        raw = np.frombuffer(lines.encode(), np.uint8)
        samples.append((line_crf.line_features(raw, np.array([0, len(raw)]))[0], k % 2))
    model = line_crf.fit(samples)
    raw = np.frombuffer(b"$$$ ### !!\n### $$$", np.uint8)
    assert line_crf.score_rows(raw, np.array([0, len(raw)]), model)[0] < 0.1
    raw = np.frombuffer(edges.prose(77, 30).encode(), np.uint8)
    assert line_crf.score_rows(raw, np.array([0, len(raw)]), model)[0] > 0.9


def test_line_features_do_not_depend_on_the_block():
    texts = [edges.prose(k, 30) + "\n\n" + edges.prose(k, 3) for k in range(5)] + ["", "x\nx\nx"]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    bins, length, first = line_crf.line_features(np.frombuffer(raw, np.uint8), offsets)
    for k, t in enumerate(texts):
        own = line_crf.line_features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert (bins[first[k] : first[k + 1]] == own[0]).all() and (length[first[k] : first[k + 1]] == own[1]).all()
    assert length[first[5] : first[6]].tolist() == [0]


def test_edges(spark):
    docs = edges.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, None), (None, 1), (10, 0), (5, 1)], "doc_id long, quality int")
    out = line_crf.score(docs, line_crf.train(docs, labels))
    assert set(out.columns) == set(docs.columns)
    got = out.collect()
    assert len(got) == 14 and all(0 <= r["score"] <= 1 for r in got) and {r["row"] for r in got} == {"mine"}
    assert line_crf.score(edges.empty(spark), line_crf.train(edges.empty(spark), labels)).count() == 0


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    return entry_module.queries()["op8_line_crf"](spark, "/root/testdata/sf0.01").collect()


def test_held_out_accuracy(spark, scored):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    tested = [(r["score"], r["predicted"], label[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in label]
    assert sum(p == y for _, p, y in tested) / len(tested) > 0.97
    good, bad = [s for s, _, y in tested if y], [s for s, _, y in tested if not y]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.98
