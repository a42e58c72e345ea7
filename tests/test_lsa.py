"""The learnt embedder against a dense SVD, and against word hashing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofind.catalog import queries as catalog
from echofind.functions.embed import HashEmbedder, embed
from echofind.operators import lsa

TOPICS = (
    "crash freeze hang abort failure fault",
    "font layout margin image overlap resize",
    "login password account session cookie token",
)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    found = [" ".join(rng.choice(TOPICS[i % 3].split(), 3)) + f" word{rng.integers(40)}" for i in range(120)]
    return [*found, found[0], found[0], "", None]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, cleaned_text string").repartition(3)


def test_equals_a_dense_svd(frame, texts):
    model = lsa.train_lsa(frame, dim=64, features=64)  # as wide as the matrix: nothing is left to chance
    given = [t or "" for t in texts]
    dense = np.zeros((len(given), 64))
    for row, text in enumerate(given):
        for word in set(text.split()):
            slot, sign = HashEmbedder(64)._slot(word)
            dense[row, slot] += sign * np.log1p(text.split().count(word)) * model.weights[slot]
    lengths = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, lengths, out=dense, where=lengths > 0)
    _, values, known = np.linalg.svd(dense, full_matrices=False)
    leading = np.linalg.norm(model.basis[:, :12].T.astype(float) @ known[:8].T, axis=0)
    assert np.allclose(leading, 1, atol=1e-4)
    narrow = lsa.train_lsa(frame, dim=12, features=64)
    caught = (np.linalg.norm(dense @ narrow.basis.astype(float)) ** 2) / (values[:12] ** 2).sum()
    assert 0.95 < caught <= 1 + 1e-6  # of what the best 12 directions catch
    counts = sum(1 for t in given if "crash" in t.split())
    slot = HashEmbedder(64)._slot("crash")[0]
    assert model.weights[slot] <= np.log((1 + len(given)) / (1 + counts)) + 1 + 1e-6


def test_the_same_however_the_texts_lie(frame):
    one = lsa.train_lsa(frame, dim=8, features=256)
    other = lsa.train_lsa(frame.repartition(5, "id"), dim=8, features=256)
    assert np.array_equal(one.basis, other.basis) and np.array_equal(one.weights, other.weights)


def test_words_of_one_topic_lie_together(frame):
    model = lsa.train_lsa(frame, dim=3, features=1024)
    near, far = model.encode(["crash fault", "freeze abort", "margin image"]) @ model.encode(["hang"])[0], 0.5
    assert near[0] > far and near[1] > far and near[2] < 0.3
    plain = HashEmbedder(1024).encode(["crash fault", "hang"])
    assert abs(plain[0] @ plain[1]) < 0.01


def test_vectors(frame, texts):
    model = lsa.train_lsa(frame, dim=16, features=512)
    rows = frame.select("id", embed(F.col("cleaned_text"), model).alias("v")).collect()
    for r in rows:
        assert len(r.v) == 16
        assert np.linalg.norm(r.v) == pytest.approx(1 if texts[r.id] else 0, abs=1e-5)
    assert not model.encode(["unheard-of"] if model.weights[HashEmbedder(512)._slot("unheard")[0]] == 0 else [""]).any()
    assert model.encode([]).shape == (0, 16)


def test_query_equals_brute_force(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs, items = read("documents").toPandas(), read("benchmark").toPandas()
    model = lsa.train_lsa(read("documents"), "text", features=2048)
    cosine = model.encode(list(items.text)).astype(float) @ model.encode(list(docs.text)).astype(float).T
    got = {}
    for r in catalog.text_search_lsa(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance))
    assert set(got) == set(items.item_id)
    for row, item in enumerate(items.item_id):
        wanted = np.sort(1 - cosine[row])[:5]
        assert np.allclose([d for _, d in sorted(got[item])], wanted, atol=2e-5)


def test_a_sample_and_no_texts(spark, frame):
    assert lsa.train_lsa(frame, dim=4, features=64, sample=30).encode(["crash"]).shape == (1, 4)
    empty = lsa.train_lsa(spark.createDataFrame([], "cleaned_text string"), dim=4, features=64)
    assert not empty.encode(["crash", ""]).any()
    with pytest.raises(ValueError):
        lsa.train_lsa(frame, dim=65, features=64)
