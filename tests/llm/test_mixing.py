import edges
import pytest

from echofind.llm import mixing


def level(sizes, weights, share, repeats):
    """Targets by pouring in rounds: whoever is above its limit stays there, the rest share again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = share * sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        target = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if target[s] > repeats * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: repeats * sizes[s] for s in over}


def test_targets_equal_rounds_of_sharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "ä": 90, "Z": 70, None: 3, "0": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 1.5, 2).collect()}
    assert got == pytest.approx(level(sizes, (5, 2, 1), 1.5, 2))


def test_words_taken_come_near_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 16)  # many slices per source
    rows = [(i, edges.prose(i, 3 + i % 17), f"s{i % 2 if i % 3 else i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    plain = lambda rs: sorted((r["row"]["doc_id"], r["taken"]) for r in rs)
    assert plain(got) == plain(again)
    taken, target = {}, {}
    for r in got:
        assert r["size"] == len(r["row"]["text"].split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["row"]["source"]] = taken.get(r["row"]["source"], 0) + r["taken"]
        target[r["row"]["source"]] = r["target"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= 20, s
    assert 0 <= 1.5 * sum(r["size"] for r in got) - sum(taken.values()) < 20


def test_edges(spark):
    docs = edges.documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == 14 and set(got[0]["row"].asDict()) == set(docs.columns)
    assert all(r["taken"] == 0 for r in got if not (r["row"]["text"] or "").strip())
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(edges.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(nothing).collect()] == [0, 0]
