import random

import numpy as np
import pyarrow as pa
import pytest

from echofind.operators import blocks, components, groups


def plain_groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("least_hub, name", [(1_000, "whole"), (2, "split")])
def test_components(spark, monkeypatch, least_hub, name):
    monkeypatch.setattr(components, "LEAST_HUB", least_hub)
    r = random.Random(2)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1130)]  # a hub and a chain
    edges += [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(350)] + [(7, 7), (5, 0), (0, 5), (1130, 900)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.root for r in components.components(table).collect()} == plain_groups(nodes, edges)
    assert components.components(table.where("a < 0")).count() == 0


def brute(rows, least):
    vectors = {i: np.array(v, float) for i, v in rows if v is not None and np.any(v)}
    ids = sorted(vectors)
    unit = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    linked = np.round(1 - unit @ unit.T, 9) <= round(1 - least, 9)
    np.fill_diagonal(linked, False)
    edges = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked))]
    count = dict(zip(ids, linked.sum(1).tolist()))
    root = plain_groups([i for i, _ in rows], edges)
    return {i: (root[i], count.get(i, 0)) for i, _ in rows}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    vectors = [centres[i % 12] + 0.25 * rng.normal(size=6) for i in range(240)]
    vectors += [centres[0]] * 80 + [2 * centres[0]] * 3  # copies, and copies of another length
    vectors += [np.zeros(6), None, -centres[1], None]
    return [(7 * i % 1009, None if v is None else [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("least, pivots, chunk", [(0.9, None, 1024), (0.97, 20, 7), (0.5, 5, 16), (1.0, 3, 4), (0.9, 1, 1024)])
def test_groups_equal_brute_force(spark, monkeypatch, rows, least, pivots, chunk):
    monkeypatch.setattr(groups, "CHUNK", chunk)
    table = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(3)
    found = {r.id: (r.group_id, r.links) for r in groups.duplicate_groups(table, least, pivots).collect()}
    wanted = brute(rows, least)
    assert found == wanted
    assert max(links for _, links in found.values()) >= 79  # none lost to a k


def test_far_cells_are_not_visited(spark):
    rng = np.random.default_rng(8)
    centres = np.eye(8)[:6]
    vectors = [(i, (centres[i % 6] + 0.02 * rng.normal(size=8)).tolist()) for i in range(300)]
    table = spark.createDataFrame(vectors, "node bigint, embedding array<float>")
    index = groups.ann.IvfIndex(centres)
    visits = groups._visits(groups._placed(table, index), index, float(np.arccos(0.95)))
    assert visits.count() == 300  # each stays at home: nothing is copied to another cell


def test_arguments_and_empty_tables(spark):
    nothing = spark.createDataFrame([], "id bigint, embedding array<float>")
    assert groups.duplicate_groups(nothing).count() == 0
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "id bigint, embedding array<float>")
    assert sorted(map(tuple, groups.duplicate_groups(zeros).collect())) == [(1, 1, 0), (2, 2, 0)]
    with pytest.raises(ValueError):
        groups.duplicate_groups(zeros, 0)


@pytest.mark.parametrize("least, tile, pairs, kind", [(0.9, 1024, 1 << 14, "float"), (0.5, 16, 5, "double"), (0.97, 7, 3, "float"), (1.0, 32, 8, "double")])
def test_stripes_equal_brute_force(spark, monkeypatch, rows, least, tile, pairs, kind):
    monkeypatch.setattr(groups, "TILE", tile)
    monkeypatch.setattr(groups, "PAIRS", pairs)
    monkeypatch.setattr(groups, "_few_copies", lambda *_: False)
    table = spark.createDataFrame(rows, f"id bigint, embedding array<{kind}>").repartition(3)
    found = {r.id: (r.group_id, r.links) for r in groups.duplicate_groups(table, least).collect()}
    assert found == brute(rows, least)


def test_a_vector_is_sent_once_per_stripe_at_most(spark):
    """Vectors without clusters: the triangle inequality rules out nothing."""
    rng = np.random.default_rng(4)
    vectors = [(i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 16)))]
    members = spark.createDataFrame(vectors, "node bigint, copies bigint, embedding array<double>")
    index = groups.ann.train_ivf(members.select(members.node.alias("id"), "embedding"), 60, iterations=1)
    placed, limit = groups._placed(members, index), float(np.arccos(0.5))
    stripes = groups._stripes(members, 600, 16)
    assert groups._dealt(groups._visits(placed, index, limit)).count() > 600 * stripes
    assert not groups._few_copies(placed, index, limit, 600 * stripes)
    dealt = groups._dealt(groups._visits(placed, index, 0.0))
    assert groups._few_copies(placed, index, 0.0, dealt.count())
    assert not groups._few_copies(placed, index, 0.0, dealt.count() - 1)


@pytest.mark.parametrize("key, held", [(None, 1 << 20), ("key", 1 << 20), ("key", 500)])
def test_every_two_blocks_meet_and_a_row_is_in_one(spark, monkeypatch, key, held):
    monkeypatch.setattr(blocks, "HELD_BYTES", held)
    monkeypatch.setattr(blocks, "PART_BYTES", 4_000)
    rows = [(i, i * i % 4, [float(i)] * 5) for i in range(150)]
    table = spark.createDataFrame(rows, "id bigint, key bigint, embedding array<float>").repartition(3)
    stored = blocks.packed(table, 9, key)
    packed = {r.block: (r.key, pa.ipc.open_stream(bytes(r.data)).read_all().to_pylist()) for r in stored.collect()}
    assert sorted((r["id"], r["key"], r["embedding"]) for _, part in packed.values() for r in part) == rows
    assert all(len(part) <= 9 and (key is None or {r["key"] for r in part} == {k}) for k, part in packed.values())

    def pairs(batches):
        for a, a_key, mine, others in blocks.met(batches):
            firsts = [blocks.unpack(data)["id"][0].as_py() for _, _, data in others]
            columns = [[a] * len(others), [a_key] * len(others), [blocks.unpack(mine)["id"][0].as_py()] * len(others)]
            columns = [*columns, [b for b, _, _ in others], [k for _, k, _ in others], firsts]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "j", "x", "b", "k", "y"])

    made = blocks.meetings(stored, stored, 3).mapInArrow(pairs, "a bigint, j bigint, x bigint, b bigint, k bigint, y bigint")
    wanted = {b: (b, k, part[0]["id"]) for b, (k, part) in packed.items()}
    assert sorted(map(tuple, made.collect())) == sorted(wanted[a] + wanted[b] for a in packed for b in packed)


def test_meetings_copy_no_vector_and_fold_what_they_find(spark, monkeypatch, rows):
    monkeypatch.setattr(groups, "FOUND", 10)
    monkeypatch.setattr(groups, "_few_copies", lambda *_: False)
    seen, striped = [], groups._striped_links

    def spied(*args):
        links = striped(*args)
        seen.append(links._jdf.queryExecution().toString())
        return links

    monkeypatch.setattr(groups, "_striped_links", spied)
    table = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(3)
    assert {r.id: (r.group_id, r.links) for r in groups.duplicate_groups(table, 0.9).collect()} == brute(rows, 0.9)
    assert "Generate" not in seen[0] and "CartesianProduct" in seen[0]  # vectors were exploded to all stripes
