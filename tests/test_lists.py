"""Two-level lists, filtered probing and the neighbour graph, against brute force."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofind.catalog import queries as catalog
from echofind.operators import ann, evaluate, filtered, graph, knn, tree
from echofind.plans import search
from echofind.session import scratch_dir

DIM, N, K = 8, 360, 5


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    centres = np.concatenate([np.eye(DIM)[:6] * 4, -np.eye(DIM)[:2] * 4])
    found = (centres[np.arange(N) % 8] + rng.normal(size=(N, DIM)) * 0.4).astype(np.float32)
    found[100:150] = found[100]  # copies
    found[7] = 0
    return found.astype(np.float64)


@pytest.fixture(scope="module")
def reports(spark, vectors):
    rows = [(i, [float(x) for x in v], [None, "p", "q", "rare"][3 if i % 90 == 1 else i % 3]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>, product string").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(reports):
    wanted = F.when(F.col("id") % 4 == 0, F.lit("p")).when(F.col("id") % 4 == 1, F.lit("")).when(F.col("id") % 4 == 2, F.lit("rare"))
    return reports.select(F.col("id").alias("query_id"), "embedding", F.col("id").alias("exclude_id"), wanted.alias("product"))


def rows(df):
    return {(r.query_id, r["rank"], r.id) for r in df.collect()}


@pytest.fixture(scope="module")
def stored(spark, reports):
    index, path = ann.train_ivf(reports, lists=8, iterations=2), scratch_dir(spark, "filtered")
    filtered.write_filtered(reports, index, path, ("product",))
    return index, spark.read.parquet(path), filtered.read_counts(spark, path)


@pytest.mark.parametrize("probes", [1, 3])
@pytest.mark.parametrize("filters", [(), ("product",)], ids=["all", "filtered"])
def test_filtered_probing_equals_exact(reports, queries, stored, probes, filters):
    index, table, counts = stored
    if not filters:
        counts = filtered.list_counts(table, index, ())
    found = filtered.filtered_search(queries, table, index, counts, K, probes, filters)
    assert rows(found) == rows(knn.knn_join(queries, reports, K, filters))


def test_filtered_probing_fills_k_from_few_lists(reports, queries, stored, monkeypatch):
    index, table, counts = stored
    wide = []
    whole = knn.knn_join

    def spied(asking, *args, **options):
        wide.extend(r.n for r in asking.where("query_id <> 7").select(F.size("keys").alias("n")).collect())
        return whole(asking, *args, **options)

    monkeypatch.setattr(filtered.knn, "knn_join", spied)
    found = filtered.filtered_search(queries, table, index, counts, 4, 1, ("product",), bounded=False)
    exact = whole(queries, reports, 4, ("product",))
    assert {x[:2] for x in rows(found)} == {x[:2] for x in rows(exact)}  # as many as there are
    assert np.median(wide) <= 2  # clusters lie apart: most queries read one list or two
    plain = ann.ivf_search(queries, table, index, 4, 1, ("product",))
    assert plain.count() < found.count()  # fixed probing comes up short


def test_counts(stored, reports):
    index, table, counts = stored
    by_list = {(r.list_id, r.product_key): r["rows"] for r in counts.collect()}
    assert sum(n for (_, key), n in by_list.items() if key == "*") == N
    assert sum(n for (_, key), n in by_list.items() if key == "=rare") == 4
    assert {key for _, key in by_list} == {"*", "=p", "=q", "=rare"}  # NULL matches no filter


def test_hybrid_search_with_counts(reports, stored, vectors):
    index, table, counts = stored
    options = {"filters": {"product": "rare"}, "k": 3, "allowed": ("product",), "dim": DIM}
    exact = search.hybrid_search(reports, vectors[3].tolist(), **options)
    found = search.hybrid_search(table, vectors[3].tolist(), index_type="ivfflat", index=index, counts=counts, probes=1, **options)
    assert [r.id for r in found.collect()] == [r.id for r in exact.collect()]


def test_pruned_join_equals_exact_and_visits_little(reports, queries, monkeypatch):
    asked = queries.where("query_id <> 7").drop("product")
    exact = rows(knn.knn_join(asked, reports, K))
    visited = []
    whole = knn.knn_join

    def spied(asking, table, *args, **options):
        met = asking.select("query_id", F.explode("keys").alias("list_id")).join(table.select("list_id"), "list_id")
        visited.append(met.count())
        return whole(asking, table, *args, **options)

    monkeypatch.setattr(filtered.knn, "knn_join", spied)
    for limits in ({}, {"broadcast_queries": 0, "cell_rows": 50}):
        visited.clear()
        assert rows(filtered.pruned_join(asked, reports, K, lists=24, **limits)) == exact
        assert sum(visited) < 0.3 * N * N


# two levels


@pytest.fixture(scope="module")
def levels(reports):
    return tree.train_tree(reports, lists=4, width=6)


def test_tree_equals_brute_force(spark, vectors, reports, queries, levels, monkeypatch):
    leaves = sorted(tuple(r) for r in levels.leaves.select("list_id", "leaf", "centroid").collect())
    centroids = np.array([c for _, _, c in leaves])
    near = levels.top.nearest_lists(vectors, 2)
    apart = ann.distance_units(ann.unit_rows(vectors), ann.unit_rows(centroids))

    def nearest(i, lists, n):
        own = [j for j, (list_id, _, _) in enumerate(leaves) if list_id in lists]
        return [leaves[j][1] for j in sorted(own, key=lambda j: (apart[i, j], leaves[j][1]))[:n]]

    at = [nearest(i, near[i][:1], 1)[0] for i in range(N)]
    probed = [set(nearest(i, near[i], 3)) for i in range(N)]
    for cell_rows in (50_000, 20):  # the second cuts large lists
        monkeypatch.setattr(knn, "CELL_ROWS", cell_rows)
        assert {r.id: r.leaf for r in tree.assign(reports, levels).collect()} == dict(enumerate(at))
        path = scratch_dir(spark, "tree")
        tree.write_tree(reports, levels, path)
        found = tree.tree_search(queries, spark.read.parquet(path), levels, K, lists=2, probes=3)
        exact = knn.knn_join(queries.where("query_id < 40"), reports, N).orderBy("query_id", "rank").collect()
        wanted = {q: [r.id for r in exact if r.query_id == q and at[r.id] in probed[q]][:K] for q in range(40)}
        got = found.where("query_id < 40").orderBy("query_id", "rank").collect()
        assert {q: [r.id for r in got if r.query_id == q] for q in range(40)} == wanted
    assert rows(tree.tree_search(queries, tree.assign(reports, levels), levels, K, lists=4, probes=99)) == rows(knn.knn_join(queries, reports, K))


def test_tree_reaches_beyond_a_broadcast(reports, queries, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BYTES", 8 * DIM * 20)  # 20 centroids
    with pytest.raises(ValueError), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ann.train_ivf(reports, lists=100)
    levels = tree.train_tree(reports, lists=10, width=10)
    assert levels.leaves.count() > 60
    exact = knn.knn_join(queries, reports, K)
    shares = []
    for probes in (2, 8, 30):
        found = tree.tree_search(queries, tree.assign(reports, levels), levels, K, lists=4, probes=probes)
        shares.append(evaluate.true_recall(evaluate.compare(exact, found, (5,)), (5,)).first().true_recall_at_5)
    assert shares == sorted(shares) and shares[-1] > 0.9


def test_rows_that_training_did_not_see(spark, reports, queries, levels):
    some = tree.IvfTree(levels.top, levels.leaves.where("list_id > 0"), levels.width)
    placed = tree.assign(reports, some)
    assert placed.count() == N and placed.where("list_id = 0 AND leaf <> 0").count() == 0
    assert rows(tree.tree_search(queries, placed, some, K, lists=4, probes=99)) == rows(knn.knn_join(queries, reports, K))
    assert tree.tree_search(queries, placed, some, K, lists=4, probes=99).count() == N * K


def test_a_sample_trains_every_list(reports, monkeypatch):
    monkeypatch.setattr(tree, "SAMPLE", 4)
    levels = tree.train_tree(reports, lists=4, width=6)
    assert levels.leaves.groupBy("list_id").count().count() == 4
    assert tree.assign(reports, levels).count() == N


# graph


@pytest.fixture(scope="module")
def walks(spark, reports):
    path = scratch_dir(spark, "graph")
    graph.write_graph(graph.build_graph(reports, degree=10, rounds=4), path)
    return graph.read_graph(spark, path)


def test_graph_is_bounded_and_near(reports, walks):
    degrees = {r.v: r["count"] for r in walks.edges.groupBy("v").count().collect()}
    assert max(degrees.values()) <= 28 and len(degrees) == N - 49 - 1  # copies are one node, the zero vector is none
    apart = reports.where("id <> 7 AND (id <= 100 OR id >= 150)")
    truth = knn.knn_join(apart.select(F.col("id").alias("query_id"), "embedding", F.col("id").alias("exclude_id")), apart, 3)
    met = truth.join(walks.edges.select(F.col("v").alias("query_id"), F.col("u").alias("id")), ["query_id", "id"])
    assert met.count() > 0.85 * truth.count()


def test_graph_search_finds_more_with_a_larger_dial(reports, queries, walks):
    asked = queries.where("query_id <> 7")
    exact = knn.knn_join(asked, reports, K)
    shares = []
    for ef in (5, 20, 80):
        found = graph.graph_search(asked, walks, K, ef)
        shares.append(evaluate.true_recall(evaluate.compare(exact, found, (5,)), (5,)).first().true_recall_at_5)
    assert shares == sorted(shares) and shares[-1] > 0.97
    of_copies = graph.graph_search(asked.where("query_id = 120"), walks, K).collect()
    assert [r.id for r in of_copies] == [100, 101, 102, 103, 104] and {r.distance for r in of_copies} == {0.0}


def test_graph_answers_its_index_type(reports, queries, walks):
    found = search.neighbours(queries, reports, K, "hnsw", walks, ("product",), ef=60)
    exact = rows(knn.knn_join(queries, reports, K, ("product",)))
    got = rows(found)
    assert {x[:2] for x in got} == {x[:2] for x in exact}  # k rows where k exist
    assert len(got & exact) > 0.9 * len(exact)
    with pytest.raises(ValueError):
        graph.graph_search(queries, walks, 5, ef=3)


def test_graph_of_nothing(spark):
    nothing = graph.build_graph(spark.createDataFrame([(1, [0.0, 0.0])], "id bigint, embedding array<float>"), 4, 1)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert graph.graph_search(asked, nothing, 3).count() == 0


def plain_walk(index, vector, k, ef, rounds, exclude):
    """The walk with sets and lists: ids of the best k."""
    nodes, edges, members = index
    unit = vector / np.linalg.norm(vector)
    units = {n: int(np.rint(np.clip(1 - unit @ v / np.linalg.norm(v), 0, 2) * 1e9)) for n, (_, v) in nodes.items()}
    met, opened = {n for n, (place, _) in nodes.items() if place < graph.ENTRIES}, set()
    for _ in range(rounds):
        fresh = [n for n in sorted(met, key=lambda n: (units[n], n))[:ef] if n not in opened]
        opened.update(fresh)
        met.update(u for n in fresh for u in edges[n])
    best = sorted(met, key=lambda n: (units[n], n))[: k + 1]
    return [i for _, i in sorted((units[n], i) for n in best for i in members[n] if i != exclude)[:k]]


@pytest.mark.parametrize("ef, stripe, pairs", [(5, None, None), (12, 2000, 50)])
def test_walk_equals_plain_walk_and_keeps_the_best_only(monkeypatch, vectors, queries, walks, ef, stripe, pairs):
    if stripe:
        monkeypatch.setattr(graph, "STRIPE_BYTES", stripe)
        monkeypatch.setattr(graph, "QUERIES", 7)
        monkeypatch.setattr(graph, "PAIRS", pairs)
    kept, write = [], graph.materialize

    def spied(df, name):
        table = write(df, name)
        if name == "walk":
            kept.append(table.groupBy("query_id").count().agg(F.max("count")).first()[0])
        return table

    monkeypatch.setattr(graph, "materialize", spied)
    asked = queries.where("query_id <> 7 AND query_id % 5 = 0").drop("product")
    found = {}
    for r in graph.graph_search(asked, walks, K, ef, rounds=3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert len(kept) == 3 and max(kept) <= max(ef, K + 1)  # not all that a walk has met
    nodes = {r.node: (r.place, np.array(r.embedding, float)) for r in walks.nodes.collect()}
    edges, members = {n: [] for n in nodes}, {n: [] for n in nodes}
    for r in walks.edges.collect():
        edges[r.v].append(r.u)
    for r in walks.members.collect():
        members[r.node].append(r.id)
    for query in found:
        assert found[query] == plain_walk((nodes, edges, members), vectors[query], K, ef, 3, query)
    assert len(found) == asked.count()


def test_registered_walk_goes_on_to_its_end(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=64).astype(np.float32) for i in range(1500)}
    made = [(i, v.tolist(), i % 10) for i, v in vectors.items()]
    spark.createDataFrame(made, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in catalog.graph_search(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    reports = spark.read.parquet(f"{tmp_path}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    built = graph.build_graph(reports, catalog.DEGREE, rounds=2)
    nodes = {r.node: (r.place, np.array(r.embedding, float)) for r in built.nodes.collect()}
    edges = {n: [] for n in nodes}
    for r in built.edges.collect():
        edges[r.v].append(r.u)
    members, walked = {n: [n] for n in nodes}, 0
    for query in range(0, 1500, 30):
        asked = (nodes, edges, members), vectors[query].astype(float), 10, graph.EF
        whole = plain_walk(*asked, 60, query)
        assert found[query] == whole
        walked += whole != plain_walk(*asked, 4, query)
    assert walked and len(found) == 1500  # four rounds are not enough
