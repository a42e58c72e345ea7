"""Loads and states that once went wrong without an error."""

import datetime

import pytest

from echofind.functions.embed import HashEmbedder, embed
from echofind.operators import ann, evaluate, knn
from echofind.plans import ingest, search
from echofind.schemas import BUG_REPORTS
from echofind.sources import csv, tables
from echofind.streaming import ingest as streaming
from pyspark.sql import functions as F


def test_rows_are_told_apart_by_more_than_their_position(spark, tmp_path):
    rows = [(0, "a"), (1, "b"), (0, "c"), (1, "b"), (2, "b"), (2, "z")]
    upload = spark.createDataFrame([(p, e, "some text") for p, e in rows], "position long, external_id string, summary string")
    accepted, rejects = ingest.accept_reports(upload, tables.read_table(spark, str(tmp_path / "none")))
    assert sorted(r.external_id for r in accepted.collect()) == ["a", "b", "c", "z"]
    assert [r.external_id for r in rejects.collect()] == ["b", "b"]


def test_vectors_of_a_wrong_length_are_rejected(spark, tmp_path):
    upload = spark.createDataFrame([("x", [1.0]), ("y", [1.0, 2.0, 3.0])], "summary string, embedding array<float>")
    load = ingest.load_reports(upload, str(tmp_path / "t"), HashEmbedder(3))
    assert load.imported == 1 and load.rejects.first().reason == "embedding has not 3 values"

    class Wrong(HashEmbedder):
        def encode(self, texts):
            return super().encode(texts)[:, :-1]

    with pytest.raises(Exception, match="have not 8 values"):
        spark.range(2).select(embed(F.lit("text"), Wrong(8))).collect()


def test_one_report_with_its_time_and_no_unknown_field(spark, tmp_path):
    table = str(tmp_path / "t")
    when = datetime.datetime(2024, 5, 6, 7, 8)
    assert ingest.add_report(spark, table, "crash", product="p", reported_at=when) == 1
    assert tables.read_table(spark, table).first().reported_at == when
    with pytest.raises(ValueError, match="prodct"):
        ingest.add_report(spark, table, "crash", prodct="p")


def test_default_filters_over_the_stored_table(spark, tmp_path):
    table = str(tmp_path / "t")
    for n, component in enumerate(["General", "Layout", "General"]):
        ingest.add_report(spark, table, f"crash {n}", component=component, embedding=[1.0, float(n)], embedder=HashEmbedder(2))
    reports = tables.read_table(spark, table)
    found = search.hybrid_search(reports, [1.0, 2.0], {"component_type": "General"}, 5)
    assert [r.id for r in found.collect()] == [3, 1]
    index = ann.train_ivf(reports, 2)
    for mode, dial in (("ivfflat", index), ("hnsw", ann.LshIndex(2, tables=1, bits=1))):
        found = search.hybrid_search(reports, [1.0, 2.0], {"component_type": "General"}, 5, index_type=mode, index=dial)
        assert [r.id for r in found.collect()] == [3, 1]


def test_each_request_has_its_own_method(spark, tmp_path):
    table = str(tmp_path / "t")
    embedder = HashEmbedder(16)
    upload = spark.createDataFrame([(f"report number {n} about word{n % 5}",) for n in range(30)], "summary string")
    ingest.load_reports(upload, table, embedder)
    reports = tables.read_table(spark, table)
    modes = ["exact", "hnsw", "ivfflat", None, "flat"]
    rows = [(i, "about word3", 4, None, None, None, m) for i, m in enumerate(modes)]
    requests = spark.createDataFrame(rows, "query_id long, query string, k int, product string, component string, exclude_id long, index_type string")
    index = {"hnsw": ann.LshIndex(16, tables=1, bits=1), "ivfflat": ann.train_ivf(reports, 3)}
    results, rejects = search.search(requests, reports, index=index, embedder=embedder, probes=3)
    found = {}
    for r in results.collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.id
    assert set(found) == {0, 1, 2, 3} and found[1] == found[2] == found[3] == found[0] and len(found[0]) == 4
    assert [r.reason for r in rejects.collect()] == ["unknown index_type"]


def test_csv_files_with_other_headers(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("bug_id,product,summary\n1,prodA,first\n", encoding="utf-8")
    (folder / "b.csv").write_text("﻿product,summary,bug_id\nprodB,\"two\nlines\",2\n", encoding="utf-8")
    (folder / "c.csv").write_text("summary\nthird\n", encoding="utf-8")
    got = {(r.bug_id, r.product, r.summary) for r in csv.read_upload(spark, str(folder)).collect()}
    assert got == {("1", "prodA", "first"), ("2", "prodB", "two\nlines"), (None, None, "third")}


def test_late_rows_do_not_replace_later_ones(spark, tmp_path):
    schema = "k string, t int, status string"
    source, table = tmp_path / "in", str(tmp_path / "out")
    for n, rows in enumerate([[("a", 3, "CLOSED")], [("a", 2, "OPEN"), ("b", 1, "NEW")], [("a", 3, "REOPENED"), ("b", 2, "OLD")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        streaming.upsert_stream(stream, table, str(tmp_path / "cp"), "k", ["t", "status"], ["t"]).awaitTermination()
        state = streaming.state_schema(stream, "k", ["t", "status"])
        now = {r.k: (r.t, r.status) for r in streaming.read_latest(spark, table, state, "k", ["t"]).collect()}
        assert now["a"] == ((3, "CLOSED") if n < 2 else (3, "REOPENED"))
    assert now["b"] == (2, "OLD")
    with pytest.raises(ValueError, match="orders"):
        streaming.upsert_stream(stream, table, str(tmp_path / "cp2"), "k", ["status"], ["t"])


def test_a_stream_is_unique_over_batches(spark, tmp_path):
    schema = "position long, external_id string, summary string"
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(0, "a", "one"), (1, "b", "two")], [(0, "c", "three"), (1, "a", "four"), (1, "d", "five")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.ingest_stream(stream, table, str(tmp_path / "cp"), HashEmbedder(4)).awaitTermination()
    got = {r.external_id: r.id for r in streaming.read_batches(spark, table, BUG_REPORTS).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_seeds_are_as_many_as_asked_among_copies(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3000)] + [(5000 + i, [1.0, 1.0 + i]) for i in range(12)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert ann.train_ivf(vectors, 12, iterations=0).lists == 12
    with pytest.warns(UserWarning, match="13 distinct"):
        assert ann.train_ivf(vectors, 40, iterations=0).lists == 13


def test_samples_are_cut_by_a_bound_before_they_are_sorted(spark):
    plan = evaluate.sample_reports(spark.range(100_000), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= " in plan and "md5" in plan


def test_bits_follow_the_rows():
    assert [ann.suggest_bits(n) for n in (1, 4_000, 1_000_000, 10**12)] == [1, 2, 10, 30]


def test_unkeyed_cells_use_all_partitions(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = vectors.selectExpr("id AS query_id", "embedding")
    cells = knn.knn_join(queries, vectors, 3, broadcast_queries=0)
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, knn.knn_join(queries, vectors, 3).collect()))
