"""Files to reports to answers, and benchmark runs."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from echofind.operators import ann
from echofind.plans import benchmark, ingest, search
from echofind.schemas import BENCHMARK_RUNS, BUG_REPORTS
from echofind.session import scratch_dir
from echofind.sources import csv, jsonl, tables


def write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def test_upload_with_bom_crlf_quotes_and_line_breaks(spark, tmp_path):
    data = b'\xef\xbb\xbfbug_id,summary,description,product,component,resolution_status\r\n1,"say ""hi""","two\nlines, here",P,C,\r\n2,plain,,,,NEW\r\n'
    path = write(tmp_path / "up.csv", data)
    rows = csv.read_upload(spark, path).orderBy("bug_id").collect()
    assert [(r.bug_id, r.summary, r.description, r["product"], r.component, r.resolution_status) for r in rows] == [
        ("1", 'say "hi"', "two\nlines, here", "P", "C", None),
        ("2", "plain", None, None, None, "NEW"),
    ]
    with pytest.raises(ValueError):
        csv.read_upload(spark, str(tmp_path / "up.txt"))


def test_import_makes_searchable_reports(spark, tmp_path):
    data = b"external_id,summary,description,product,component_type\nA,Browser crashes,when opening preferences,P,Prefs\nB,Images overlap,after resizing,P,Layout\nC,Preferences window crash,crashes on opening preferences,Q,Prefs\n"
    table = scratch_dir(spark, "reports")
    assert ingest.import_csv(spark, write(tmp_path / "up.CSV", data), table).imported == 3
    reports = tables.read_table(spark, table)
    assert reports.schema.fieldNames() == BUG_REPORTS.fieldNames()
    assert {r[0] for r in reports.select(F.size("embedding")).collect()} == {384}
    found = search.search_text(reports, "crashes opening preferences", k=2).collect()
    assert [r.id for r in found] in ([1, 3], [3, 1]) and found[0].similarity >= found[1].similarity
    assert "embedding" not in found[0].asDict() and "cleaned_text" not in found[0].asDict()
    only = search.search_text(reports, "crashes opening preferences", product="Q", component="").collect()
    assert [(r.id, r["product"]) for r in only] == [(3, "Q")]
    assert [r.id for r in search.search_text(reports, "crashes opening preferences", exclude_id=1).collect()][0] == 3
    assert search.search_text(reports, "crashes opening preferences", exclude_id=0).count() == 3


def test_requests_as_a_table(spark, tmp_path):
    reports = _reports(spark, 30)
    requests = spark.createDataFrame(
        [(1, "word3 word4", 2, None, None, None), (2, "w", 2, None, None, None), (3, "word5", 200, None, None, None), (4, "word6 <b>word7</b>", 7, "p1", "", 0)],
        "query_id bigint, query string, k int, product string, component string, exclude_id bigint",
    )
    results, rejects = search.search(requests, reports)
    got = results.groupBy("query_id").agg(F.count("*"), F.min("rank"), F.collect_set("product")).orderBy("query_id").collect()
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 2, 1), (4, 7, 1)] and got[1][3] == ["p1"]
    assert {(r.query_id, r.reason) for r in rejects.collect()} == {(2, "query is too short"), (3, "k is out of bounds")}


def _reports(spark, n):
    table = scratch_dir(spark, "reports")
    rows = spark.range(n).select(
        F.col("id").alias("position"),
        F.concat(F.lit("word"), F.col("id"), F.lit(" word"), F.col("id") + 1, F.lit(" common")).alias("summary"),
        F.concat(F.lit("p"), F.col("id") % 2).alias("product"),
    )
    ingest.load_reports(rows, table)
    return tables.read_table(spark, table)


def test_pipeline_from_raw_to_jsonl_and_table(spark, tmp_path):
    raw = b'bug_id,summary,description,resolution_status,operating_system,architecture,component_type\n1001,Browser <i>crashes</i>,"at https://x.y/z start\nup",,None,x86_64,NA\nbad,s,d,,,,\n1003,Page,,duplicate,Linux,x86_64,Layout\n'
    clean, out, table = scratch_dir(spark, "clean"), scratch_dir(spark, "jsonl"), scratch_dir(spark, "reports")
    ingest.clean_dataset(spark, write(tmp_path / "raw.csv", raw), clean)
    rows = csv.read_clean(spark, clean).orderBy("bug_id").collect()
    assert [(r.bug_id, r.operating_system, r.component_type, r.resolution_status, r.embedding_text) for r in rows] == [
        (1001, "Unknown", "General", "UNRESOLVED", "Browser crashes. at start up"),
        (1003, "Linux", "Layout", "DUPLICATE", "Page."),
    ]
    ingest.embed_dataset(spark, clean, out, table=table)
    records = jsonl.read_jsonl(spark, out).orderBy("bug_id").collect()
    assert [r.bug_id for r in records] == [1001, 1003] and len(records[0].embedding) == 384
    part = next(f for f in sorted(os.listdir(out)) if f.endswith(".json") and os.path.getsize(f"{out}/{f}"))
    with open(f"{out}/{part}") as f:
        assert f.readline().startswith('{"bug_id":1001,"summary":"Browser crashes","description":"at start up"')
    assert [(r.id, r.component) for r in tables.read_table(spark, table).orderBy("id").collect()] == [(1, "General"), (2, "Layout")]
    with pytest.raises(ValueError, match="embedding_text"):
        csv.read_clean(spark, write(tmp_path / "x.csv", raw))
    with pytest.raises(ValueError, match="summary"):
        csv.read_raw(spark, write(tmp_path / "y.csv", b"bug_id\n1\n"))


def test_single_reports(spark):
    table = scratch_dir(spark, "reports")
    assert ingest.add_report(spark, table, "first", external_id="A", operating_system="Linux") == 1
    assert ingest.add_report(spark, table, "again", external_id="A") is None
    assert ingest.add_report(spark, table, "own vector", [0.5] * 384, component="C") == 2
    stored = {r.id: r for r in tables.read_table(spark, table).collect()}
    assert stored[1].operating_system == "Linux" and stored[2].embedding == [0.5] * 384
    with pytest.raises(ValueError):
        ingest.add_report(spark, table, "bad vector", [0.5])


def test_tables(spark):
    path = scratch_dir(spark, "t")
    assert not tables.table_exists(spark, path)
    tables.create_table(spark, path)
    tables.create_table(spark, path)
    assert tables.read_table(spark, path).count() == 0
    seeds = tables.seed_reports(spark)
    assert seeds.count() == 3 and {r[0] for r in seeds.select(F.size("embedding")).collect()} == {384}


def test_benchmark_writes_one_run(spark):
    reports, runs = _reports(spark, 40), scratch_dir(spark, "runs")
    exact = benchmark.run_benchmark(reports, runs, 5, 3, "exact").first()
    assert (exact.id, exact.queries_evaluated, exact.recall_at_1, exact.recall_at_10) == (1, 5, 1.0, 1.0)
    assert 0 < exact.average_latency_ms and 0 < exact.p95_latency_ms
    index = ann.train_ivf(reports, 4, 1)
    listed = benchmark.run_benchmark(reports, runs, 5, 3, "ivfflat", index, probes=1).first()
    hashed = benchmark.run_benchmark(reports, runs, 5, 3, "hnsw", ann.LshIndex(384)).first()
    assert (listed.id, hashed.id) == (2, 3)
    newest = tables.history(tables.read_table(spark, runs, BENCHMARK_RUNS)).collect()
    assert [r.id for r in newest] == [3, 2, 1]
    with pytest.raises(ValueError):
        benchmark.run_benchmark(reports.limit(1), runs, 2, 3)
    with pytest.raises(ValueError):
        tables.append_run(spark, runs, dict(exact.asDict(), k=0), datetime.datetime(2024, 1, 1))


def test_history_is_at_most_fifty(spark):
    runs = spark.range(80).withColumn("created_at", F.timestamp_seconds(F.col("id") % 70))
    got = [r.id for r in tables.history(runs).collect()]
    assert len(got) == 50 and got[0] == 69 and got.index(79) < got.index(9) if 9 in got else True
