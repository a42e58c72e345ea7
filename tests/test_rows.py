import datetime

import pytest
from pyspark.sql import functions as F

from echofind.operators import evaluate, validate
from echofind.operators.normalize import normalize_reports, service_columns
from echofind.operators.upsert import assign_ids, upsert
from echofind.plans import ingest
from echofind.schemas import RAW_REPORT
from echofind.session import scratch_dir
from echofind.sources import tables

RAW = [
    ("1e3", "<b>s</b>", "d", None, None, None, None),
    (" 7 ", "s", "", " duplicate ", " ", "x86", "Core"),
    ("x", "s", "d", "F", "L", "a", "c"),
    ("12.5", "s", "d", "F", "L", "a", "c"),
    ("9", " ", None, "F", "L", "a", "c"),
    ("10", "", "d", "F", "L", "a", "c"),
    (None, "s", "d", "F", "L", "a", "c"),
]


def test_normalize(spark):
    clean, rejects = normalize_reports(spark.createDataFrame(RAW, RAW_REPORT))
    assert [tuple(r) for r in clean.orderBy("bug_id").collect()] == [
        (7, "s", "", "DUPLICATE", "", "x86", "Core", "s."),
        (10, "", "d", "F", "L", "a", "c", ". d"),
        (1000, "s", "d", "UNRESOLVED", "Unknown", "Unknown", "General", "s. d"),
    ]
    assert {(r.bug_id, r.reason) for r in rejects.collect()} == {
        ("x", "bug_id is not a number"),
        (None, "bug_id is not a number"),
        ("12.5", "bug_id is fractional"),
        ("9", "summary and description are empty"),
    }


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="bug_id, architecture"):
        normalize_reports(spark.createDataFrame([], RAW_REPORT).drop("bug_id", "architecture"))


def test_service_columns(spark):
    rows = spark.createDataFrame(
        [("", "E1", "s", "", "T", ""), ("B2", "E2", None, "C", "T", "FIXED"), ("", "", " ", None, None, None)],
        "bug_id string, external_id string, summary string, component string, component_type string, resolution_status string",
    )
    got = service_columns(rows).select("external_id", "summary", "component", "resolution_status", "description", "architecture")
    assert [tuple(r) for r in got.collect()] == [
        ("E1", "s", "T", "UNRESOLVED", "", None),
        ("B2", "", "C", "FIXED", "", None),
        (None, " ", None, "UNRESOLVED", "", None),
    ]


def test_report_reasons(spark):
    schema = "external_id string, summary string, product string, component string, resolution_status string, operating_system string, architecture string, embedding array<float>"
    good = ["e", " ", None, None, "s", None, None, [1.0, 2.0]]

    def row(**change):
        names = [f.split()[0] for f in schema.split(", ")]
        return tuple(change.get(n, v) for n, v in zip(names, good))

    rows = [row(), row(summary=""), row(summary=None), row(external_id="x" * 129), row(external_id="x" * 128), row(resolution_status="y" * 33),
            row(embedding=[1.0]), row(embedding=None), row(embedding=[1.0, None])]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(validate.report_reason(2)).collect()]
    assert got == [None, "summary is empty", "summary is empty", "external_id is longer than 128", None, "resolution_status is longer than 32",
                   "embedding has not 2 values", "embedding has not 2 values", "embedding holds NULL"]


def test_request_and_run_reasons(spark):
    requests = spark.createDataFrame(
        [("ab", 1, "exact"), ("a", 1, "exact"), ("ab", 0, "hnsw"), ("ab", 101, "hnsw"), ("ab", 100, "flat"), (None, 1, "exact")],
        "query string, k int, index_type string",
    )
    assert [r[0] is None for r in requests.select(validate.request_reason()).collect()] == [True, False, False, False, False, False]
    runs = spark.createDataFrame([("ivfflat", 1), ("ivfflat", 0), ("other", 1)], "index_type string, k int")
    assert [r[0] is None for r in runs.select(validate.run_reason()).collect()] == [True, False, False]
    for arguments in ((1, 10, "exact"), (501, 10, "exact"), (20, 51, "exact"), (20, 10, "none")):
        with pytest.raises(ValueError):
            validate.check_benchmark(*arguments)


@pytest.mark.parametrize("hot_rows", [1, 3, 10**6])
def test_repeats_however_hot_the_key(spark, hot_rows):
    rows = [(i, None if i % 5 == 0 else ("hot" if i % 3 == 0 else f"k{i // 4}")) for i in range(200)]
    seen, wanted = set(), {}
    for position, key in rows:
        wanted[position] = key is not None and key in seen
        seen.add(key)
    df = spark.createDataFrame(rows, "position bigint, key string").repartition(5)
    got = {r.position: r.is_repeat for r in validate.mark_repeats(df, "key", "position", hot_rows).collect()}
    assert got == wanted


def test_latest_per_key(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {tuple(r) for r in validate.latest_per_key(rows, "k", ["t"]).collect()} == {(1, 3, None), (2, 1, "c")}


def test_upsert_moves_updated_at_only_on_change(spark):
    old, now = datetime.datetime(2024, 1, 1), datetime.datetime(2025, 1, 1)
    stored = spark.createDataFrame([(1, "a", old, old), (2, "b", old, old), (3, None, old, old)], "id int, v string, created_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([(1, "a"), (2, None), (4, "d"), (3, None)], "id int, v string")
    got = {tuple(r) for r in upsert(stored, batch, "id", ["v"], F.lit(now)).collect()}
    assert got == {(1, "a", old, old), (2, None, old, now), (3, None, old, old), (4, "d", now, now)}


def test_ids_are_dense_and_in_order(spark):
    rows = spark.range(1000).withColumn("key", F.md5(F.col("id").cast("string"))).drop("id").repartition(7)
    got = [r.id for r in assign_ids(rows, ["key"], last_id=5).orderBy("key").collect()]
    assert got == list(range(6, 1006))


UPLOAD = "position bigint, external_id string, summary string, product string"


def test_load_keeps_good_rows_and_explains_the_rest(spark):
    table = scratch_dir(spark, "reports")
    first = spark.createDataFrame([(0, "a", "one", "p"), (1, "", "two", "p"), (2, "a", "three", "p"), (3, "b", "", "p"), (4, "", "four", "x" * 121)], UPLOAD)
    load = ingest.load_reports(first, table)
    assert load.imported == 2
    assert {(r.summary, r.reason) for r in load.rejects.collect()} == {
        ("three", ingest.NOT_UNIQUE), ("", "summary is empty"), ("four", "product is longer than 120"),
    }
    second = spark.createDataFrame([(0, "c", "five", "p"), (1, "a", "six", "p"), (2, "", "seven", None)], UPLOAD)
    assert ingest.load_reports(second, table).imported == 2
    stored = tables.read_table(spark, table).orderBy("id").collect()
    assert [(r.id, r.external_id, r.summary) for r in stored] == [(1, "a", "one"), (2, None, "two"), (3, "c", "five"), (4, None, "seven")]
    assert all(len(r.embedding) == 384 and r.created_at is not None and r.cleaned_text == r.summary + "." for r in stored)


def test_load_can_fail_whole(spark):
    table = scratch_dir(spark, "reports")
    rows = spark.createDataFrame([(0, "a", "one", "p"), (1, "a", "two", "p")], UPLOAD)
    with pytest.raises(ValueError, match="not unique"):
        ingest.load_reports(rows, table, on_reject="fail")
    assert tables.read_table(spark, table).count() == 0


def test_hit_rate_is_not_recall(spark):
    schema = "query_id bigint, rank int, id bigint"
    truth = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], schema)
    actual = spark.createDataFrame([(0, 1, 9), (0, 2, 3), (0, 3, 2)], schema)
    row = evaluate.compare(truth, actual, (1, 3)).first()
    assert (row.hit_at_1, row.found_at_1, row.hit_at_3) == (0.0, 0.0, 1.0)
    assert abs(row.found_at_3 - 2 / 3) < 1e-12
    nothing = evaluate.compare(truth, actual.filter("rank > 9"), (1,)).first()
    assert nothing.hit_at_1 == 0.0


def test_latency(spark):
    log = spark.createDataFrame([(float(x),) for x in range(1, 21)], "ms double")
    row = evaluate.latency_summary(log, "ms").first()
    assert (row.queries_evaluated, row.average_latency_ms) == (20, 10.5)
    assert abs(row.p95_latency_ms - 19.05) < 1e-9


def test_percentile_equals_sorted_values(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"many": rng.normal(size=150_000), "hot": np.where(rng.random(5_000) < 0.97, 1.0, rng.random(5_000)), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(None, 1.0), (None, 3.0), ("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    groups[None] = np.array([1.0, 3.0])
    for p, accuracy in ((0.0, 100_000), (0.5, 100_000), (0.95, 100_000), (1.0, 100_000), (0.95, 1_000), (0.95, 10**6)):
        got = {r.g: (r["rows"], r.percentile) for r in evaluate.percentile(df, "x", p, "g", accuracy=accuracy).collect()}
        assert set(got) == {*groups, "none"} and got["none"] == (1, None)
        for g, xs in groups.items():
            assert got[g][0] == len(xs) + 2 * (g == "one") and abs(got[g][1] - np.quantile(xs, p)) < 1e-9, (g, p)


def test_sampling_repeats_itself(spark):
    rows = spark.range(100)
    a = [r.id for r in evaluate.sample_reports(rows, 10).collect()]
    assert a == [r.id for r in evaluate.sample_reports(rows.repartition(9), 10).collect()] and len(set(a)) == 10
    assert a != [r.id for r in evaluate.sample_reports(rows, 10, seed="x").collect()]
