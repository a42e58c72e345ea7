import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofind.plans import ingest
from echofind.session import scratch_dir
from echofind.sources import keys as key_source
from echofind.sources import tables


def _frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def _known(table, values, **options):
    return {r.k for r in table.known(_frame(table.spark, values), **options).collect()}


def _table(spark, buckets=8):
    return key_source.open_keys(spark, scratch_dir(spark, "keys"), buckets)


def test_known_keys_of_several_loads(spark):
    table = _table(spark)
    assert _known(table, ["a"]) == set()
    table.add(_frame(spark, ["a", "b", "b", None, ""]), 0)
    table.add(_frame(spark, ["c" * 5000, "d"]), 1)
    assert _known(table, ["a", "", "x", None, "d", "a"]) == {"a", "", "d"}
    assert _known(table, ["a", "d"], before=1) == {"a"}
    assert _known(table, []) == set() and _known(table, [None]) == set()
    assert table.next_load() == 2
    table.add(_frame(spark, ["e"]), 1)  # the load once more, with other rows
    assert _known(table, ["d", "e", "a"]) == {"a", "e"}
    again = key_source.open_keys(spark, table.path, 999)
    assert again.buckets == 8 and _known(again, ["b"]) == {"b"}


def test_empty_load(spark):
    table = _table(spark)
    table.add(_frame(spark, []), 0)
    table.add(_frame(spark, [None]), 1)
    assert _known(table, ["a", None]) == set()


def test_no_key_is_lost_and_few_are_opened_in_vain(spark):
    table = _table(spark, buckets=4)
    values = [f"key-{i}" for i in range(4000)]
    for load in range(3):
        table.add(_frame(spark, values[load::3]), load)
    assert _known(table, values) == set(values)
    others = [f"other-{i}" for i in range(4000)]
    assert table.candidates(_frame(spark, others)).count() < 3 * 0.05 * len(others)
    assert _known(table, others) == set()


def test_only_buckets_that_may_hold_a_key_are_opened(spark):
    table = _table(spark, buckets=64)
    table.add(_frame(spark, [f"key-{i}" for i in range(2000)]), 0)
    wanted = table.known(_frame(spark, ["key-7", "key-8"]))
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    buckets = [r.bucket for r in table.candidates(_frame(spark, ["key-7", "key-8"])).select("bucket").distinct().collect()]
    assert len(buckets) == 2
    pruned = next(line for line in plan.splitlines() if "PartitionFilters" in line and "/keys" in line)
    assert all(str(b) in pruned.split("PartitionFilters")[1].split("PushedFilters")[0] for b in buckets)
    assert {r.k for r in wanted.collect()} == {"key-7", "key-8"}
    table.add(_frame(spark, ["z"]), 1)
    assert table.candidates(_frame(spark, ["key-7"])).where("load = 1").count() == 0


def test_compact(spark):
    table = _table(spark)
    for load in range(3):
        table.add(_frame(spark, [f"{load}", "same"]), load)
    small = table.compact(scratch_dir(spark, "compact"))
    assert _known(small, ["0", "1", "2", "same", "no"]) == {"0", "1", "2", "same"}
    assert small.stored().count() == 4 and small.next_load() == 0


def test_bits_are_spread(spark):
    for words in (1, 4, 64):
        spots = spark.range(2000).select(F.explode(key_source._spots(F.col("id").cast("string"), F.lit(words))).alias("s"))
        least, most = spots.agg(F.min("s"), F.max("s")).first()
        assert least >= 0 and most < 64 * words
        expected = 64 * words * (1 - math.exp(-2000 * key_source.HASHES / (64 * words)))  # of random bits
        assert abs(spots.distinct().count() - expected) <= 0.03 * expected


def test_sizes():
    assert key_source.filter_words(0, 16) == 1
    assert key_source.filter_words(1 << 20, 1) * 64 >= key_source.BITS_PER_KEY * (1 << 20)
    with pytest.raises(ValueError):
        key_source.create_keys(None, "/nowhere", 0)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.text(max_size=3), max_size=6), max_size=3), st.lists(st.text(max_size=3), max_size=8))
def test_as_a_set(spark, loads, asked):
    table = _table(spark, buckets=3)
    for load, values in enumerate(loads):
        table.add(_frame(spark, values), load)
    assert _known(table, asked) == {v for values in loads for v in values} & set(asked)


def test_load_with_keys_equals_load_without(spark):
    rng = random.Random(1)
    schema = "position bigint, external_id string, summary string"
    uploads = [
        spark.createDataFrame([(i, rng.choice(["a", "b", "c", "d", "", None, "e" * 200]), f"s{i}") for i in range(12)], schema)
        for _ in range(3)
    ]
    plain, keyed = scratch_dir(spark, "plain"), scratch_dir(spark, "keyed")
    table = _table(spark)
    rejects = []
    for upload in uploads:
        a, b = ingest.load_reports(upload, plain), ingest.load_reports(upload, keyed, keys=table)
        assert a.imported == b.imported
        rejects.append([sorted((r.position, r.reason) for r in x.rejects.collect()) for x in (a, b)])
    assert all(x == y for x, y in rejects)
    rows = [sorted((r.id, r.external_id or "", r.summary) for r in tables.read_table(spark, t).collect()) for t in (plain, keyed)]
    assert rows[0] == rows[1]
    rebuilt = ingest.key_reports(spark, keyed, scratch_dir(spark, "rebuilt"), buckets=4)
    assert _known(rebuilt, ["a", "b", "c", "d", "z"]) == _known(table, ["a", "b", "c", "d", "z"])
