import os
import subprocess
import sys
import tempfile

from echofind.session import broadcast_if_small, materialize, scratch_dir, scratch_scope
from echofind.sources.tables import table_exists


def test_scratch_lives_under_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert spark.sparkContext.applicationId in path and (base is None or path.startswith(f"{base}/echofind/"))
    assert scratch_dir(spark, "x") != path
    assert materialize(spark.range(3), "x").count() == 3


def test_scratch_can_be_cleared():
    """In an application of its own, as it deletes what the application wrote."""
    program = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from echofind.session import *\n"
        "from echofind.sources.tables import table_exists\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')"
        ".config('spark.checkpoint.dir', sys.argv[2]).getOrCreate()\n"
        "path = scratch_dir(spark, 'x'); spark.range(3).write.parquet(path)\n"
        "assert path.startswith(sys.argv[2]) and table_exists(spark, path)\n"
        "clear_scratch(spark); assert not table_exists(spark, path)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        subprocess.run([sys.executable, "-c", program, root, folder], check=True, timeout=120, capture_output=True)


def test_a_scope_deletes_what_was_written_inside(spark):
    before = scratch_dir(spark, "x")
    spark.range(2).write.parquet(before)
    with scratch_scope(spark):
        inside = scratch_dir(spark, "x")
        spark.range(2).write.parquet(inside)
    assert table_exists(spark, before) and not table_exists(spark, inside)


def test_broadcast_only_below_the_bound(spark):
    big, small = spark.range(100), spark.range(10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lambda df: big.join(df, "id")._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan(broadcast_if_small(small, 10))
        assert "BroadcastHashJoin" not in plan(broadcast_if_small(small, 9))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
