"""Report and run tables as Parquet folders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofind.operators.validate import run_reason, split
from echofind.schemas import BENCHMARK_RUNS, BUG_REPORTS, DIMENSION

HISTORY_ROWS = 50

# The three seed reports and their constant vectors.
SEED_ROWS = (
    ("Browser crashes when opening preferences", "UNRESOLVED", "Windows", "x86_64", "Preferences", 0.01),
    ("Crash on preferences window after update", "DUPLICATE", "Windows", "x86_64", "Preferences", 0.02),
    ("Images overlap text after resizing browser window", "UNRESOLVED", "Linux", "x86_64", "Layout", 0.03),
)


def create_table(spark: SparkSession, path: str, schema: T.StructType = BUG_REPORTS, replace: bool = False) -> None:
    """An empty table; with ``replace`` an existing one is emptied."""
    if replace or not table_exists(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_table(spark: SparkSession, path: str, schema: T.StructType = BUG_REPORTS) -> DataFrame:
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append(df: DataFrame, path: str, schema: T.StructType = BUG_REPORTS) -> int:
    """Append rows under the table's schema; returns how many were written."""
    seen = Observation()
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return seen.get["rows"]


def last_id(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]


def seed_reports(spark: SparkSession, dim: int = DIMENSION) -> DataFrame:
    schema = "summary string, resolution_status string, operating_system string, architecture string, component string, x double"
    return (
        spark.createDataFrame(SEED_ROWS, schema)
        .withColumn("embedding", F.array_repeat(F.col("x").cast("float"), dim))
        .drop("x")
    )


def append_run(spark: SparkSession, path: str, run: dict, now: datetime | None = None) -> DataFrame:
    """Store one benchmark run; returns its row. A run that breaks a rule fails."""
    run = dict(run, id=last_id(read_table(spark, path, BENCHMARK_RUNS)) + 1, created_at=now or datetime.now())
    row = spark.createDataFrame([tuple(run[f.name] for f in BENCHMARK_RUNS.fields)], BENCHMARK_RUNS)
    accepted, _ = split(row, run_reason(), on_reject="fail")
    append(accepted, path, BENCHMARK_RUNS)
    return accepted


def history(runs: DataFrame, limit: int = HISTORY_ROWS) -> DataFrame:
    """The newest runs first."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
