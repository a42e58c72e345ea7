"""One JSON object per line: seven report fields and the vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofind.schemas import RAW_COLUMNS

SCHEMA = T.StructType(
    [T.StructField("bug_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in RAW_COLUMNS[1:]]
    + [T.StructField("embedding", T.ArrayType(T.DoubleType()))]
)


def write_jsonl(df: DataFrame, path: str) -> str:
    (
        df.select(*RAW_COLUMNS, F.col("embedding").cast("array<double>").alias("embedding"))
        .write.mode("overwrite")
        .option("ignoreNullFields", False)
        .json(path)
    )
    return path


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
