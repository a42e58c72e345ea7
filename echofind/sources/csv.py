"""CSV in and out. All columns are read as strings by header name.

Files are split over tasks (see :mod:`records`); those with one header are parsed
alike, and columns of different files meet by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofind.functions.text import na_to_null
from echofind.operators.validate import require_columns
from echofind.schemas import RAW_COLUMNS, UPLOAD_COLUMNS
from echofind.sources.records import read_records

_OPTIONS = {"multiLine": "true", "quote": '"', "escape": '"'}


def _read(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """All files of a path; ``position`` names a column for the place of each row in them."""
    rows, layouts = read_records(spark, path)
    places: dict[str, list] = {}
    for i, names in enumerate(layouts):
        schema = ", ".join(f"c{j} string" for j in range(len(names)))
        parsed = F.from_csv("record", schema, _OPTIONS)
        rows = rows.withColumn(f"p{i}", F.when(F.col("layout") == i, parsed) if len(layouts) > 1 else parsed)
        for j, name in enumerate(names):
            places.setdefault(name, []).append(F.col(f"p{i}.c{j}"))
    columns = [F.coalesce(*found).alias(name) for name, found in places.items()]
    return rows.select(*columns, *([F.col("position").alias(position)] if position else []))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded report file; known columns it lacks are NULL.

    ``position`` is the place of a row by file and line, which orders ids and repeats.
    """
    if not path.lower().endswith(".csv"):
        raise ValueError("upload a .csv file")
    df = _read(spark, path, position="line of the upload")
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in UPLOAD_COLUMNS],
        F.col("line of the upload").alias("position"),
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw reports of the batch pipeline; missing-value tokens become NULL."""
    df = _read(spark, path)
    require_columns(df, RAW_COLUMNS)
    return df.select(*[na_to_null(F.col(c)).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', escapeQuotes=True, emptyValue='""').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """Clean reports for embedding; absent text reads as ''."""
    df = _read(spark, path)
    require_columns(df, ["embedding_text"])
    return df.withColumn("bug_id", F.col("bug_id").try_cast("bigint")).withColumn(
        "embedding_text", F.coalesce("embedding_text", F.lit(""))
    )
