"""Raw reports to clean reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofind.functions.embed import Embedder, embed_report
from echofind.functions.text import blank_to_null, clean_text, is_fractional, joined_text, numeric_id, strip_space
from echofind.operators.validate import require_columns, split, with_defaults
from echofind.schemas import (
    DEFAULT_COMPONENT,
    DEFAULT_STATUS,
    DEFAULT_SYSTEM,
    RAW_COLUMNS,
    UPLOAD_COLUMNS,
)


def normalize_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch pipeline: (clean reports with ``embedding_text``, rejects with ``reason``).

    Metadata defaults apply before cleaning, so a blank value stays blank.
    Every dropped row is among the rejects: no whole number as id, or no text.
    """
    require_columns(raw, RAW_COLUMNS)
    clean = raw.select(
        F.col("bug_id").alias("_given"),
        numeric_id(F.col("bug_id")).alias("bug_id"),
        clean_text(F.col("summary"), "pipeline", pinned=True).alias("summary"),
        clean_text(F.col("description"), "pipeline", pinned=True).alias("description"),
        normal_status(F.col("resolution_status")).alias("resolution_status"),
        _labelled("operating_system", DEFAULT_SYSTEM),
        _labelled("architecture", DEFAULT_SYSTEM),
        _labelled("component_type", DEFAULT_COMPONENT),
    )
    reason = (
        F.when(is_fractional(F.coalesce("_given", F.lit(""))), F.lit("bug_id is fractional"))
        .when(F.col("bug_id").isNull(), F.lit("bug_id is not a number"))
        .when((F.col("summary") == "") & (F.col("description") == ""), F.lit("summary and description are empty"))
    )
    accepted, rejects = split(clean, reason)
    text = clean_text(joined_text(F.col("summary"), F.col("description")), "pipeline")
    return accepted.drop("_given").withColumn("embedding_text", text), rejects.drop("bug_id").withColumnRenamed(
        "_given", "bug_id"
    )


def normal_status(status: Column) -> Column:
    return F.upper(strip_space(F.coalesce(status, F.lit(DEFAULT_STATUS))))


def _labelled(name: str, default: str) -> Column:
    return clean_text(F.coalesce(F.col(name), F.lit(default)), "pipeline").alias(name)


def service_columns(upload: DataFrame) -> DataFrame:
    """Uploaded rows under the service's column names, defaults filled in.

    Alternative names are taken by first non-empty value; absent columns read
    as NULL.
    """

    def col(name: str) -> Column:
        return F.col(name) if name in upload.columns else F.lit(None).cast("string")

    def first_filled(*names: str) -> Column:
        return F.coalesce(*[blank_to_null(col(n)) for n in names])

    given = [c for c in upload.columns if c not in UPLOAD_COLUMNS]
    return with_defaults(
        upload.select(
            *given,
            first_filled("bug_id", "external_id").alias("external_id"),
            F.coalesce(col("summary"), F.lit("")).alias("summary"),
            col("description").alias("description"),
            col("product").alias("product"),
            first_filled("component", "component_type").alias("component"),
            col("resolution_status").alias("resolution_status"),
            col("operating_system").alias("operating_system"),
            col("architecture").alias("architecture"),
        )
    )


def with_cleaned_text(reports: DataFrame) -> DataFrame:
    return reports.withColumn("cleaned_text", clean_text(joined_text(F.col("summary"), F.col("description"))))


def with_embedding(reports: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    return reports.withColumn("embedding", embed_report(F.col("cleaned_text"), embedder))
