"""Files to stored, searchable reports."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofind.functions.embed import Embedder, embed
from echofind.operators.normalize import normalize_reports, service_columns, with_cleaned_text, with_embedding
from echofind.operators.upsert import assign_ids
from echofind.operators.validate import check_vector, mark_repeats, report_reason, split, stored_keys
from echofind.schemas import BUG_REPORTS, DIMENSION, UPLOAD_COLUMNS, strings
from echofind.session import materialize
from echofind.sources import csv, jsonl, tables
from echofind.sources.keys import BUCKETS, KeyTable, create_keys

NOT_UNIQUE = "external_id is not unique"
#: The column that tells the rows of an upload apart.
ROW = "row_number"


class Load(NamedTuple):
    imported: int
    rejects: DataFrame


def accept_reports(
    upload: DataFrame, stored: DataFrame, dim: int | None = None, keys: KeyTable | None = None, before: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows to load, rejects with ``reason``) of an upload, by all table rules.

    Rows keep their ``position`` in the upload, and get a number of their own
    (``row_number``): positions may repeat. The first row of a repeated
    external_id, by both, is kept, unless the id is stored already. Vectors that
    come with the upload must have ``dim`` values. With ``keys`` (its loads below
    ``before``) the stored ids are asked of that table, and ``stored`` is not read.
    """
    if "position" not in upload.columns:
        upload = upload.withColumn("position", F.monotonically_increasing_id())
    numbered = upload.withColumn(ROW, F.monotonically_increasing_id())
    rows = materialize(service_columns(numbered), "upload")  # written, so numbers stay
    valid, invalid = split(rows, report_reason(dim if "embedding" in upload.columns else None))
    # Uniqueness is judged on numbers and keys only; whole rows are not shuffled for it.
    ids = valid.select(ROW, F.struct("position", ROW).alias("place"), "external_id").filter("external_id IS NOT NULL")
    again = mark_repeats(ids, "external_id", "place").filter("is_repeat")
    held = stored_keys(ids, stored, "external_id") if keys is None else keys.known(ids.select("external_id"), before)
    known = ids.join(held, "external_id")
    repeated = materialize(again.select(ROW).union(known.select(ROW)).distinct(), "repeated")
    not_unique = valid.join(repeated, ROW, "left_semi").withColumn("reason", F.lit(NOT_UNIQUE))
    return valid.join(repeated, ROW, "left_anti"), invalid.unionByName(not_unique).drop(ROW)


def load_reports(
    upload: DataFrame,
    table: str,
    embedder: Embedder | None = None,
    on_reject: str = "reject",
    keys: KeyTable | None = None,
) -> Load:
    """Validate, clean, embed and append; ids follow the order of the upload.

    ``on_reject='fail'`` writes nothing if any row breaks a rule. ``keys`` holds the
    external ids of the table, is asked instead of it, and takes up the new ones: a
    load that fails after its rows were appended is put right by :func:`key_reports`.
    """
    spark = upload.sparkSession
    stored = tables.read_table(spark, table)
    accepted, rejects = accept_reports(upload, stored, embedder.dim if embedder else DIMENSION, keys)
    if on_reject == "fail" and (first := rejects.first()) is not None:
        raise ValueError(f"nothing imported: {first.reason}")
    numbered = assign_ids(accepted, ["position", ROW], tables.last_id(stored))
    reports = with_cleaned_text(numbered)
    if "embedding" not in reports.columns:
        reports = with_embedding(reports, embedder)
    imported = tables.append(complete(reports), table)
    if keys is not None:
        keys.add(accepted.select("external_id"), keys.next_load())
    return Load(imported, rejects)


def key_reports(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> KeyTable:
    """A new key table, at ``path``, of the external ids a report table holds."""
    keys = create_keys(spark, path, buckets)
    keys.add(tables.read_table(spark, table).select("external_id"), 0)
    return keys


def add_report(
    spark: SparkSession, table: str, summary: str, embedding: Sequence[float] | None = None, embedder: Embedder | None = None, **fields: str
) -> int | None:
    """One report, optionally with its vector; its id, or None if a rule rejects it.

    ``fields`` are columns of an upload, or ``reported_at`` (a datetime).
    """
    unknown = sorted(set(fields) - set(UPLOAD_COLUMNS) - {"reported_at"})
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    row = {"summary": summary, **{n: fields.get(n) for n in UPLOAD_COLUMNS if n != "summary"}}
    upload = spark.createDataFrame([tuple(row.values())], strings(row))
    if fields.get("reported_at") is not None:
        upload = upload.withColumn("reported_at", F.lit(fields["reported_at"]).cast("timestamp"))
    if embedding is not None:
        check_vector(embedding, embedder.dim if embedder else DIMENSION)
        upload = upload.withColumn("embedding", F.lit(list(embedding)).cast("array<float>"))
    load = load_reports(upload, table, embedder)
    return tables.last_id(tables.read_table(spark, table)) if load.imported else None


def complete(reports: DataFrame) -> DataFrame:
    """All columns of the report table; time stamps are the time of writing."""
    for name in ("created_at", "updated_at"):
        reports = reports.withColumn(name, F.current_timestamp())
    if "reported_at" not in reports.columns:
        reports = reports.withColumn("reported_at", F.lit(None).cast("timestamp"))
    return reports.select(*BUG_REPORTS.fieldNames())


def import_csv(spark: SparkSession, path: str, table: str, embedder: Embedder | None = None, on_reject: str = "reject") -> Load:
    return load_reports(csv.read_upload(spark, path), table, embedder, on_reject)


def clean_dataset(spark: SparkSession, source: str, target: str) -> str:
    """Raw CSV to clean CSV."""
    clean, _ = normalize_reports(csv.read_raw(spark, source))
    return csv.write_csv(clean, target)


def embed_dataset(
    spark: SparkSession, source: str, target: str, embedder: Embedder | None = None, table: str | None = None
) -> str:
    """Clean CSV to JSONL with vectors, and optionally into the report table."""
    clean = csv.read_clean(spark, source)
    embedded = clean.withColumn("embedding", embed(F.col("embedding_text"), embedder))
    jsonl.write_jsonl(embedded, target)
    if table is not None:
        dim = embedder.dim if embedder else DIMENSION
        written = jsonl.read_jsonl(spark, target)
        valid, _ = split(written, F.when(F.size("embedding") != dim, F.lit("dimension")), on_reject="fail")
        numbered = assign_ids(valid, ["bug_id"], tables.last_id(tables.read_table(spark, table)))
        reports = with_cleaned_text(numbered.withColumnRenamed("component_type", "component"))
        for name in ("external_id", "product"):
            reports = reports.withColumn(name, F.lit(None).cast("string"))
        tables.append(complete(reports), table)
    return target
