"""Table layouts. Readers always use these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

DIMENSION = 384

# Column names, defaults and limits of the report model.
RAW_COLUMNS = (
    "bug_id",
    "summary",
    "description",
    "resolution_status",
    "operating_system",
    "architecture",
    "component_type",
)
UPLOAD_COLUMNS = (
    "bug_id",
    "external_id",
    "summary",
    "description",
    "product",
    "component",
    "component_type",
    "resolution_status",
    "operating_system",
    "architecture",
)
MAX_LENGTHS = {
    "external_id": 128,
    "product": 120,
    "component": 120,
    "resolution_status": 32,
    "operating_system": 80,
    "architecture": 80,
}
DEFAULT_STATUS = "UNRESOLVED"
DEFAULT_SYSTEM = "Unknown"
DEFAULT_COMPONENT = "General"
INDEX_TYPES = ("exact", "hnsw", "ivfflat")
FILTER_COLUMNS = ("operating_system", "architecture", "component_type", "resolution_status")


def strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_REPORT = strings(RAW_COLUMNS)
# Values are never NULL: rows that hold one are rejected before they are stored.
VECTOR = T.ArrayType(T.FloatType())

BUG_REPORTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("cleaned_text", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("resolution_status", T.StringType()),
        T.StructField("operating_system", T.StringType()),
        T.StructField("architecture", T.StringType()),
        T.StructField("reported_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("embedding", VECTOR),
    ]
)

BENCHMARK_RUNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("index_type", T.StringType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("queries_evaluated", T.IntegerType()),
        T.StructField("recall_at_1", T.DoubleType()),
        T.StructField("recall_at_5", T.DoubleType()),
        T.StructField("recall_at_10", T.DoubleType()),
        T.StructField("average_latency_ms", T.DoubleType()),
        T.StructField("p95_latency_ms", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
