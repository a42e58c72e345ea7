"""Checks on arguments and on incoming rows.

Row checks never stop a load: they split a DataFrame into accepted rows and
rejects that carry a reason. ``on_reject='fail'`` turns rejects into an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofind.schemas import DEFAULT_STATUS, INDEX_TYPES, MAX_LENGTHS, RAW_COLUMNS
from echofind.session import broadcast_if_small, materialize

MOST_HOT_KEYS = 1_000_000
HOT_ROWS = 100_000


def require_columns(df: DataFrame, names: Iterable[str] = RAW_COLUMNS) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def check_index_type(index_type: str) -> None:
    if index_type not in INDEX_TYPES:
        raise ValueError(f"index_type must be one of {', '.join(INDEX_TYPES)}")


def check_k(k: int, most: int | None = None) -> None:
    if k < 1 or (most is not None and k > most):
        raise ValueError(f"k must be at least 1{f' and at most {most}' if most else ''}")


def check_vector(vector: Sequence[float], dim: int | None) -> None:
    if dim is not None and len(vector) != dim:
        raise ValueError(f"expected {dim} dimensions, got {len(vector)}")


def check_search(query: str, k: int, index_type: str) -> None:
    """Bounds of one search request."""
    if len(query) < 2:
        raise ValueError("a query needs at least 2 characters")
    check_k(k, 100)
    check_index_type(index_type)


def check_benchmark(sample_size: int, k: int, index_type: str) -> None:
    """Bounds of one benchmark request."""
    if not 2 <= sample_size <= 500:
        raise ValueError("sample_size must be between 2 and 500")
    check_k(k, 50)
    check_index_type(index_type)


def report_reason(dim: int | None = None) -> Column:
    """Why a report row breaks a rule, or NULL. Absent metadata is allowed."""
    reason = F.when(F.coalesce(F.length("summary"), F.lit(0)) < 1, F.lit("summary is empty"))
    for name, limit in MAX_LENGTHS.items():
        reason = reason.when(F.length(name) > limit, F.lit(f"{name} is longer than {limit}"))
    if dim is not None:
        reason = reason.when(F.coalesce(F.size("embedding"), F.lit(-1)) != dim, F.lit(f"embedding has not {dim} values"))
        reason = reason.when(F.exists("embedding", lambda x: x.isNull()), F.lit("embedding holds NULL"))
    return reason


def request_reason() -> Column:
    """Why a row of a queries table breaks the bounds of a search, or NULL."""
    return (
        F.when(F.coalesce(F.length("query"), F.lit(0)) < 2, F.lit("query is too short"))
        .when(~F.coalesce(F.col("k").between(1, 100), F.lit(False)), F.lit("k is out of bounds"))
        .when(~F.coalesce(F.col("index_type").isin(*INDEX_TYPES), F.lit(False)), F.lit("unknown index_type"))
    )


def run_reason() -> Column:
    """Why a benchmark run may not be stored, or NULL."""
    return F.when(
        ~F.coalesce(F.col("index_type").isin(*INDEX_TYPES), F.lit(False)), F.lit("unknown index_type")
    ).when(~F.coalesce(F.col("k") > 0, F.lit(False)), F.lit("k must be positive"))


def split(df: DataFrame, reason: Column, on_reject: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects with ``reason``)."""
    if on_reject not in ("reject", "fail"):
        raise ValueError("on_reject must be 'reject' or 'fail'")
    marked = df.withColumn("reason", reason)
    accepted = marked.filter(F.col("reason").isNull()).drop("reason")
    rejects = marked.filter(F.col("reason").isNotNull())
    if on_reject == "fail":
        first = rejects.select("reason").first()
        if first is not None:
            raise ValueError(f"rows rejected: {first.reason}")
    return accepted, rejects


def with_defaults(df: DataFrame) -> DataFrame:
    """Status and description defaults of the service; '' counts as missing."""
    status = F.coalesce(F.nullif(F.col("resolution_status"), F.lit("")), F.lit(DEFAULT_STATUS))
    return df.withColumn("resolution_status", status).withColumn(
        "description", F.coalesce(F.col("description"), F.lit(""))
    )


def mark_repeats(df: DataFrame, key: str, position: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``is_repeat``: an earlier row has the same non-NULL key.

    ``position`` may be a column or a struct that orders the rows. First positions
    come from a pre-aggregated groupBy. Keys with over ``hot_rows`` rows come to
    their rows by broadcast (there are at most rows / ``hot_rows`` of them; with
    too many the join is left to Spark); those rows and rows without a key take
    part in the remaining join under a NULL key and a salt, so they spread over
    all tasks and match nothing.
    """
    firsts = (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(position).alias("_first"), F.count("*").alias("_rows"))
        .filter("_rows > 1")
    )
    hot = firsts.filter(F.col("_rows") > hot_rows)
    hot = materialize(hot.select(F.col("_key").alias("_hot_key"), F.col("_first").alias("_hot_first")), "hot-keys")
    rows = df.join(broadcast_if_small(hot, MOST_HOT_KEYS), F.col(key) == F.col("_hot_key"), "left")
    spread_out = F.col(key).isNull() | F.col("_hot_key").isNotNull()
    rows = rows.withColumn("_join_key", F.when(~spread_out, F.col(key))).withColumn(
        "_salt", F.when(spread_out, F.xxhash64(position)).otherwise(F.lit(0).cast("bigint"))
    )
    others = firsts.select(F.col("_key").alias("_join_key"), "_first", F.lit(0).cast("bigint").alias("_salt"))
    first = F.coalesce("_hot_first", "_first")
    return (
        rows.join(others, ["_join_key", "_salt"], "left")
        .withColumn("is_repeat", F.coalesce(F.col(position) > first, F.lit(False)))
        .drop("_join_key", "_salt", "_first", "_hot_key", "_hot_first")
    )


def stored_keys(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The keys of ``df`` that the stored table has already.

    The stored table is the left side and gives one column only: a batch that
    Spark finds small enough is broadcast to it, and the table stays in place.
    """
    wanted = df.select(F.col(key).alias("_wanted")).filter(F.col("_wanted").isNotNull()).distinct()
    return stored.select(key).join(wanted, F.col(key) == F.col("_wanted"), "left_semi").distinct()


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; pre-aggregated before the shuffle."""
    row = F.struct(*[c for c in df.columns if c != key])
    return (
        df.groupBy(key)
        .agg(F.max_by(row, F.struct(*order)).alias("_row"))
        .select(key, "_row.*")
    )
