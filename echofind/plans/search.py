"""Requests to ranked reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofind.functions.embed import Embedder, embed_report
from echofind.functions.text import blank_to_null
from echofind.operators import ann, filtered, graph, knn, tree
from echofind.operators.validate import check_index_type, check_search, check_vector, request_reason, split
from echofind.schemas import FILTER_COLUMNS
from echofind.session import broadcast_if_small, materialize

DEFAULT_K = 10
BROADCAST_HITS = 2_000_000
FILTERS = ("product", "component")
# Fixed value: what the request calls a column that is stored under another name.
STORED_NAMES = {"component_type": "component"}


Index = ann.IvfIndex | ann.LshIndex | tree.IvfTree | graph.GraphIndex


def neighbours(
    queries: DataFrame,
    reports: DataFrame,
    k: int,
    index_type: str = "exact",
    index: Index | None = None,
    filters: tuple[str, ...] = (),
    probes: int = ann.PROBES,
    flips: int = ann.FLIPS,
    lists: int = 4,
    ef: int = graph.EF,
    counts: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """(query_id, rank, id, distance) by the chosen method.

    ``ivfflat`` needs a trained index: lists (with ``counts`` of the filter values
    the result is exact, from few lists) or a tree of lists over reports stored
    by leaf. ``hnsw`` is answered by a graph with its dial ``ef``, or by hyperplane
    hashing; both return k rows where k exist.
    """
    check_index_type(index_type)
    if index_type == "exact":
        return knn.knn_join(queries, reports, k, filters, **limits)
    if index is None:
        raise ValueError(f"{index_type} needs an index")
    if index_type == "ivfflat":
        if isinstance(index, tree.IvfTree):
            return tree.tree_search(queries, reports, index, k, lists, probes, filters, **limits)
        if counts is not None:
            return filtered.filtered_search(queries, reports, index, counts, k, probes, filters, **limits)
        return ann.ivf_search(queries, reports, index, k, probes, filters, **limits)
    if isinstance(index, graph.GraphIndex):
        return _walked(queries, reports, index, k, max(ef, k), filters, **limits)
    return ann.lsh_search(queries, reports, index, k, flips, filters, complete=True, **limits)


def _walked(queries, reports, index: graph.GraphIndex, k: int, ef: int, filters, **limits) -> DataFrame:
    """The walk's ``ef`` best that match; queries still short go through the exact search."""
    queries = materialize(queries, "queries")
    found = graph.graph_search(queries, index, ef if filters else k, ef)
    if filters:
        kept = reports.select("id", *[F.col(f).alias(f"_{f}") for f in filters])
        asked = queries.select("query_id", *filters)
        found = found.drop("rank").join(kept, "id").join(asked, "query_id")
        for f in filters:
            found = found.where((F.coalesce(F.col(f), F.lit("")) == "") | (F.col(f) == F.col(f"_{f}")))
        found = knn.rank_hits(found.select("query_id", "id", "distance"), k)
    found = materialize(found, "walked")
    enough = found.where(F.col("rank") == k).select("query_id")
    short = queries.join(enough, "query_id", "left_anti")
    if short.isEmpty():
        return found
    return found.join(enough, "query_id", "left_semi").unionByName(knn.knn_join(short, reports, k, filters, **limits))


def search(
    requests: DataFrame,
    reports: DataFrame,
    index_type: str = "exact",
    index=None,
    embedder: Embedder | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Answer a table of text requests: (results, rejected requests).

    ``requests`` holds query_id, query, k, product, component, exclude_id.
    '' and NULL mean no filter; 0 and NULL exclude nothing. Results hold the
    report without its vector, the rank and the similarity. Ranking reads ids,
    vectors and filter columns only; the rest is joined to the few rows found.
    A column ``index_type`` gives each request its own method (NULL: the
    argument); ``index`` is then a dict with an index per method.
    """
    own = F.col("index_type") if "index_type" in requests.columns else F.lit(None).cast("string")
    checked = requests.withColumn("index_type", F.coalesce(own, F.lit(index_type)))
    accepted, rejects = split(checked, request_reason())
    queries = accepted.select(
        "query_id",
        "k",
        "index_type",
        *[blank_to_null(F.col(f)).alias(f) for f in FILTERS],
        F.nullif(F.col("exclude_id"), F.lit(0)).alias("exclude_id"),
        embed_report(F.col("query"), embedder).alias("embedding"),
    )
    deepest = accepted.agg(F.max("k").alias("k")).first().k or DEFAULT_K
    if "index_type" in requests.columns:
        queries = materialize(queries, "requests")
        modes = [r.index_type for r in queries.select("index_type").distinct().collect()]  # three at most
    else:
        modes = [index_type]
    hits = None
    for mode in modes or [index_type]:
        mine = queries.where(F.col("index_type") == mode).drop("index_type")
        some = index.get(mode) if isinstance(index, dict) else index
        part = neighbours(mine, reports, deepest, mode, some, FILTERS, **options)
        hits = part if hits is None else hits.union(part)
    wanted = accepted.select("query_id", F.col("k").alias("_k"))
    hits = hits.join(wanted, "query_id").filter(F.col("rank") <= F.col("_k")).drop("_k")
    return with_reports(hits, reports), rejects


def with_reports(hits: DataFrame, reports: DataFrame) -> DataFrame:
    """Ranked hits with the report columns a caller sees, and the similarity.

    The hits are written first: ranking runs once, and their size is known
    when the join is planned. Few hits are taken to the reports, which then
    stay in place.
    """
    hits = materialize(hits, "hits").withColumn("similarity", F.round(1 - F.col("distance"), 5)).drop("distance")
    shown = reports.drop("embedding", "cleaned_text", "updated_at")
    return shown.join(broadcast_if_small(hits, BROADCAST_HITS), "id")


def search_text(
    reports: DataFrame,
    query: str,
    k: int = DEFAULT_K,
    product: str | None = None,
    component: str | None = None,
    exclude_id: int | None = None,
    index_type: str = "exact",
    **options,
) -> DataFrame:
    """One text request."""
    check_search(query, k, index_type)
    requests = reports.sparkSession.createDataFrame(
        [(0, query, k, product, component, exclude_id)],
        "query_id bigint, query string, k int, product string, component string, exclude_id bigint",
    )
    results, _ = search(requests, reports, index_type, **options)
    return results.drop("query_id").orderBy("rank")


def hybrid_search(
    reports: DataFrame,
    vector: Sequence[float],
    filters: dict[str, object] | None = None,
    k: int = 5,
    allowed: Sequence[str] = FILTER_COLUMNS,
    dim: int | None = None,
    index_type: str = "exact",
    index: Index | None = None,
    counts: DataFrame | None = None,
    **dials,
) -> DataFrame:
    """Filter by equality, then rank by distance, exactly or with an index and its dials.

    With ``counts`` (of reports stored by list) the lists are chosen by what they
    hold of the filter's values, and the result is exact. The filter reaches the scan. ``component_type`` means the stored table's
    ``component`` where reports have no column of that name.
    """
    check_index_type(index_type)
    test = knn.equal_to(filters, allowed, {n: STORED_NAMES.get(n, n) for n in allowed if n not in reports.columns})
    some = reports.filter(test)
    if index_type == "exact":
        return knn.nearest(some, vector, k, dim)
    check_vector(vector, dim)
    query = reports.sparkSession.createDataFrame([(0, list(vector))], "query_id bigint, embedding array<float>")
    if counts is not None:
        names = {n: STORED_NAMES.get(n, n) if n not in reports.columns else n for n in filters or {}}
        query = query.select("*", *[F.lit(str(value)).alias(names[n]) for n, value in (filters or {}).items()])
        hits = neighbours(query, reports, k, index_type, index, tuple(names.values()), counts=counts, **dials)
    else:
        hits = neighbours(query, some, k, index_type, index, **dials)
    hits = materialize(hits, "hits")
    found = some.join(F.broadcast(hits.select("id", "distance", "rank")), "id")  # k rows
    return found.orderBy("rank").drop("rank")
