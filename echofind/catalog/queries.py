"""Registered queries: each operator over the given tables, whole.

Reports are played by ``documents`` (lang = product, source = component) and
``embeddings`` (label = metadata), query texts by ``benchmark``, HTML by
``pages``, runs and latencies by ``events``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofind.functions import display, text, vectors
from echofind.functions.embed import embed
from echofind.operators import ann, evaluate, filtered, graph, groups, growing, knn, lsa, pairs, tree, validate
from echofind.operators.normalize import normalize_reports, service_columns, with_cleaned_text, with_embedding
from echofind.operators.upsert import assign_ids, upsert
from echofind.plans import benchmark, ingest, search
from echofind.schemas import BUG_REPORTS, DIMENSION
from echofind.session import materialize, scratch_dir, spread
from echofind.sources import csv, jsonl, tables
from echofind.sources.keys import open_keys
from echofind.streaming import ingest as streaming

DIM = 64
LISTS = 16
STATUSES = ("UNRESOLVED", "RESOLVED", "New", "closed", "Reopened", "DUPLICATE")
PROBES = 4
TOP_LISTS, LEAVES = 4, 5
DEGREE = 8
K = 10
#: Rows of a file that arrives in a stream, about.
FILE_ROWS = 25_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(spark: SparkSession, sf_dir: str, name: str, parts: Callable[[DataFrame], list[Column]] | None = None) -> DataFrame:
    """A table as a stream; with ``parts`` (conditions) one micro-batch per part, in that order."""
    table = _table(spark, sf_dir, name)
    if parts is None:
        return spark.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    folder, conditions = scratch_dir(spark, f"arriving-{name}"), parts(table)
    sizes = table.agg(*[F.count_if(part) for part in conditions]).first()
    files = max(1, -(-max(sizes) // FILE_ROWS))  # of every part, so that a batch is a part
    arrived = spark.read.schema(table.schema)
    for n, part in enumerate(conditions, 1):
        rows = table.where(part)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(folder)
        for _ in range(len(arrived.parquet(folder).inputFiles()), n * files):  # a small part leaves files out
            spark.createDataFrame([], table.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken in order of their time
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _thirds(docs: DataFrame) -> list[Column]:
    """Three parts by doc_id."""
    cut = [r * (docs.agg(F.max("doc_id")).first()[0] or 0) // 3 for r in (1, 2)]
    return [F.col("doc_id") <= cut[0], F.col("doc_id").between(cut[0] + 1, cut[1]), F.col("doc_id") > cut[1]]


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def _as_queries(reports: DataFrame, *extra: str) -> DataFrame:
    return reports.select(F.col("id").alias("query_id"), "embedding", F.col("id").alias("exclude_id"), *extra)


def _first_vector(spark, sf_dir) -> list[float]:
    return _vectors(spark, sf_dir).filter("id = 0").first().embedding


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("distance", 5).alias("distance"))


def _documents(spark, sf_dir) -> DataFrame:
    """Documents as stored reports with vectors."""
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("summary"),
        F.lit("").alias("description"),
        F.col("lang").alias("product"),
        F.col("source").alias("component"),
    )
    return with_embedding(with_cleaned_text(docs))


def _uploads(docs: DataFrame) -> DataFrame:
    """Documents as an upload; equal texts share an external_id, Spanish ones have none."""
    return docs.select(
        F.col("doc_id").alias("position"),
        F.when(F.col("lang") == "es", F.lit("")).otherwise(F.md5("text")).alias("external_id"),
        F.col("text").alias("summary"),
        F.col("lang").alias("product"),
        F.col("source").alias("component"),
    )


# nearest neighbours


def knn_exact(spark, sf_dir):
    reports = _vectors(spark, sf_dir).filter("id <> 0")
    return knn.nearest(reports, _first_vector(spark, sf_dir), K, DIM).select("id", F.round("distance", 5).alias("distance"))


def knn_join(spark, sf_dir):
    reports = _vectors(spark, sf_dir)
    return _ranked(knn.knn_join(_as_queries(reports), reports, K))


def knn_join_cells(spark, sf_dir):
    """The same join by cells, as it runs when the queries are too many to broadcast."""
    reports = _vectors(spark, sf_dir)
    return _ranked(knn.knn_join(_as_queries(reports), reports, K, broadcast_queries=0, cell_rows=100))


def knn_join_pruned(spark, sf_dir):
    """The same join, with cells that the triangle inequality rules out left alone."""
    reports = _vectors(spark, sf_dir)
    return _ranked(filtered.pruned_join(_as_queries(reports), reports, K, lists=LISTS))


def knn_hybrid_filter(spark, sf_dir):
    found = search.hybrid_search(
        _vectors(spark, sf_dir), _first_vector(spark, sf_dir), {"label": 3}, 5, allowed=("label",), dim=DIM
    )
    return found.select("id", "label", F.round("distance", 5).alias("distance"))


def hybrid_two_filters(spark, sf_dir):
    """Two equality filters, then the nearest to the first document."""
    reports = _documents(spark, sf_dir)
    vector = reports.filter("id = 0").select("embedding").first().embedding
    found = search.hybrid_search(
        reports, vector, {"product": "en", "component": "src3"}, K, allowed=("product", "component"), dim=DIMENSION
    )
    return found.select("id", "product", "component", F.round("distance", 5).alias("distance"))


def search_exclude_self(spark, sf_dir):
    label = F.col("label").cast("string")
    reports = _vectors(spark, sf_dir).withColumn("product", label)
    queries = _as_queries(reports, F.when(F.col("label") < 5, label).otherwise(F.lit("")).alias("product"))
    queries = queries.withColumn("exclude_id", F.nullif("exclude_id", F.lit(0)))
    hits = search.neighbours(queries, reports, K, filters=("product",))
    return search.with_reports(hits, reports).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", "product", "similarity"
    )


def text_search(spark, sf_dir):
    requests = spread(_table(spark, sf_dir, "benchmark"), "item_id").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.lit(5).alias("k"),
        F.when(F.col("item_id") % 2 == 0, F.lit("en")).otherwise(F.lit("")).alias("product"),
        F.lit(None).cast("string").alias("component"),
        F.lit(0).cast("bigint").alias("exclude_id"),
    )
    results, _ = search.search(requests, _documents(spark, sf_dir))
    return results.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", "product", "component", "similarity"
    )


def text_search_lsa(spark, sf_dir):
    """The texts of the benchmark among the documents, with vectors learnt from the documents."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("cleaned_text"))
    model = lsa.train_lsa(docs, dim=DIMENSION, features=2048)
    reports = materialize(spread(docs, "id").select("id", embed(F.col("cleaned_text"), model).alias("embedding")), "lsa-reports")
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), embed(F.col("text"), model).alias("embedding"))
    return _ranked(knn.knn_join(asked, reports, 5))


# approximate search


def _ivf(reports) -> ann.IvfIndex:
    return ann.train_ivf(reports, LISTS, iterations=2)


def ivf_assign(spark, sf_dir):
    reports = _vectors(spark, sf_dir)
    return reports.select("id", _ivf(reports).list_id(F.col("embedding")).cast("bigint").alias("list_id"))


def ivf_index_table(spark, sf_dir):
    reports = _vectors(spark, sf_dir)
    path = scratch_dir(spark, "ivf")
    ann.write_ivf(reports, _ivf(reports), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("list_id").cast("bigint").alias("list_id")).agg(F.count("*").alias("reports"))


def ivf_search(spark, sf_dir):
    reports = _vectors(spark, sf_dir)
    return _ranked(ann.ivf_search(_as_queries(reports), reports, _ivf(reports), K, PROBES))


def ivf_candidates(spark, sf_dir):
    reports = _vectors(spark, sf_dir)
    return ann.candidate_counts(_as_queries(reports), reports, _ivf(reports), PROBES)


def lsh_search(spark, sf_dir):
    reports = _vectors(spark, sf_dir)
    return _ranked(ann.lsh_search(_as_queries(reports), reports, ann.LshIndex(DIM), K))


def ivf_search_stored(spark, sf_dir):
    """The same over a stored table, pruned to the probed lists."""
    reports, path = _vectors(spark, sf_dir), scratch_dir(spark, "ivf")
    index = _ivf(reports)
    ann.write_ivf(reports, index, path)
    return _ranked(ann.ivf_search(_as_queries(reports), spark.read.parquet(path), index, K, PROBES))


def _grown(spark, sf_dir):
    """Lists trained on even vectors, to which the odd ones come as a second load."""
    reports, path = _vectors(spark, sf_dir), scratch_dir(spark, "loads")
    index = _ivf(reports.where("id % 2 = 0"))
    for load in (0, 1):
        growing.append_ivf(reports.where(F.col("id") % 2 == load), index, path, load)
    return reports, index, growing.read_ivf(spark, path)


def ivf_append(spark, sf_dir):
    reports, index, stored = _grown(spark, sf_dir)
    return _ranked(ann.ivf_search(_as_queries(reports), stored, index, K, PROBES))


def ivf_drift(spark, sf_dir):
    _, index, stored = _grown(spark, sf_dir)
    figures = growing.drift(stored, index)
    return figures.select(
        F.col("load").cast("bigint").alias("load"), F.col("list_id").cast("bigint").alias("list_id"), "reports",
        F.round("mean_distance", 5).alias("mean_distance"),
    )


def ivf_merge_split(spark, sf_dir):
    """The loads as one, lists of over 20 reports halved; probing every list then finds what exact search does."""
    reports, index, stored = _grown(spark, sf_dir)
    target = scratch_dir(spark, "merged")
    index = growing.merge_ivf(stored, index, target, most_rows=20)
    return _ranked(ann.ivf_search(_as_queries(reports), growing.read_ivf(spark, target), index, K, index.lists))


def lsh_search_stored(spark, sf_dir):
    """The same over a stored table of buckets."""
    reports, path, index = _vectors(spark, sf_dir), scratch_dir(spark, "lsh"), ann.LshIndex(DIM)
    ann.write_lsh(reports, index, path)
    return _ranked(ann.lsh_search(_as_queries(reports), spark.read.parquet(path), index, K))


def lsh_search_complete(spark, sf_dir):
    """Signatures of 40 bits find hardly anything; the completed form then searches all."""
    reports = _vectors(spark, sf_dir)
    queries = _as_queries(reports).where("query_id % 20 = 0")
    return _ranked(search.neighbours(queries, reports, K, "hnsw", ann.LshIndex(DIM, tables=1, bits=40), flips=0))


def _tree(reports) -> tree.IvfTree:
    return tree.train_tree(reports, TOP_LISTS, LEAVES, iterations=1)


def _tree_hits(spark, sf_dir) -> DataFrame:
    reports, path = _vectors(spark, sf_dir), scratch_dir(spark, "tree")
    index = _tree(reports)
    tree.write_tree(reports, index, path)
    return tree.tree_search(_as_queries(reports), spark.read.parquet(path), index, K, lists=2, probes=PROBES)


def ivf_tree_assign(spark, sf_dir):
    reports = _vectors(spark, sf_dir)
    return tree.assign(reports, _tree(reports)).select("id", F.col("list_id").cast("bigint").alias("list_id"), "leaf")


def ivf_tree_search(spark, sf_dir):
    """Lists in two levels, stored by leaf: the leaves of two lists compete."""
    return _ranked(_tree_hits(spark, sf_dir))


def recall_tree(spark, sf_dir):
    """True recall of the two-level lists."""
    reports = _vectors(spark, sf_dir)
    truth = knn.knn_join(_as_queries(reports), reports, K)
    return _rounded(evaluate.true_recall(evaluate.compare(truth, _tree_hits(spark, sf_dir))), "queries_evaluated")


def _graph(reports) -> graph.GraphIndex:
    return graph.build_graph(reports, DEGREE, rounds=2)


def graph_edges(spark, sf_dir):
    """The neighbour graph after two rounds, in both directions."""
    return _graph(_vectors(spark, sf_dir)).edges


def graph_search(spark, sf_dir):
    """A walk over the stored graph to its end: until every query has opened its 80 best."""
    reports, path = _vectors(spark, sf_dir), scratch_dir(spark, "graph")
    graph.write_graph(_graph(reports), path)
    return _ranked(graph.graph_search(_as_queries(reports), graph.read_graph(spark, path), K))


def recall_graph(spark, sf_dir):
    """True recall of the graph at two settings of its dial, four rounds at most."""
    reports = _vectors(spark, sf_dir)
    queries, index = materialize(_as_queries(reports), "queries"), _graph(reports)
    truth = materialize(knn.knn_join(queries, reports, K), "truth")
    out = None
    for ef in (40, 80):
        found = graph.graph_search(queries, index, K, ef, rounds=4)
        row = _rounded(evaluate.true_recall(evaluate.compare(truth, found)), "queries_evaluated").withColumn("ef", F.lit(ef).cast("bigint"))
        out = row if out is None else out.union(row)
    return out


def hybrid_ivf_few_probes(spark, sf_dir):
    """Filtered search from 4 of 16 lists and those that may hold nearer ones; one filter value is rare."""
    product = F.when(F.col("id") % 97 == 0, F.lit("rare")).otherwise(F.col("label").cast("string"))
    reports, path = _vectors(spark, sf_dir).withColumn("product", product), scratch_dir(spark, "filtered")
    index = _ivf(reports)
    filtered.write_filtered(reports, index, path, ("product",))
    wanted = F.when(F.col("id") % 3 == 0, F.lit("rare")).when(F.col("id") % 3 == 1, F.col("product")).otherwise(F.lit(""))
    queries = _as_queries(reports, wanted.alias("product"))
    stored, counts = spark.read.parquet(path), filtered.read_counts(spark, path)
    return _ranked(filtered.filtered_search(queries, stored, index, counts, K, PROBES, ("product",)))


def duplicate_pairs(spark, sf_dir):
    return pairs.duplicate_pairs(_vectors(spark, sf_dir), K, 0.3)


def duplicate_reports(spark, sf_dir):
    reports = materialize(_documents(spark, sf_dir).select("id", "embedding"), "documents")
    return pairs.duplicate_pairs(reports, 5, 0.9, _ivf(reports), probes=2)


def duplicate_pairs_hashed(spark, sf_dir):
    """Pairs that share a bucket in one of sixteen tables, by cells."""
    reports = _vectors(spark, sf_dir)
    return pairs.duplicate_pairs(reports, K, 0.3, ann.LshIndex(DIM, tables=16, bits=8), broadcast_queries=0)


def duplicate_groups(spark, sf_dir):
    """Every document with its group of near copies and the number of its links."""
    reports = materialize(_documents(spark, sf_dir).select("id", "embedding"), "documents")
    return groups.duplicate_groups(reports, 0.9)


def duplicate_groups_vectors(spark, sf_dir):
    return groups.duplicate_groups(_vectors(spark, sf_dir), 0.45)


# evaluation


def _per_query(spark, sf_dir):
    reports = _vectors(spark, sf_dir)
    queries = _as_queries(reports)
    return evaluate.compare(
        knn.knn_join(queries, reports, K), ann.ivf_search(queries, reports, _ivf(reports), K, PROBES)
    )


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(c, 5).alias(c) for c in df.columns if c not in keep])


def recall_hit_rate(spark, sf_dir):
    return _rounded(evaluate.hit_rate(_per_query(spark, sf_dir)), "queries_evaluated")


def recall_true(spark, sf_dir):
    return _rounded(evaluate.true_recall(_per_query(spark, sf_dir)), "queries_evaluated")


def benchmark_sample(spark, sf_dir):
    """A benchmark run without its clock: sampled reports, list probes against exact."""
    reports = materialize(_documents(spark, sf_dir).select("id", "cleaned_text", "embedding"), "documents")
    quality = benchmark.compare_on_sample(reports, 20, K, "ivfflat", _ivf(reports), probes=1)
    return _rounded(evaluate.hit_rate(quality), "queries_evaluated")


def hybrid_ivf(spark, sf_dir):
    """A filtered search that probes every list: the same as without lists."""
    reports = _vectors(spark, sf_dir)
    found = search.hybrid_search(
        reports, _first_vector(spark, sf_dir), {"label": 3}, 5, ("label",), DIM, "ivfflat", _ivf(reports), probes=LISTS
    )
    return found.select("id", "label", F.round("distance", 5).alias("distance"))


def hybrid_hashed(spark, sf_dir):
    """A filtered search by hashing that probes every bucket: the same as without."""
    found = search.hybrid_search(
        _vectors(spark, sf_dir), _first_vector(spark, sf_dir), {"label": 3}, 5, ("label",), DIM, "hnsw", ann.LshIndex(DIM, bits=2), flips=2
    )
    return found.select("id", "label", F.round("distance", 5).alias("distance"))


def sample_reports(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return evaluate.sample_reports(docs.select("id", "source"), 20)


def latency_summary(spark, sf_dir):
    summary = evaluate.latency_summary(_table(spark, sf_dir, "events"), "value", "event_type")
    return _rounded(summary, "event_type", "queries_evaluated")


def benchmark_history(spark, sf_dir):
    """Runs made of the daily events of each type."""
    events = _table(spark, sf_dir, "events").withColumn("created_at", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    runs = evaluate.latency_summary(events, "value", "event_type", "created_at")
    index_type = (
        F.when(F.col("event_type").isin("click", "view"), F.lit("hnsw"))
        .when(F.col("event_type").isin("error", "signup"), F.lit("ivfflat"))
        .otherwise(F.lit("exact"))
    )
    runs = runs.withColumn("index_type", index_type).withColumn("id", F.ascii("event_type").cast("bigint"))
    newest = tables.history(runs)
    return _rounded(newest.drop("event_type"), "id", "index_type", "created_at", "queries_evaluated")


def vector_audit(spark, sf_dir):
    return evaluate.vector_audit(_table(spark, sf_dir, "embeddings"), DIM)


# text


def clean_service(spark, sf_dir):
    pages = spread(_table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", text.clean_text(F.col("html"), "service").alias("cleaned"))


def clean_pipeline(spark, sf_dir):
    pages = spread(_table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", text.clean_text(F.col("html"), "pipeline").alias("cleaned"))


def _raw_reports(spark, sf_dir) -> DataFrame:
    """Documents as raw reports, with the oddities a raw file has."""
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id")
    number, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    return docs.select(
        F.when(kind == 0, F.concat(F.lit(" "), number, F.lit(" ")))
        .when(kind == 1, F.concat(number, F.lit(".0")))
        .when(kind == 2, F.concat(F.lit("x"), number))
        .when(kind == 3, F.concat(number, F.lit(".5")))
        .otherwise(number)
        .alias("bug_id"),
        F.when(F.col("source") != "src7", F.col("source")).alias("summary"),
        F.when((F.col("source") == "src7") & (F.col("lang") == "en"), F.lit(" \n")).otherwise(F.col("text")).alias("description"),
        F.when(F.col("lang") == "de", F.lit(" duplicate\t")).when(F.col("lang") == "fr", F.lit("Fixed")).alias("resolution_status"),
        F.when(F.col("lang") == "es", F.lit(" ")).when(F.col("lang") == "en", F.lit("Linux")).alias("operating_system"),
        F.when(F.col("lang") != "fr", F.lit("<i>x86_64</i>")).alias("architecture"),
        F.when(F.col("source") != "src0", F.col("source")).alias("component_type"),
    )


def normalize_clean(spark, sf_dir):
    return normalize_reports(_raw_reports(spark, sf_dir))[0]


def normalize_rejects(spark, sf_dir):
    return normalize_reports(_raw_reports(spark, sf_dir))[1].select("bug_id", "reason")


def embed_hash(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id")
    embedded = docs.select("doc_id", embed(F.col("text")).alias("v"))
    return embedded.select(
        "doc_id",
        vectors.dimension(F.col("v")).cast("bigint").alias("dimensions"),
        F.md5(vectors.vector_to_text(F.col("v"))).alias("vector_md5"),
    )


def l2_normalize(spark, sf_dir):
    longer = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    unit = _table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(longer).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("position", "value")).select(
        "vec_id", F.col("position").cast("bigint").alias("position"), F.round("value", 5).alias("value")
    )


def vector_text_roundtrip(spark, sf_dir):
    written = vectors.vector_to_text(F.col("embedding"))
    texts = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", written.alias("vector_text"))
    back = vectors.text_to_vector(F.col("vector_text"))
    distance = vectors.cosine_distance(F.col("embedding"), back)
    return texts.select(
        "vec_id", "vector_text", F.size(back).cast("bigint").alias("dimensions"), F.round(distance, 5).alias("distance")
    )


def seed_vectors(spark, sf_dir):
    """Constant vectors for all reports, then the storage check: the first three ids."""
    value = (F.col("doc_id") + 1).cast("float") / 100
    reports = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "lang", vectors.constant_vector(value, DIMENSION).alias("embedding")
    )
    return (
        reports.select("id", "lang", vectors.dimension(F.col("embedding")).cast("bigint").alias("embedding_dimensions"))
        .orderBy("id")
        .limit(3)
    )


def similarity_band(spark, sf_dir):
    reports = _vectors(spark, sf_dir)
    hits = knn.knn_join(_as_queries(reports), reports, K)
    similarity = display.similarity_of(F.lit(None).cast("double"), F.col("distance"))
    pct = display.percent(similarity)
    # These vectors lie far apart: doubled similarities spread over all bands.
    return hits.select(
        "query_id",
        "id",
        F.round(pct, 3).alias("percent"),
        display.confidence_band(display.percent(similarity * 2)).alias("band"),
    )


def status_class(spark, sf_dir):
    statuses = F.array(*[F.lit(s) for s in STATUSES])
    status = F.element_at(statuses, (F.col("doc_id") % len(STATUSES) + 1).cast("int"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", status.alias("status"))
    return docs.withColumn("status_class", display.status_class(F.col("status")))


# rows


def validate_rejects(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") != "de", F.col("text")).alias("summary"),
        F.md5("text").alias("external_id"),
        F.col("lang").alias("product"),
        F.element_at(F.split("text", "\n"), 1).alias("component"),
        F.col("source").alias("resolution_status"),
        F.lit(None).cast("string").alias("operating_system"),
        F.element_at(F.split("text", "[.]"), 1).alias("architecture"),
    )
    return docs.select("doc_id", validate.report_reason().alias("reason"))


def vector_rejects(spark, sf_dir):
    """Vectors of a wrong length, and with a NULL, among an upload; even labels are right."""
    vector = F.col("embedding")
    upload = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("position"),
        F.lit("x").alias("summary"),
        F.when(F.col("label") % 2 == 0, vector)
        .when(F.col("label") == 1, F.slice(vector, 1, DIM - 1))
        .when(F.col("label") == 3, F.transform(vector, lambda x: F.when(x > 0, x)))
        .when(F.col("label") == 5, F.concat(vector, vector))
        .alias("embedding"),
    )
    _, rejects = ingest.accept_reports(upload, tables.read_table(spark, scratch_dir(spark, "none")), DIM)
    return rejects.select(F.col("position").alias("vec_id"), "reason")


def request_rejects(spark, sf_dir):
    """Requests out of bounds, made of conversations."""
    kinds = F.array(*[F.lit(k) for k in ("exact", "hnsw", "ivfflat", "flat")])
    requests = _table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("x")).alias("query"),
        (F.col("conv_id") % 120).cast("int").alias("k"),
        F.element_at(kinds, (F.col("conv_id") % 4 + 1).cast("int")).alias("index_type"),
    )
    return requests.select("conv_id", "turn", validate.request_reason().alias("reason"))


def run_rejects(spark, sf_dir):
    """Benchmark runs that may not be stored, made of events."""
    runs = _table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.lit("hnsw")).when(F.col("event_type") == "view", F.lit("exact")).alias("index_type"),
        (F.col("event_id") % 3 - 1).cast("int").alias("k"),
    )
    return runs.select("event_id", validate.run_reason().alias("reason"))


def import_counts(spark, sf_dir):
    """Rows imported and rejected, of an upload and of the same once more."""
    table = scratch_dir(spark, "reports")
    upload = _uploads(_table(spark, sf_dir, "documents"))
    loads = [ingest.load_reports(upload, table) for _ in range(2)]
    rows = [(n, load.imported, load.rejects.count()) for n, load in enumerate(loads)]
    return spark.createDataFrame(rows, "upload bigint, imported bigint, rejected bigint")


def import_counts_keyed(spark, sf_dir):
    """The same, with the stored ids asked of a key table by bucket."""
    table, upload = scratch_dir(spark, "reports"), _uploads(_table(spark, sf_dir, "documents"))
    keyed = open_keys(spark, scratch_dir(spark, "keys"), buckets=16)
    loads = [ingest.load_reports(upload, table, keys=keyed) for _ in range(2)]
    rows = [(n, load.imported, load.rejects.count()) for n, load in enumerate(loads)]
    return spark.createDataFrame(rows, "upload bigint, imported bigint, rejected bigint")


def known_keys(spark, sf_dir):
    """Which texts of the benchmark and the documents a key table of the even documents holds."""
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    keyed = open_keys(spark, scratch_dir(spark, "keys"), buckets=16)
    for load, rest in enumerate((0, 2)):  # two loads
        keyed.add(docs.where(F.col("doc_id") % 4 == rest).select(F.md5("text").alias("k")), load)
    asked = docs.select(F.md5("text").alias("external_id")).union(items.select(F.md5("text")))
    return keyed.known(asked)


def latency_with_gaps(spark, sf_dir):
    """Latencies of which clicks have none and views miss some."""
    value = F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    value = value.when(F.col("event_type") != "click", F.col("value"))
    summary = evaluate.latency_summary(_table(spark, sf_dir, "events").withColumn("ms", value), "ms", "event_type")
    return _rounded(summary, "event_type", "queries_evaluated")


def csv_by_header(spark, sf_dir):
    """Files whose columns stand in different order, or are absent."""
    path = scratch_dir(spark, "uploads") + ".csv"
    docs = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("bug_id"), F.col("text").alias("summary"), F.col("lang").alias("product"), F.col("source").alias("component")
    )
    orders = (["bug_id", "summary", "product"], ["product", "bug_id", "component", "summary"], ["summary", "bug_id"])
    for n, order in enumerate(orders):
        csv.write_csv(docs.where(F.col("bug_id").cast("bigint") % 3 == n).select(order), f"{path}/{n}")
    back = csv.read_upload(spark, f"{path}/*/*.csv")
    return back.select(F.col("bug_id").cast("bigint").alias("doc_id"), "summary", "product", "component")


def dedupe_external_id(spark, sf_dir):
    docs = _uploads(_table(spark, sf_dir, "documents"))
    keyed = docs.select("position", text.blank_to_null(F.col("external_id")).alias("external_id"))
    return validate.mark_repeats(keyed, "external_id", "position", hot_rows=5).select(
        "external_id", "is_repeat", F.col("position").alias("doc_id")
    )


def alias_columns(spark, sf_dir):
    upload = _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("doc_id").cast("string")).alias("bug_id"),
        F.concat("source", F.lit("-"), "doc_id").alias("external_id"),
        F.col("text").alias("summary"),
        F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("source")).alias("component"),
        F.col("lang").alias("component_type"),
        F.when(F.col("lang") == "de", F.lit("")).otherwise(F.upper("lang")).alias("resolution_status"),
    )
    return service_columns(upload)


def upsert_latest(spark, sf_dir):
    """Stored states from labels, arriving states from the last turn of each conversation."""
    before, now = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2025-01-01").cast("timestamp_ntz")
    stored = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, F.lit("assistant")).otherwise(F.lit("user")).alias("status"),
        before.alias("created_at"),
        before.alias("updated_at"),
    )
    turns = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), F.col("role").alias("status"), "turn"
    )
    return upsert(stored, validate.latest_per_key(turns, "id", ["turn"]), "id", ["status"], now)


def assign_report_ids(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return assign_ids(docs, ["source", "doc_id"], last_id=100)


# sources and sinks


def csv_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "upload") + ".csv"
    docs = _table(spark, sf_dir, "documents")
    csv.write_csv(
        docs.select(F.col("doc_id").cast("string").alias("bug_id"), F.col("text").alias("summary"), F.col("lang").alias("product")),
        path,
    )
    back = csv.read_upload(spark, path)
    return back.select(F.col("bug_id").cast("bigint").alias("doc_id"), "summary", "product", "component")


def clean_dataset(spark, sf_dir):
    raw, clean = scratch_dir(spark, "raw"), scratch_dir(spark, "clean")
    csv.write_csv(_raw_reports(spark, sf_dir), raw)
    ingest.clean_dataset(spark, raw, clean)
    return csv.read_clean(spark, clean).select("bug_id", "resolution_status", "component_type", "embedding_text")


def jsonl_export(spark, sf_dir):
    clean, target = scratch_dir(spark, "clean"), scratch_dir(spark, "jsonl")
    csv.write_csv(normalize_clean(spark, sf_dir), clean)
    ingest.embed_dataset(spark, clean, target)
    return jsonl.read_jsonl(spark, target).select(
        "bug_id",
        "resolution_status",
        "component_type",
        F.size("embedding").cast("bigint").alias("dimensions"),
        F.round(vectors.norm(F.col("embedding")), 5).alias("norm"),
    )


def _stored(reports: DataFrame) -> DataFrame:
    return reports.select(
        "id",
        "external_id",
        "product",
        "component",
        "resolution_status",
        F.md5("cleaned_text").alias("text_md5"),
        F.size("embedding").cast("bigint").alias("dimensions"),
    )


def bulk_load(spark, sf_dir):
    table = scratch_dir(spark, "reports")
    ingest.load_reports(_uploads(spread(_table(spark, sf_dir, "documents"), "doc_id")), table)
    return _stored(tables.read_table(spark, table))


# streams


def stream_ingest(spark, sf_dir):
    table, checkpoint = scratch_dir(spark, "reports"), scratch_dir(spark, "checkpoint")
    arriving = _uploads(_stream(spark, sf_dir, "documents", _thirds))
    streaming.ingest_stream(arriving, table, checkpoint).awaitTermination()
    return _stored(streaming.read_batches(spark, table, BUG_REPORTS))


def stream_dedupe(spark, sf_dir):
    table, checkpoint = scratch_dir(spark, "reports"), scratch_dir(spark, "checkpoint")
    arriving = _uploads(_stream(spark, sf_dir, "documents", _thirds))
    streaming.ingest_stream(arriving, table, checkpoint).awaitTermination()
    return spark.read.parquet(f"{table}_rejects").select(F.col("position").alias("doc_id"), "external_id", "reason")


def stream_dedupe_keyed(spark, sf_dir):
    """The same with the stored ids in a key table, a load per micro-batch."""
    table, checkpoint = scratch_dir(spark, "reports"), scratch_dir(spark, "checkpoint")
    keyed = open_keys(spark, scratch_dir(spark, "keys"), buckets=16)
    arriving = _uploads(_stream(spark, sf_dir, "documents", _thirds))
    streaming.ingest_stream(arriving, table, checkpoint, keys=keyed).awaitTermination()
    return spark.read.parquet(f"{table}_rejects").select(F.col("position").alias("doc_id"), "external_id", "reason")


def stream_match(spark, sf_dir):
    target, checkpoint = scratch_dir(spark, "matches"), scratch_dir(spark, "checkpoint")
    halves = [F.col("vec_id") % 2 == 0, F.col("vec_id") % 2 == 1]
    arrivals = _as_queries(_stream(spark, sf_dir, "embeddings", lambda _: halves).withColumnRenamed("vec_id", "id"))
    streaming.match_stream(arrivals, lambda: _vectors(spark, sf_dir), target, checkpoint, K).awaitTermination()
    return _ranked(spark.read.parquet(target))


def stream_upsert(spark, sf_dir):
    """The last turn of each conversation; odd turns arrive first, so half of the even ones come late."""
    table, checkpoint = scratch_dir(spark, "states"), scratch_dir(spark, "checkpoint")
    turns = _stream(spark, sf_dir, "conversations", lambda _: [F.col("turn") % 2 == 1, F.col("turn") % 2 == 0])
    columns = ["turn", "role", "text"]
    streaming.upsert_stream(turns, table, checkpoint, "conv_id", columns, ["turn"]).awaitTermination()
    latest = streaming.read_latest(spark, table, streaming.state_schema(turns, "conv_id", columns), "conv_id", ["turn"])
    return latest.select("conv_id", *columns)


def stream_watermark(spark, sf_dir):
    """First arrivals per user and event type, with bounded state; errors have no key and all pass."""
    target, checkpoint = scratch_dir(spark, "firsts"), scratch_dir(spark, "checkpoint")
    key = F.when(F.col("event_type") != "error", F.concat_ws("-", "user_id", "event_type"))
    arrivals = _stream(spark, sf_dir, "events").select(key.alias("external_id"), F.col("ts").cast("timestamp").alias("ts"))
    firsts = streaming.dedupe_within_watermark(arrivals, "external_id", "ts", "60 days").select("external_id")
    (
        firsts.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema("external_id string").parquet(target)


ALL = {
    f.__name__: f
    for f in (
        knn_exact, knn_join, knn_join_cells, knn_join_pruned, knn_hybrid_filter, hybrid_two_filters, hybrid_ivf, hybrid_hashed, search_exclude_self, text_search, text_search_lsa,
        ivf_assign, ivf_index_table, ivf_search, ivf_search_stored, ivf_append, ivf_drift, ivf_merge_split, ivf_candidates, lsh_search, lsh_search_stored, lsh_search_complete,
        ivf_tree_assign, ivf_tree_search, recall_tree, graph_edges, graph_search, recall_graph, hybrid_ivf_few_probes,
        duplicate_pairs, duplicate_pairs_hashed, duplicate_reports, duplicate_groups, duplicate_groups_vectors,
        recall_hit_rate, recall_true, benchmark_sample, sample_reports, latency_summary, benchmark_history, vector_audit,
        clean_service, clean_pipeline, normalize_clean, normalize_rejects, embed_hash, l2_normalize,
        vector_text_roundtrip, seed_vectors, similarity_band, status_class,
        validate_rejects, vector_rejects, request_rejects, run_rejects, import_counts, import_counts_keyed, known_keys, latency_with_gaps, csv_by_header,
        dedupe_external_id, alias_columns, upsert_latest, assign_report_ids,
        csv_roundtrip, clean_dataset, jsonl_export, bulk_load,
        stream_ingest, stream_dedupe, stream_dedupe_keyed, stream_match, stream_upsert, stream_watermark,
    )
}
