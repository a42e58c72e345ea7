"""The registered queries of this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofind.llm import (
    bm25,
    bpe,
    fill_middle,
    licenses,
    line_crf,
    mixing,
    near_text,
    near_vectors,
    pii,
    repeats,
    secrets,
    token_counts,
    turns,
)
from echofind.llm.common import table

ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: From this score on a document counts as good.
GOOD = 0.3


def query(function):
    ALL[function.__name__] = function
    return function


def held_out(doc_id="doc_id"):
    """True for the fifth of the ids whose labels are never learnt from (NULL ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


@query
def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = line_crf.score(documents, line_crf.train(documents, labels))
    predicted = F.when(F.col("score") >= GOOD, 1).otherwise(0)
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


@query
def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


SQL["op4_fair_mix"] = mixing.MIX_SQL


@query
def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: doc_id, counts, base_sha256 and spans."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.digest(*pii.find(documents, ["doc_id"]))
    return found.select("row.doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens and hashes of both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.encode(documents, path, check=True)
    hashes = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return decoded.select("doc_id", "n_tokens", *hashes)


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: doc_id, class_id, n_links, kept."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_text.join(documents)
    return found.select("doc_id", "class_id", "n_links", F.col("chosen").alias("kept"))


@query
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors: vec_id, n_links, component_id, kept."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op10_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) BETWEEN 0.93 AND 2),
reach AS (SELECT a AS node, b AS other FROM p UNION SELECT r.node, p.b FROM reach r JOIN p ON p.a = r.other),
c AS (SELECT node, MIN(other) AS least FROM reach GROUP BY node),
n AS (SELECT a, COUNT(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, COALESCE(n_links, 0)::BIGINT AS n_links, LEAST(vec_id, COALESCE(least, vec_id)) AS component_id,
       vec_id <= COALESCE(least, vec_id) AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON node = vec_id
"""


@query
def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated passages: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op2_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: doc_id, counts, base_sha256 and spans."""
    found = secrets.find(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", *[f"n_{k}" for k in secrets.STRONG], "base_sha256", "spans")


@query
def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document: doc_id, license (of the best covered), coverage, n_notices, spans."""
    found = licenses.notices(table(spark, sf_dir, "documents"), carry=["doc_id"])
    best = F.expr("array_max(transform(notices, n -> struct(n.coverage, -n.start, n.license)))")
    spans = F.transform("notices", lambda n: F.concat_ws(":", n["license"], n["start"], n["end"]))
    return found.select(
        "row.doc_id",
        best["license"].alias("license"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(spans, ",").alias("spans"),
    )


@query
def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20, itself included."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = documents.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25.top_k(documents, queries)


SQL["op1_bm25_search"] = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, COUNT(*) AS n FROM w GROUP BY doc_id, t),
dl AS (SELECT doc_id, SUM(n) AS l FROM tf GROUP BY doc_id),
df AS (SELECT t, COUNT(*) AS df FROM tf GROUP BY t),
g AS (SELECT (SELECT COUNT(*) FROM documents)::DOUBLE AS n, (SELECT SUM(l) FROM dl)::DOUBLE / (SELECT COUNT(*) FROM documents) AS mean),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         ROUND(SUM(q.n * LN(1 + (g.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
                   * (d.n * 2.2::DOUBLE / (d.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean)))), 6) AS score
  FROM tf q JOIN tf d ON q.t = d.t JOIN df ON df.t = q.t JOIN dl ON dl.doc_id = d.doc_id, g
  WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at lines for filling in the middle: doc_id, n, form, sizes and hashes of both texts."""
    done = fill_middle.transform(table(spark, sf_dir, "documents"), carry=["doc_id"], check=True)
    hashes = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


SQL["op13_fill_middle"] = fill_middle.FILL_SQL


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, n_bytes, n_tokens, over_limit."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.count(table(spark, sf_dir, "documents"), path, carry=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults that a checksum of conversation and turn chooses (NULLs: one space)."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


@query
def op11_repaired_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired: conv_id, what was found, cost, audit and the hash of the repaired rows."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = turns.audits(damaged(conversations)).withColumnRenamed("conv_id", "found_id")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in turns.FOUND],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
