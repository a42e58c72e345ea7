"""From raw documents to training tokens: filter, deduplicate, mask, mix, encode.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and works
on all rows the one before it kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofind.llm import bpe, line_crf, mixing, near_text, pii
from echofind.llm.common import table
from echofind.llm.queries import GOOD, held_out
from echofind.session import materialize, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the line model rejects."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = line_crf.score(docs, line_crf.train(docs, labels), into="crf_score")
    return scored.where(scored["crf_score"] >= GOOD).select(*[scored[f"`{c}`"] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    ship_package(spark)
    return near_text.deduplicate(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each source its share; a document that the mix takes twice comes twice."""
    mixed = mixing.mix(docs).where("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return mixed.select("row", copies.alias("copy")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; ``ids`` holds little-endian unsigned 32-bit numbers."""
    ship_package(spark)
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded.select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Not expressible in SQL (a fitted model, near duplicates, merges); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
