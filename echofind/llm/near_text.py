"""N-gram Jaccard join by MinHash banding.

A text is its set of word runs (five words; shorter texts are one run). Texts
with the same set are one node with copies. Each node has a MinHash signature cut
into bands; the numbers of bands and rows are chosen for a target recall at the
threshold. Nodes that share a band's hash are candidates: each hangs on the
smallest node of its band bucket, which gives candidate groups without listing
pairs. Within a group all pairs are verified on their full sets, in blocks of
bounded size, so the join finds every pair in a candidate group with Jaccard
similarity at the threshold or above, and none below it.

Skew: copies are folded before anything is compared; bucket minima are combined
before the shuffle; the sets of a large group are dealt to many blocks, bounded in bytes and members. Sets are
made again from the text for candidates only, so most of the corpus leaves the
first scan as a signature.

Defined results: a text without words (NULL, empty, blank) links with nothing;
a NULL id is allowed, and its row belongs to its text's class; rows that repeat
are copies of each other; classes without any id have a NULL class id; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofind.llm import pairwise
from echofind.llm.common import blocks, components, mix, shingles
from echofind.session import materialize

#: Bytes of run hashes in one chunk of a candidate group.
CHUNK_BYTES = 1 << 20
#: Members of one chunk, about; a block of two chunks makes square matrices of its members.
CHUNK_MEMBERS = 1024


def bands_for(threshold: float, recall: float, most_rows: int = 6) -> tuple[int, int]:
    """Bands and rows: as many rows as ``most_rows``, and bands enough that a pair at the threshold is found with ``recall``."""
    rows = most_rows
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
    return bands, rows


def _digest(runs: np.ndarray) -> bytes:
    return hashlib.blake2b(runs.tobytes(), digest_size=16).digest()


def _sets(runs: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's runs sorted and without repeats, with new edges."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((runs, row))
    runs, row = runs[order], row[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
    return runs[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(edges) - 1))])


def sketch(documents: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``node`` (digest of the set of runs; NULL without words), ``runs`` and ``bands``."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def sketched(batches):
        for part, data, offsets in blocks(batches):
            runs, edges = _sets(*shingles(data, offsets, n))
            some = np.flatnonzero(np.diff(edges))
            bucket = np.zeros((len(some), bands), np.uint64)
            for b in range(bands):
                for r in range(rows):
                    least = np.minimum.reduceat(runs * factors[b * rows + r], edges[:-1][some]) if len(some) else bucket[:, b]
                    bucket[:, b] = mix(bucket[:, b] * np.uint64(31) + least + np.uint64(b + 1))
            node, held = [None] * len(part), [None] * len(part)
            signed = bucket.view(np.int64)
            for k, i in enumerate(some.tolist()):
                node[i] = _digest(runs[edges[i] : edges[i + 1]])
                held[i] = signed[k]
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(node, pa.binary()), pa.array(np.diff(edges)), pa.array(held, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "node", "runs", "bands"],
            )

    rows_in = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows_in.mapInArrow(sketched, f"doc_id {kind}, text_key bigint, node binary, runs bigint, bands array<bigint>")


def run_sets(documents: DataFrame, n: int) -> DataFrame:
    """``node`` and ``set`` (its run hashes, packed) of texts given with ``wanted``, the node they stand for."""

    def made(batches):
        for part, data, offsets in blocks(batches):
            runs, edges = _sets(*shingles(data, offsets, n))
            cut = [runs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
            node = [hashlib.blake2b(c, digest_size=16).digest() for c in cut]
            keep = [k for k, (x, w) in enumerate(zip(node, part.column(0).to_pylist())) if x == w]
            yield pa.record_batch([pa.array([node[k] for k in keep], pa.binary()), pa.array([cut[k] for k in keep], pa.binary())], ["node", "set"])

    return documents.select("wanted", "text").mapInArrow(made, "node binary, set binary")


def jaccard_links(rows: pa.RecordBatch, threshold: float) -> np.ndarray:
    """Which of the sets of a block have at least the threshold's similarity."""
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column(rows.schema.get_field_index("set"))]
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        shared = np.zeros((2, 2))
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        run = np.concatenate(sets)
        owner = np.repeat(np.arange(m), size)
        order = np.argsort(run, kind="stable")
        run, owner = run[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        count = np.diff(np.append(head, len(run)))
        often = np.repeat(count > 1, count)  # runs of one set only add nothing
        owner, column = owner[often], np.repeat(np.cumsum(count > 1) - 1, count)[often]
        shared = np.zeros((m, m), np.float32)
        strip = max(64, (1 << 22) // m)
        for start in range(0, int((count > 1).sum()), strip):
            a, b = np.searchsorted(column, [start, start + strip])
            flags = np.zeros((m, int(column[b - 1]) - start + 1), np.float32)
            flags[owner[a:b], column[a:b] - start] = 1
            shared += flags @ flags.T
    union = size[:, None] + size[None, :] - shared.astype(np.float64)
    return shared.astype(np.float64) / np.maximum(union, 1) >= threshold


def join(documents: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, ``class_id``, ``n_links``, ``copies`` and ``chosen``.

    ``class_id`` is the smallest id among the documents reached by links;
    ``n_links`` counts the other documents linked directly, copies included;
    ``copies`` the rows with the same set of runs. ``text_key`` is
    xxhash64(text), which tells rows with equal ids apart; ``chosen`` marks the row
    that stands for its class, by the smallest id (each of them, if it repeats).
    """
    bands, rows = bands_for(threshold, recall)
    every = materialize(sketch(documents, n, bands, rows), "near-sketch")
    some = every.where("node IS NOT NULL")
    nodes = some.groupBy("node").agg(
        F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("one"),
        F.first("runs").alias("runs"),
    )
    nodes = materialize(nodes, "near-nodes")

    # candidates: every node hangs on the smallest node of each of its buckets
    keyed = some.select("node", F.posexplode("bands").alias("band", "value"))
    keyed = keyed.select("node", F.xxhash64("band", "value").alias("bucket"))
    hubs = keyed.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    stars = keyed.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = materialize(components(stars.distinct(), "near-candidates"), "near-groups")

    # full sets of candidates, from one of the texts of each
    wanted = groups.join(nodes, "node").select(
        F.col("node").alias("wanted"), "one.doc_id", F.col("one.text_key").alias("key"), "copies", F.col("root").alias("group"), "runs"
    )
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("key"))
    same = wanted["doc_id"].eqNullSafe(texts["doc_id"]) & (wanted["key"] == texts["key"])
    sets = run_sets(texts.join(wanted, same).select("wanted", "text"), n)
    # rows that repeat give the same set again
    sets = sets.groupBy("node").agg(F.first("set").alias("set"))
    members = sets.join(wanted.withColumnRenamed("wanted", "node").drop("doc_id", "key"), "node")
    members = members.withColumn("bytes", F.greatest(F.col("runs") * 8, F.lit(CHUNK_BYTES // CHUNK_MEMBERS)))
    counts, pairs = pairwise.link(
        members, "group", "node", "bytes", CHUNK_BYTES, lambda block: jaccard_links(block, threshold), "near-links"
    )

    classes = components(pairs, "near-classes")
    first = classes.join(nodes.select("node", "one"), "node").groupBy("root").agg(F.min("one").alias("first"))
    named = classes.join(first, "root").select("node", "first")
    facts = nodes.select("node", "copies", "one").join(counts, "node", "left").join(named, "node", "left")
    facts = facts.select(
        "node", "copies", F.coalesce("first", "one").alias("one"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = every.select("doc_id", "text_key", "node").join(facts, "node", "left")
    empty = F.col("node").isNull()
    return out.select(
        "doc_id",
        "text_key",
        F.when(empty, F.col("doc_id")).otherwise(F.col("one.doc_id")).alias("class_id"),
        F.when(empty, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(empty, 1).otherwise(F.col("copies")).cast("long").alias("copies"),
        (empty | F.struct(F.col("doc_id").isNull(), "doc_id", "text_key").eqNullSafe(F.col("one"))).alias("chosen"),
    )


def deduplicate(documents: DataFrame, **settings) -> DataFrame:
    """``documents`` with one row of each class, the one with the smallest id.

    Texts without words are in no class and all stay. The texts meet the
    decisions in one join by id and text hash; rows given several times are few
    keys, which get a join of their own.
    """
    key = F.xxhash64("text")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = join(documents.where(~wordless), **settings).where("chosen")
    keys = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count("*").alias("_rows"))
    keys = materialize(keys, "near-kept")

    def rows_of(part: DataFrame) -> DataFrame:
        texts = documents.where(~wordless)
        return texts.join(part, texts["doc_id"].eqNullSafe(part["_id"]) & (key == part["_key"]), "left_semi")

    once = rows_of(keys.where("_rows = 1"))
    again = rows_of(keys.where("_rows > 1")).dropDuplicates(["doc_id", "text"])
    return once.union(again).union(documents.where(wordless))
