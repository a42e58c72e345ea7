"""A learnt embedder: latent semantic analysis by a randomised SVD.

Words that stand in the same texts come to lie near each other, so a query finds texts
that do not share its words. Words are hashed to ``features`` signed slots, weighed by
log(1 + count) times the slot's inverse document frequency, and texts are projected on
the leading right singular vectors of the weighed matrix A.

Document frequencies come from all texts, in one pass. The vectors come from two passes
of a range finder, AᵀA·Ω and AᵀA·Q, over the texts lowest by hash, about ``sample`` of
them at most (a documented bound; every text is embedded in any case). A pass runs in
``PARTS`` tasks, each of which holds one matrix of features x (dim + ``EXTRA``) and
leaves its sums by feature; the driver gets one such matrix and factors it. Texts reach
the passes as sparse rows, at most ``features`` values each; those of a task are fixed by
hash and sorted, so the same texts give the same vectors.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofind.functions.embed import _WORD, HashEmbedder
from echofind.functions.vectors import matrix
from echofind.operators.ann import _share
from echofind.schemas import DIMENSION
from echofind.session import materialize

FEATURES = 8192
SAMPLE = 200_000
EXTRA = 16
PARTS = 32
#: Texts multiplied at once.
_BLOCK = 128


class LsaEmbedder:
    """Texts projected on ``basis`` (features x dim), unit length; a text without known words is zero."""

    def __init__(self, weights: np.ndarray, basis: np.ndarray):
        self.dim = basis.shape[1]
        self.name = f"lsa-{self.dim}"
        self.weights, self.basis = weights, basis
        self._slots = HashEmbedder(len(weights))

    def encode(self, texts: list[str]) -> np.ndarray:
        parts = [np.zeros((0, self.dim))]
        for block, used in _blocks([_weighed(t, self._slots, self.weights) for t in texts]):
            parts.append(block @ self.basis[used])
        vectors = np.concatenate(parts)
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 1e-9).astype(np.float32)


def train_lsa(
    texts: DataFrame, column: str = "cleaned_text", dim: int = DIMENSION, features: int = FEATURES, sample: int = SAMPLE
) -> LsaEmbedder:
    """An embedder learnt from a column of texts; NULL reads as ''.

    With fewer independent texts than ``dim`` the last values of a vector are zero.
    Without any word all vectors are zero.
    """
    if not 1 <= dim <= features:
        raise ValueError("dim must lie between 1 and the number of features")
    rows = texts.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    slots = HashEmbedder(features)
    total, counts = _frequencies(rows, slots)
    weights = np.where(counts > 0, np.log((1.0 + total) / (1.0 + counts)) + 1.0, 0.0)
    mark = F.xxhash64("text")
    if total > sample:
        # the upper 40 bits of the hash, as a share of their range; copies go in or stay out together
        rows = rows.where(F.pmod(F.shiftright(mark, 24), F.lit(1 << 40)) < int((1 << 40) * (sample / total)))
    # copies are weighed once; a row has at most a value per slot, however long its text
    copies = rows.groupBy("text").agg(F.count("*").alias("copies")).withColumn("mark", mark)
    dealt = copies.mapInArrow(_rows_of(slots, weights), "mark bigint, copies bigint, slots array<bigint>, weighed array<double>")
    dealt = dealt.repartition(PARTS, "mark")
    training = materialize(dealt.withColumn("part", F.spark_partition_id()), "lsa")
    width = min(dim + EXTRA, features)
    start = np.random.default_rng(0).standard_normal((features, width))
    base = np.linalg.qr(_pass(training, start))[0]
    inner = base.T @ _pass(training, base)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:dim]
    basis = base @ vectors[:, order]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)
    basis[:, values[order] <= 1e-9 * max(values.max(), 0.0)] = 0.0
    return LsaEmbedder(weights.astype(np.float32), basis.astype(np.float32))


def _frequencies(rows: DataFrame, slots: HashEmbedder) -> tuple[int, np.ndarray]:
    """The number of texts, and of texts per slot: one row per slot and task is shuffled."""
    features = slots.dim

    def count(batches):
        found, texts = np.zeros(features, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                texts += 1
                words = set(_WORD.findall(text.lower()))
                found[list({(slots._slots.get(w) or slots._slot(w))[0] for w in words})] += 1
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"slot": np.append(used, -1), "n": np.append(found[used], texts)})

    sums = rows.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    place, n = sums["slot"].to_numpy(), sums["n"].to_numpy()
    counts = np.zeros(features)
    counts[place[place >= 0]] = n[place >= 0]
    return int(n[place < 0].sum()), counts


def _rows_of(slots: HashEmbedder, weights: np.ndarray):
    def weigh(batches):
        for batch in batches:
            rows = [_weighed(t, slots, weights) for t in batch.column("text").to_pylist()]
            arrays = [batch.column("mark"), batch.column("copies"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["mark", "copies", "slots", "weighed"])

    return weigh


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of an Arrow list column."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), (ends - ends[0])[1:-1])


def _pass(training: DataFrame, right: np.ndarray) -> np.ndarray:
    """AᵀA·right, by sums per part and then per feature, always in the same order."""
    shared = _share(right)
    features, width = right.shape

    def multiply(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("mark")
        total = np.zeros((features, width))
        copies, done = rows["copies"].to_numpy(), 0
        sparse = list(zip(_arrays(rows["slots"]), _arrays(rows["weighed"])))
        for block, used in _blocks(sparse):
            times = copies[done : done + len(block), None]
            total[used] += block.T @ (times * (block @ shared.value[used]))
            done += len(block)
        kept = np.flatnonzero(total.any(axis=1))
        part = np.full(len(kept), rows["part"][0].as_py(), np.int32)
        return pa.table({"slot": kept, "part": part, "total": _lists(total[kept])})

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("slot", "ascending"), ("part", "ascending")])
        place, first = np.unique(rows["slot"].to_numpy(), return_index=True)
        return pa.table({"slot": place, "total": _lists(np.add.reduceat(matrix(rows["total"]), first, axis=0))})

    sums = training.groupBy("part").applyInArrow(multiply, "slot bigint, part int, total array<double>")
    # a group is a few hundred slots: at most PARTS rows for each
    sums = sums.groupBy(F.expr("slot div 256")).applyInArrow(add, "slot bigint, total array<double>").toArrow()
    product = np.zeros((features, width))
    if sums.num_rows:
        product[sums["slot"].to_numpy()] = matrix(sums["total"])
    return product


def _weighed(text: str, slots: HashEmbedder, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text's row, of unit length."""
    row: dict[int, float] = {}
    for word, n in sorted(Counter(_WORD.findall(text.lower())).items()):
        slot, sign = slots._slots.get(word) or slots._slot(word)
        row[slot] = row.get(slot, 0.0) + sign * np.log1p(n) * float(weights[slot])
    values = np.array(list(row.values()))
    length = np.linalg.norm(values) if len(values) else 0.0
    return np.array(list(row), np.int64), values / length if length else values


def _blocks(rows):
    """(matrix of some rows x the slots they use, those slots)."""
    for first in range(0, len(rows), _BLOCK):
        some = rows[first : first + _BLOCK]
        used, place = np.unique(np.concatenate([slots for slots, _ in some]), return_inverse=True)
        block = np.zeros((len(some), len(used)))
        block[np.repeat(np.arange(len(some)), [len(slots) for slots, _ in some]), place] = np.concatenate([v for _, v in some])
        yield block, used


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
