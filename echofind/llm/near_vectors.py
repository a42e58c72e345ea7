"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors with equal labels are compared in blocks of bounded size. In a block the
vectors are sorted along many random directions; along each, a vector collides
with those in a window centred on it. A pair at the cosine threshold collides
with a known chance per direction, so the count that such a pair reaches with the
wanted recall is known too. Pairs that reach it are verified by their cosine in
double precision.

Equal vectors of a label are folded into one node with copies before anything is
compared. Blocks return counts and one link per vector; pairs are never listed.

Defined results: vectors that are NULL, empty, all zero, or hold NULLs or
non-finite values, and vectors without a label, link with nothing and are their
own component; vectors of different lengths never link; rows that repeat are
copies of each other; a NULL id is allowed (its component is named by the others,
else NULL); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofind.llm import pairwise
from echofind.llm.common import components
from echofind.session import materialize

#: Vectors in one chunk of a label; a block compares two chunks.
CHUNK = 1024
#: Pairs whose collisions are counted at a time.
TILE = 1 << 17


def calibrate(threshold: float, directions: int, recall: float, width: float = 2.5) -> tuple[float, int]:
    """Half the window, and the collisions that a pair at the threshold reaches with ``recall``.

    Along a standard normal direction such a pair's projections differ by a
    normal variable whose deviation is the pair's distance.
    """
    distance = math.sqrt(2 - 2 * threshold)
    chance = math.erf(width / math.sqrt(2))
    missed, need = 0.0, 0
    while need < directions:
        missed += math.comb(directions, need) * chance**need * (1 - chance) ** (directions - need)
        if missed > 1 - recall:
            break
        need += 1
    return width * distance, need


def _unit(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    """Each vector at unit length as packed doubles; None if it links with nothing."""
    lists = batch.column(column)
    out: list[bytes | None] = [None] * len(lists)
    values = np.asarray(lists.values.cast(pa.float64()).fill_null(float("nan")))
    offsets = np.asarray(lists.offsets)
    valid = np.asarray(lists.is_valid())
    for k in np.flatnonzero(valid & (np.diff(offsets) > 0)).tolist():
        vector = values[offsets[k] : offsets[k + 1]]
        most = np.abs(vector).max()
        if most > 0 and np.isfinite(most):
            vector = vector / most
            out[k] = (vector / math.sqrt(float(vector @ vector))).tobytes()
    return out


def collision_links(rows: pa.RecordBatch, threshold: float, directions: int, recall: float) -> np.ndarray:
    """Which vectors of a block have at least the threshold's cosine.

    Of a block of two chunks only pairs across them are looked at, the others have
    their own blocks. Along a direction, vectors stand at their places in order, and
    a window is a range of places, so a collision is one comparison of small numbers;
    counts are made for a few rows at a time.
    """
    vectors = [np.frombuffer(v.as_buffer(), np.float64) for v in rows.column(rows.schema.get_field_index("vector"))]
    x = np.stack(vectors)
    window, need = calibrate(threshold, directions, recall)
    lines = np.random.default_rng(97).standard_normal((x.shape[1], directions))
    n = len(x)
    small = np.uint16 if n <= np.iinfo(np.uint16).max else np.uint32
    place, low, wide = (np.empty((directions, n), small) for _ in range(3))
    for d, along in enumerate((x @ lines).T):
        order = np.argsort(along, kind="stable")
        ordered = along[order]
        place[d, order] = np.arange(n)
        low[d] = np.searchsorted(ordered, along - window, "left")
        wide[d] = np.searchsorted(ordered, along + window, "right") - low[d]
    linked = np.zeros((n, n), bool)
    left, every = _sides(rows)
    if len(every):
        step = max(1, TILE // len(every))
        for start in range(0, len(left), step):
            some = left[start : start + step]
            right = every[start:] if left is every else every  # a pair within a chunk is looked at once
            columns = place[:, right]
            count = np.zeros((len(some), len(right)), np.uint8 if directions < 256 else np.uint16)
            apart, hit = np.empty(count.shape, small), np.empty(count.shape, bool)
            for d in range(directions):
                np.subtract(columns[d], low[d, some, None], out=apart)  # below the window it wraps around
                np.less(apart, wide[d, some, None], out=hit)
                np.add(count, hit, out=count)
            a, b = np.nonzero(count >= need)
            a, b = some[a], right[b]
            a, b = a[a != b], b[a != b]
            for at in range(0, len(a), 1 << 16):
                p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                p, q = np.minimum(p, q), np.maximum(p, q)
                linked[p, q] |= np.einsum("ij,ij->i", x[p], x[q]) >= threshold
    return linked | linked.T


def _sides(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The places in a block that are compared: those of one chunk with those of the other."""
    names = rows.schema.names
    if "same" not in names or rows.column(names.index("same"))[0].as_py():
        every = np.arange(rows.num_rows)
        return every, every
    chunk = np.asarray(rows.column(names.index("chunk")))
    return np.flatnonzero(chunk == chunk[0]), np.flatnonzero(chunk != chunk[0])


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, directions: int = 48, recall: float = 0.999999
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows linked directly; ``component_id`` is the
    smallest id reachable over links.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def prepared(batches):
        for batch in batches:
            unit = _unit(batch, 1)
            labels = batch.column(2).to_pylist()
            group = [None if u is None or y is None else f"{len(u) // 8}:{y}" for u, y in zip(unit, labels)]
            unit = [u if g is not None else None for u, g in zip(unit, group)]
            node = [u and hashlib.blake2b(g.encode() + u, digest_size=16).digest() for u, g in zip(unit, group)]
            yield pa.record_batch(
                [batch.column(0), pa.array(group, pa.string()), pa.array(node, pa.binary()), pa.array(unit, pa.binary())],
                ["vec_id", "group", "node", "vector"],
            )

    every = vectors.select("vec_id", "embedding", "label").mapInArrow(
        prepared, f"vec_id {kind}, group string, node binary, vector binary"
    )
    every = materialize(every, "vectors")
    nodes = every.where("node IS NOT NULL").groupBy("node", "group")
    nodes = nodes.agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    nodes = materialize(nodes, "vector-nodes")
    counts, pairs = pairwise.link(
        nodes.withColumn("size", F.lit(0)),
        "group",
        "node",
        "size",
        CHUNK,
        lambda block: collision_links(block, threshold, directions, recall),
        "vector-links",
    )
    classes = components(pairs, "vector-classes")
    least = classes.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("first"))
    named = classes.join(least, "root").select("node", "first")
    facts = nodes.select("node", "copies", "least").join(counts, "node", "left").join(named, "node", "left")
    facts = facts.select(
        "node",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("first", "least").alias("component_id"),
    )
    out = every.select("vec_id", "node").join(facts, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
