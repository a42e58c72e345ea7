"""What the operators of this folder share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from echofind.operators.components import components  # noqa: F401  (shared with the modules here)

#: Text bytes that numpy code works on at a time; one longer text is a block of its own.
BLOCK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut so that each holds about ``limit`` bytes of text.

    Yields the rows, their UTF-8 bytes and the offsets of each row's bytes. A
    NULL text counts as empty.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
        start = 0
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else []
        ends = np.cumsum(sizes)
        while start < len(texts):
            gone = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, gone + limit, "right")))
            part = texts.slice(start, stop - start)
            offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
            held = part.buffers()[2]
            data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
            yield batch.slice(start, stop - start), data[offsets[0] : offsets[-1]], offsets - offsets[0]
            start = stop


_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run without ASCII white space), and the first word of each row."""
    solid = _NOT_SPACE[data]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[filled] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[filled[1:] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(_BASE))


_values: dict[int, np.ndarray] = {}


def prefix_sums(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Running sums from which ``sum_hashes`` gets the hash of any byte span."""
    values = _values.setdefault(seed, _byte_values(seed))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power(_BASE, len(data)), out=sums[1:])
    return sums


def sum_hashes(sums: np.ndarray, starts, ends) -> np.ndarray:
    """64-bit hash of each span (by arrays or slices of ends), the same wherever the bytes stand."""
    return mix((sums[ends] - sums[starts]) * _power(_UNBASE, len(sums))[starts])


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of a cryptographic hash of each byte span."""
    raw, key = data.tobytes(), seed.to_bytes(8, "little")
    found = [hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(starts.tolist(), ends.tolist())]
    return np.frombuffer(b"".join(found), np.uint64)


#: Spans of so many bytes are not hashed by running sums, which some long regular strings share.
LONG_SPAN = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span."""
    hashes = sum_hashes(prefix_sums(data, seed), starts, ends)
    long = np.flatnonzero(ends - starts >= LONG_SPAN)
    if len(long):
        hashes[long] = digests(data, starts[long], ends[long], seed)
    return hashes


def shingles(data: np.ndarray, offsets: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words, and the first run of each row.

    A text with fewer words, but at least one, is a single run; runs stand in
    text order and repeat as in the text.
    """
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    runs = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    edges = np.concatenate([[0], np.cumsum(runs)])
    if not len(starts):
        return np.zeros(0, np.uint64), edges
    hashes = span_hashes(data, starts, ends, seed)
    at = np.arange(edges[-1]) + np.repeat(first[:-1] - edges[:-1], runs)
    last = np.repeat(first[1:], runs)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        word = hashes[np.minimum(at + k, len(hashes) - 1)]
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(at + k < last, word, np.uint64(k + 1))
    return mix(out), edges
