"""Byte-level BPE: encoding by replaying merges over a corpus of words, and decoding.

Texts are cut into pieces by the tokenizer's pattern. A task gathers the distinct
pieces of up to ``CORPUS_BYTES`` of text and replays the merges on all of them
together: an inverted index leads from each mergeable pair (by its rank) to the
positions where it stands; the lowest rank there is comes next, all its positions
merge at once, and only the pairs beside them are looked up anew. Each text's ids
are then put together from its pieces. Nothing is shuffled, and memory is bounded
by the corpus size and the longest text.

Defined results: NULL counts as empty and gives no ids; rows are encoded one by
one, so repeated rows repeat; an empty table gives an empty result. Other columns
stay as they are; a column with the name of a result column is replaced.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from echofind.llm.common import blocks, span_hashes

#: Text whose distinct pieces one replay handles.
CORPUS_BYTES = 8 << 20
#: Text or ids that are worked on at a time.
STEP_BYTES = 1 << 19

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_held: dict = {}


def _classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    if "classes" not in _held:
        kinds = {"L": _LETTER, "N": _NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
        spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[spaces] = _SPACE
        _held["classes"] = table
    return _held["classes"]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of the pattern's matches, with the end of the data, and the first match of each row.

    The pattern: an apostrophe with s, t, re, ve, m, ll or d; else a run of
    letters, of numbers, or of other signs, each with one blank before it if there
    is one; else white space, leaving its last character to what follows.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    byte_at = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=byte_at[1:])
    row_at = np.searchsorted(byte_at, offsets)  # in code points
    kind = _classes()[code]
    space = kind == _SPACE
    new_row = np.zeros(n + 1, bool)
    new_row[row_at] = True
    run = np.ones(n + 1, bool)  # a run of one class starts here
    run[1:n] = (kind[1:] != kind[:-1]) | new_row[1:n]
    start = run.copy()
    # the last white space of a run before something else stands alone or goes with what follows
    last = np.flatnonzero(space & run[1:] & ~new_row[1:])
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    # an apostrophe alone in its run, that took no blank with it, may start a contraction
    quote = np.flatnonzero((code == 39) & start[:n] & run[:n] & run[1:] & ~new_row[1:])
    if len(quote):
        near = np.append(code, [0, 0, 0])
        first, second = near[quote + 1], near[quote + 2]
        joined = ~new_row[np.minimum(quote + 2, n)]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = joined & np.isin(first * 128 + np.minimum(second, 127), [ord(a) * 128 + ord(b) for a, b in ("re", "ve", "ll")])
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    start[n] = True
    at = np.flatnonzero(start)
    return byte_at[at], np.searchsorted(at, row_at)


class Ranks:
    """The vocabulary of a rank file, ready for replays."""

    def __init__(self, text: bytes):
        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)}
        self.size = max(tokens.values()) + 1
        self.byte = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                left, right = tokens.get(token[:cut]), tokens.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        length = np.zeros(self.size + 1, np.int64)
        for token, rank in tokens.items():
            length[rank + 1] = len(token)
        self.at = np.cumsum(length)
        whole = [b""] * self.size
        for token, rank in tokens.items():
            whole[rank] = token
        self.bytes = np.frombuffer(b"".join(whole), np.uint8)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair merges into, or -1."""
        key = left * np.int64(self.size) + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], np.int32(-1))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the offsets of each row's bytes."""
        size = self.at[ids + 1] - self.at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(ends[-1]) + np.repeat(self.at[ids] - ends[:-1], size)
        return self.bytes[take], ends[first]


def replay(data: np.ndarray, first: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Merge words, given as bytes with offsets: all ids, and the first id of each word."""
    n = len(data)
    ids = ranks.byte[data]
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    after[first[1:][np.diff(first) > 0] - 1] = -1
    before[first[:-1][np.diff(first) > 0]] = -1
    alive = np.ones(n, bool)
    here = np.full(n, -1, np.int32)  # rank of the pair that starts at a position
    paired = np.flatnonzero(after >= 0).astype(np.int32)
    here[paired] = ranks.look_up(ids[paired], ids[paired + 1])

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def post(at: np.ndarray) -> None:
        """Enter positions into the inverted index."""
        rank = here[at]
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        edges = [0, *cuts.tolist(), len(at)]
        for a, b, r in zip(edges, edges[1:], rank[edges[:-1]].tolist()):
            if r not in index:
                index[r] = []
                heapq.heappush(queue, r)
            index[r].append(at[a:b])

    post(paired)
    while queue:
        rank = heapq.heappop(queue)
        found = index.pop(rank)
        at = np.concatenate(found) if len(found) > 1 else found[0]
        at = np.unique(at[here[at] == rank])
        if not len(at):
            continue
        right = after[at]
        if len(at) > 1:  # of pairs that overlap, every other one from the left
            tied = right[:-1] == at[1:]
            if tied.any():
                place = np.arange(len(at))
                head = np.maximum.accumulate(np.where(np.concatenate([[True], ~tied]), place, 0))
                at = at[(place - head) % 2 == 0]
                right = after[at]
        then = after[right]
        ids[at] = rank
        after[at] = then
        alive[right] = False
        here[right] = -1
        inner = then >= 0
        before[then[inner]] = at[inner]
        here[at] = -1
        here[at[inner]] = ranks.look_up(ids[at[inner]], ids[then[inner]])
        left = before[at]
        left = left[left >= 0]
        here[left] = ranks.look_up(ids[left], ids[after[left]])
        post(np.union1d(at, left))
    kept = np.concatenate([[0], np.cumsum(alive)])
    return ids[alive], kept[first]


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which byte strings stand for all their like, and for each string the number of the one that does.

    Strings are grouped by hash and then compared byte by byte with the first of
    their group; should two differ, all are told apart by their bytes.
    """
    _, where, place = np.unique(span_hashes(data, starts, starts + sizes), return_index=True, return_inverse=True)
    like = where[place]
    if (sizes == sizes[like]).all() and (_gather(data, starts, sizes) == _gather(data, starts[like], sizes)).all():
        return where, place
    raw, numbers = data.tobytes(), {}
    place = np.array([numbers.setdefault(raw[a : a + n], len(numbers)) for a, n in zip(starts.tolist(), sizes.tolist())])
    return np.unique(place, return_index=True)[1], place


class _Corpus:
    """Rows waiting for their replay."""

    def __init__(self):
        self.parts, self.bytes = [], 0

    def add(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        at, first = pieces(data, offsets)
        size = np.diff(at)
        where, place = distinct(data, at[:-1], size)
        self.parts.append((rows, first, place.astype(np.int32), size[where], _gather(data, at[where], size[where])))
        self.bytes += len(data)

    def encode(self, ranks: Ranks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """The rows, all their ids, and the first id of each row."""
        sizes = np.concatenate([p[3] for p in self.parts])
        held = np.concatenate([p[4] for p in self.parts])
        starts = np.cumsum(sizes) - sizes
        where, number = distinct(held, starts, sizes)
        words = _gather(held, starts[where], sizes[where])
        ids, first_id = replay(words, np.concatenate([[0], np.cumsum(sizes[where])]), ranks)
        count = np.diff(first_id)
        done = 0
        for rows, first, place, own, _ in self.parts:
            word = number[done : done + len(own)][place]
            done += len(own)
            made = np.concatenate([[0], np.cumsum(count[word])])
            yield rows, _gather(ids, first_id[word], count[word]), made[first]


def _shared_ranks(spark: SparkSession, path: str) -> Callable[[], Ranks]:
    """The vocabulary for tasks: the driver reads the file, its size is that of the vocabulary."""
    with open(path, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    def ranks() -> Ranks:
        if path not in _held:
            _held[path] = Ranks(sent.value)
        return _held[path]

    return ranks


def _packed(documents: DataFrame, column: str, made: list[str]) -> tuple[DataFrame, list[str]]:
    kept = [c for c in documents.columns if c.lower() not in made]
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{column}`").alias("text")), kept


def _cut(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())


def encode(documents: DataFrame, path: str, check: bool = False) -> DataFrame:
    """``documents`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers) of ``text``.

    With ``check`` the ids are decoded again in the same visit to Python, into
    ``decoded``.
    """
    ranks = _shared_ranks(documents.sparkSession, path)
    made = ["n_tokens", "ids", "decoded"][: 2 + check]
    packed, kept = _packed(documents, "text", made)
    kinds = (LongType(), BinaryType(), BinaryType())
    schema = StructType([packed.schema["row"], *[StructField(n, k) for n, k in zip(made, kinds)]])

    def encoded(batches):
        def flush(corpus):
            for rows, ids, first in corpus.encode(ranks()):
                columns = [rows.column(0), pa.array(np.diff(first)), _cut(ids.astype("<u4").view(np.uint8), first * 4)]
                if check:
                    columns.append(_cut(*ranks().decode(ids, first)))
                yield pa.record_batch(columns, ["row", *made])

        corpus = _Corpus()
        for rows, data, offsets in blocks(batches, limit=STEP_BYTES):
            corpus.add(rows, data, offsets)
            if corpus.bytes >= CORPUS_BYTES:
                yield from flush(corpus)
                corpus = _Corpus()
        if corpus.parts:
            yield from flush(corpus)

    out = packed.mapInArrow(encoded, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *made)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that ``ids`` stand for."""
    ranks = _shared_ranks(encoded.sparkSession, path)
    packed, kept = _packed(encoded, "ids", ["decoded"])
    schema = StructType([packed.schema["row"], StructField("decoded", BinaryType())])

    def decoded(batches):
        for rows, data, offsets in blocks(batches, limit=STEP_BYTES):
            made = ranks().decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), offsets // 4)
            yield pa.record_batch([rows.column(0), _cut(*made)], ["row", "decoded"])

    out = packed.mapInArrow(decoded, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "decoded")
