"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's own features and those of the
lines beside it feed the chain's unary scores, a 2 x 2 table the transitions.
Forward-backward gives each line's probability of being good; a document's score
is their mean, weighted by line length.

The field is fitted on a sample of labelled documents of at most
``sample_documents`` rows: its lines take the document's label. Everything else
runs over all rows, and only byte sums per line, so a text of any length costs
time and memory in proportion to its bytes.

Defined results: a NULL or empty text is one empty line; rows are scored one by
one, so repeated rows get the same score; without usable labels every score is
the neutral 0.5; labels that contradict each other count as bad.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from echofind.llm.common import blocks, mix, span_hashes, words

#: Upper edges of the bins of each line feature; a value falls into one bin.
BINS = {
    "symbols": (0.002, 0.01, 0.03, 0.08, 0.2),  # of #$%&*!|<>{}[]\^~=_ among bytes
    "upper": (0.02, 0.08, 0.2, 0.5, 0.8),  # capitals among letters
    "digits": (0.002, 0.02, 0.1, 0.3),
    "stops": (0.001, 0.01, 0.03, 0.08),  # . , ; : ? among bytes
    "word_bytes": (2.0, 3.5, 4.5, 5.5, 7.0, 9.0, 14.0),
    "words": (0.5, 1.5, 3.5, 8.5, 20.5, 60.5),
    "pairs": (0.001, 0.05, 0.3),  # words equal to the one before
    "known": (0.02, 0.1, 0.25, 0.5, 0.8),  # word triples that the text has had before
    "again": (0.5, 1.5, 4.5),  # other lines of the text that are the same
    "lines": (1.5, 3.5, 8.5, 20.5, 80.5),
}
WIDTH = max(len(edges) for edges in BINS.values()) + 1
FEATURES = len(BINS)


def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)) | (code >= 0xC2)
    return {
        "symbol": np.isin(code, list(b"#$%&*!|<>{}[]\\^~=_")),
        "upper": (code >= 65) & (code <= 90),
        "letter": letter,
        "digit": (code >= 48) & (code <= 57),
        "stop": np.isin(code, list(b".,;:?")),
    }


_CLASSES = _classes()


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: how often it occurs, and whether an equal one stands before it."""
    _, first, where, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return count[where], first[where] < np.arange(len(keys))


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (lines x features), line lengths, and the first line of each row."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(rows), row_of_break])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(rows + 1))
    ends = np.append(starts[1:] - 1, len(data))
    ends[first[1:] - 1] = offsets[1:]
    length = ends - starts
    size = np.maximum(length, 1)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[ends] - sums[starts]

    counts = {name: total(table[data]) for name, table in _CLASSES.items()}
    word_start, word_end, word_first = words(data, offsets)
    low, high = np.searchsorted(word_start, starts), np.searchsorted(word_start, ends)
    n_words = high - low
    hashes = span_hashes(data, word_start, word_end)
    word_row = np.repeat(np.arange(rows), np.diff(word_first))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    triple = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        key = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)
        key = mix(key + word_row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        triple[:-2] = _repeats(key)[1]

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[high] - sums[low]) / np.maximum(n_words, 1)

    bytes_of = np.concatenate([[0], np.cumsum(word_end - word_start)])
    line_key = mix(span_hashes(data, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    equal = np.where(length > 0, _repeats(line_key)[0] - 1, 0)
    values = {
        "symbols": counts["symbol"] / size,
        "upper": counts["upper"] / np.maximum(counts["letter"], 1),
        "digits": counts["digit"] / size,
        "stops": counts["stop"] / size,
        "word_bytes": (bytes_of[high] - bytes_of[low]) / np.maximum(n_words, 1),
        "words": n_words,
        "pairs": share(same),
        "known": share(triple),
        "again": equal,
        "lines": np.diff(first)[owner],
    }
    bins = np.stack([np.searchsorted(BINS[k], v, "right") for k, v in values.items()], 1).astype(np.uint8)
    return bins, length, first


def _unary(bins: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of good over bad per line, from the line and those beside it."""
    picked = [weights[k][np.arange(FEATURES), bins].sum(1) for k in range(3)]
    score = picked[0].copy()
    inner = np.ones(len(bins), bool)
    inner[first[:-1]] = False
    score[inner] += picked[1][np.flatnonzero(inner) - 1]  # the line before
    has_next = np.ones(len(bins), bool)
    has_next[first[1:] - 1] = False
    score[has_next] += picked[2][np.flatnonzero(has_next) + 1]
    return score


def _steps(first: np.ndarray) -> Iterator[np.ndarray]:
    """Line numbers by position: first lines of all chains, then second lines, ..."""
    size = np.diff(first)
    chains = np.argsort(-size, kind="stable")
    at, left = first[:-1][chains], size[chains]
    for t in range(int(size.max(initial=0))):
        yield at[: np.searchsorted(-left, -t)] + t


def marginals(score: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good per line, expected transitions and the log of the partition sum.

    States: 0 bad, 1 good. ``moves`` holds the transition scores.
    """
    emit = np.stack([np.zeros_like(score), score], 1)
    forward, backward = emit.copy(), np.zeros_like(emit)
    steps = list(_steps(first))
    for before, at in zip(steps, steps[1:]):
        here = forward[before[: len(at)]]
        forward[at] += np.logaddexp(here[:, :1] + moves[0], here[:, 1:] + moves[1])
    for at, after in zip(reversed(steps[:-1]), reversed(steps[1:])):
        then = emit[after] + backward[after]
        backward[at[: len(after)]] = np.logaddexp(then[:, :1] + moves[:, 0], then[:, 1:] + moves[:, 1])
    last = first[1:] - 1
    whole = np.logaddexp(forward[last, 0], forward[last, 1])
    chain = np.repeat(np.arange(len(first) - 1), np.diff(first))
    both = forward + backward
    good = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
    inner = np.ones(len(score), bool)
    inner[last] = False
    a = np.flatnonzero(inner)
    joint = forward[a][:, :, None] + moves + (emit[a + 1] + backward[a + 1])[:, None, :] - whole[chain[a]][:, None, None]
    return good, np.exp(joint).sum(0), float(whole.sum())


def fit(samples: list[tuple[np.ndarray, int]], rounds: int = 120, shrink: float = 0.3) -> dict:
    """Weights by gradient ascent (Adam) on the chains' log likelihood.

    ``samples``: bins of a document's lines, and its label.
    """
    weights, moves, bias = np.zeros((3, FEATURES, WIDTH)), np.zeros((2, 2)), np.zeros(1)
    if not samples:
        return {"weights": weights, "moves": moves, "bias": bias}
    bins = np.concatenate([b for b, _ in samples])
    first = np.concatenate([[0], np.cumsum([len(b) for b, _ in samples])])
    chain = np.repeat(np.arange(len(samples)), np.diff(first))
    label = np.array([y for _, y in samples])[chain]
    share = np.bincount([y for _, y in samples], minlength=2) * 2 / len(samples)
    # a document counts once, however many lines it has, and both labels weigh the same
    each = 1.0 / (np.diff(first)[chain] * share[label])
    before = np.concatenate([[False], chain[1:] == chain[:-1]])
    after = np.concatenate([chain[1:] == chain[:-1], [False]])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][after[:-1]], label[1:][after[:-1]]), each[:-1][after[:-1]])
    state = [np.zeros(p.shape) for p in (weights, moves, bias) for _ in range(2)]
    slot = np.arange(FEATURES) * WIDTH + bins
    for turn in range(1, rounds + 1):
        good, _, _ = marginals(_unary(bins, first, weights) + bias[0], first, moves)
        gap = (label - good) * each

        def push(rows: np.ndarray, pulled: np.ndarray) -> np.ndarray:
            spread = np.repeat(pulled, FEATURES)
            return np.bincount(slot[rows].ravel(), spread, FEATURES * WIDTH).reshape(FEATURES, WIDTH)

        step_w = np.stack([push(np.arange(len(bins)), gap), push(np.flatnonzero(before) - 1, gap[before]), push(np.flatnonzero(after) + 1, gap[after])])
        pair = np.stack([(1 - good), good], 1)
        joint = np.einsum("na,nb,n->ab", pair[:-1][after[:-1]], pair[1:][after[:-1]], each[:-1][after[:-1]])
        step_m = seen - joint
        for k, (held, step) in enumerate(((weights, step_w - shrink * weights), (moves, step_m - shrink * moves), (bias, np.array([gap.sum()])))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (step - m)
            v += 0.01 * (step * step - v)
            held += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return {"weights": weights, "moves": moves, "bias": bias}


def score_rows(data: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    bins, length, first = line_features(data, offsets)
    good, _, _ = marginals(_unary(bins, first, model["weights"]) + model["bias"][0], first, model["moves"])
    weight = length + 1.0  # an empty line still counts a little
    sums = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    return np.clip(sums, 0.0, 1.0)


def train(documents: DataFrame, labels: DataFrame, sample_documents: int = 4000) -> dict:
    """Fit the field on at most ``sample_documents`` labelled documents.

    ``labels``: doc_id and quality. The sample is the smallest by a hash of the
    id, and the driver gets a few bytes per line of it.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("label"))
    )
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_documents)
    # the sample is bounded, so it may be broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def features(batches):
        for rows, data, offsets in blocks(batches):
            bins, _, first = line_features(data, offsets)
            cut = [bins[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.record_batch([rows.column(0).cast(pa.int32()), pa.array(cut, pa.binary())], ["label", "bins"])

    found = texts.mapInArrow(features, "label int, bins binary").toArrow()
    samples = sorted(zip(found["bins"].to_pylist(), found["label"].to_pylist()))
    return fit([(np.frombuffer(b, np.uint8).reshape(-1, FEATURES), y) for b, y in samples])


def score(documents: DataFrame, model: dict, into: str = "score") -> DataFrame:
    """``documents`` with the quality of each text, 0 to 1, in column ``into`` (replaced if there)."""
    kept = [c for c in documents.columns if c.lower() != into.lower()]
    # one struct holds the row, whatever its columns are called
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text"))
    schema = StructType([packed.schema["row"], StructField("score", DoubleType())])

    def scored(batches):
        for rows, data, offsets in blocks(batches):
            yield pa.record_batch([rows.column(0), pa.array(score_rows(data, offsets, model))], ["row", "score"])

    out = packed.mapInArrow(scored, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.col("score").alias(into))
