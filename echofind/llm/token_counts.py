"""Token counts by a byte-level BPE vocabulary, with a shortcut for whole tokens.

Once per job the driver proves, for every string of the vocabulary, whether it
encodes alone as one token, by merging its bytes under the vocabulary's own merges.
Tasks cut texts into pre-tokens by the tokenizer's pattern; one that is such a string
counts as one token at sight, and only the rest are merged, each distinct one once as
long as it is remembered. What is sent to tasks has the size of the vocabulary;
memory is bounded by a block of about 2 MB (or one longer text), ``REMEMBERED``
characters of merged pre-tokens, and some 60 bytes a byte of the longest pre-token.

Strings of special tokens inside a text count as one token each and part the text, as
the tokenizer's library does by default.

Defined results: NULL counts as empty, and an empty text has no tokens; rows are
counted one by one, so rows that repeat repeat; an empty table gives an empty result.
Other columns travel in ``row``, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from echofind.llm.common import blocks

#: Characters of merged pre-tokens that a task remembers.
REMEMBERED = 8_000_000
#: Bytes of a pre-token up to which its next merge is found by looking at all its pairs.
SHORT = 48
#: Texts with more characters are cut into pre-tokens one by one.
LONG = 1 << 20

# The byte-level tokenizers' pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters and numbers that are newer than Unicode 16, which the
# tokenizers' library takes for other signs.
NEW_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: Bytes that begin no character from the first of these letters on.
_LOW = bytes(range(0xD5))


def _new_letters() -> str:
    """``NEW_LETTERS`` as the inside of a character class."""
    return "".join("-".join(f"\\U{int(end, 16):08x}" for end in run.split("-")) for run in NEW_LETTERS.split())


def _strict_pattern() -> str:
    """``PATTERN`` with the new letters among the other signs."""
    new = f"[{_new_letters()}]"
    other = rf"[[^\s\p{{L}}\p{{N}}]||{new}]"
    known = PATTERN.replace(r"[^\s\p{L}\p{N}]", "@").replace(r"\p{L}", rf"[\p{{L}}--{new}]").replace(r"\p{N}", rf"[\p{{N}}--{new}]")
    return "(?V1)" + known.replace("@", other)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges of a tokenizer file (JSON) and the strings proved to be whole tokens."""

    def __init__(self, text: str):
        file = json.loads(text)
        model, cut = file["model"], file["pre_tokenizer"] or {}
        added = file["added_tokens"]
        unknown = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if (
            model.get("type") != "BPE"
            or any(model.get(k) for k in unknown)
            or file["normalizer"]
            or cut.get("type") != "ByteLevel"
            or cut.get("add_prefix_space")
            or not cut.get("use_regex", True)
            or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        ):
            raise ValueError("only plain byte-level BPE tokenizers are handled")
        letters = _byte_letters()
        ids = model["vocab"]
        self.byte = [0] * 256
        for letter, byte in letters.items():
            self.byte[byte] = ids[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: when a pair of ids merges, and what each merge makes
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.special = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        self.whole = self._prove({v: bytes(letters[c] for c in k) for k, v in ids.items() if set(k) <= letters.keys()})

    def _prove(self, strings: dict[int, bytes]) -> list[str]:
        """The strings that merge into one token, their own."""
        proved = []
        for token, raw in strings.items():
            if self.merge(raw) == [token]:
                try:
                    proved.append(raw.decode())
                except UnicodeDecodeError:  # no pre-token is a part of a character
                    pass
        return proved

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the lowest merge first, of equal ones the leftmost."""
        if len(piece) > SHORT:
            return self._merge_long(piece)
        never, rank = len(self.made), self.ranks.get
        ids = [self.byte[b] for b in piece]
        ranks = [rank(pair, never) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i] = self.made[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), never)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), never)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a queue of merges, so that time grows little more than the length."""
        rank, n = self.ranks.get, len(piece)
        ids = array("q", [self.byte[b] for b in piece])
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        queue = [(least, i) for i in range(n - 1) if (least := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            least, i = heapq.heappop(queue)
            j = after[i]
            if j >= n or ids[i] < 0 or rank((ids[i], ids[j])) != least:  # one of the two has merged since
                continue
            ids[i], ids[j], then = self.made[least], -1, after[j]
            after[i] = then
            if then < n:
                before[then] = i
                if (following := rank((ids[i], ids[then]))) is not None:
                    heapq.heappush(queue, (following, i))
            if before[i] >= 0 and (preceding := rank((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(queue, (preceding, before[i]))
        return [t for t in ids if t >= 0]


class Counter(dict):
    """Tokens of a pre-token: 1 for whole tokens, looked up; merged for the rest."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.vocabulary, self.room = vocabulary, REMEMBERED
        self.pattern, self.strict = regex.compile(PATTERN), regex.compile(_strict_pattern())
        self.new = re.compile(f"[{_new_letters()}]")
        self.special = re.compile("|".join(map(re.escape, vocabulary.special))) if vocabulary.special else None

    def __missing__(self, piece: str) -> int:
        n = len(self.vocabulary.merge(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= REMEMBERED >> 8:
            self.room -= len(piece) + 8
            if self.room < 0:
                self.clear()
                self.update(dict.fromkeys(self.vocabulary.whole, 1))
                self.room = REMEMBERED
            self[piece] = n
        return n

    def count(self, raw: bytes) -> int:
        """Tokens of a text, its special strings included."""
        text = raw.decode("utf-8", "surrogatepass")
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        may_be_new = raw.translate(None, _LOW) != b""
        for part in parts:
            pattern = self.strict if may_be_new and self.new.search(part) else self.pattern
            found = pattern.findall(part) if len(part) <= LONG else (m.group() for m in pattern.finditer(part))
            total += sum(map(self.__getitem__, found))
        return total


_held: dict = {}


def _shared_counter(spark: SparkSession, path: str) -> Callable[[], Counter]:
    """The counter for tasks; the driver reads the file and proves its whole tokens."""
    with open(path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(Vocabulary(file.read()))

    def counter() -> Counter:
        if path not in _held:
            _held[path] = Counter(sent.value)
        return _held[path]

    return counter


def count(documents: DataFrame, path: str, carry: list[str] | None = None, limit: int = 1024) -> DataFrame:
    """``row`` (the columns ``carry``, or all), ``n_bytes``, ``n_tokens`` and ``over_limit`` of each text."""
    counter = _shared_counter(documents.sparkSession, path)
    kept = documents.columns if carry is None else carry
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text"))
    made = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    schema = StructType([packed.schema["row"], *made])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            text, edges = data.tobytes(), offsets.tolist()
            tokens = [counter().count(text[a:b]) for a, b in zip(edges, edges[1:])]
            sizes = [b - a for a, b in zip(edges, edges[1:])]
            yield pa.record_batch([rows.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["row", "n_bytes", "n_tokens"])

    return packed.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
