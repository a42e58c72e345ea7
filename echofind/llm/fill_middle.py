"""Fill-in-middle: texts cut in three and put together in another order, and back.

Cuts fall after units: lines (a line keeps its line break) or code points. A text is
handled as its UTF-8 bytes with a sparse index of exceptions: only characters of more
than one byte are recorded, by place and by their excess bytes. A code-point cut
becomes a byte cut, or a byte cut a code-point count, by one binary search in that
index; what lies between exceptions is plain arithmetic, and a text in ASCII has an
empty index. Texts are worked on in blocks of about 2 MB, or one longer text, inside
the task that reads them; nothing is shuffled.

Where a text is cut, and which form it takes, comes from a hash of its id, so reruns
agree.

Defined results: NULL counts as empty; an empty text, one that holds a mark, and one
that the rate leaves out stay plain (their numbers of characters are NULL); a NULL id
hashes as nothing after the colon; rows are cut one by one, so rows that repeat
repeat; an empty table gives an empty result. Other columns travel in ``row``, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from echofind.llm.common import blocks

#: Marks that stand before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("line", "character")


class Exceptions:
    """The characters of more than one byte in some UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        lead = data >= 0xC0
        self.byte = np.flatnonzero(lead)
        first = data[self.byte]
        #: excess bytes of all exceptions before the i-th one
        self.excess = np.zeros(len(first) + 1, np.int64)
        np.cumsum(1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0), out=self.excess[1:])
        self.point = self.byte - self.excess[:-1]

    def points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte cut."""
        return cuts - self.excess[np.searchsorted(self.byte, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return cuts + self.excess[np.searchsorted(self.point, cuts)]


class Lines:
    """Line units of each row; the last one may lack its line break."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, index: Exceptions):
        self.offsets, self.ends = offsets, np.flatnonzero(data == 10) + 1
        self.first = np.searchsorted(self.ends, offsets, "right")
        whole = np.diff(self.first)
        last = np.zeros(len(whole), bool)
        filled = np.diff(offsets) > 0
        last[filled] = data[offsets[1:][filled] - 1] != 10
        self.whole, self.count = whole, whole + last

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Byte after so many units of each row."""
        if not len(self.ends):
            return np.where(units > 0, self.offsets[1:], self.offsets[:-1])
        at = self.ends[np.clip(self.first[:-1] + units - 1, 0, len(self.ends) - 1)]
        return np.where(units == 0, self.offsets[:-1], np.where(units <= self.whole, at, self.offsets[1:]))


class Characters:
    """Code points of each row as units."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, index: Exceptions):
        self.index, self.first = index, index.points(offsets)
        self.count = np.diff(self.first)

    def cut(self, units: np.ndarray) -> np.ndarray:
        return self.index.bytes(self.first[:-1] + units)


def holding(data: np.ndarray, offsets: np.ndarray, marks: tuple[bytes, ...]) -> np.ndarray:
    """Which rows hold one of the marks."""
    out = np.zeros(len(offsets) - 1, bool)
    for mark in marks:
        at = np.flatnonzero(data[: max(len(data) - len(mark) + 1, 0)] == mark[0])
        for k in range(1, len(mark)):
            at = at[data[at + k] == mark[k]]
        row = np.searchsorted(offsets, at, "right") - 1
        out[row[at + len(mark) <= offsets[row + 1]]] = True
    return out


def joined(prefix: bytes, middle: bytes, suffix: bytes, form: str, marks: tuple[bytes, ...]) -> bytes:
    p, s, m = marks
    if form == "psm":
        return p + prefix + s + suffix + m + middle
    return s + suffix + p + prefix + m + middle


def rebuilt(output: bytes, form: str, marks: tuple[bytes, ...]) -> bytes:
    """The text that ``output`` was made from; needs nothing but its form."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    a = output.index(second, len(first))
    b = output.index(m, a + len(second))
    one, two, middle = output[len(first) : a], output[a + len(second) : b], output[b + len(m) :]
    return one + middle + two if form == "psm" else two + middle + one


def _checked(marks: tuple[str, str, str]) -> tuple[bytes, ...]:
    """Marks as bytes, refused if a text could end in the head of one and so hide where it starts."""
    raw = tuple(m.encode() for m in marks)
    if len(set(raw)) != 3 or not all(raw):
        raise ValueError("three different marks are needed")
    for a in raw:
        for b in raw:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"mark {a!r} ends as {b!r} begins")
    return raw


def draws(key, seed: int):
    """Four numbers of 32 bits per id: 8-digit groups of the hex SHA-256 of ``seed:id``."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transform(
    documents: DataFrame,
    carry: list[str] | None = None,
    key: str = "doc_id",
    unit: str = "line",
    rate: int = 100,
    suffix_first: int = 50,
    seed: int = 7,
    marks: tuple[str, str, str] = MARKS,
    check: bool = False,
) -> DataFrame:
    """``row`` (the columns ``carry``, or all), ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``n`` counts the units of the text. Of 100 texts about ``rate`` are cut, and of
    100 cut ones ``suffix_first`` take the form ``spm`` (suffix, prefix, middle),
    the others ``psm``. With ``check`` each text is rebuilt from its output in the
    same visit to Python, into ``restored``.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    raw_marks = _checked(marks)
    kept = documents.columns if carry is None else carry
    packed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text"), draws(F.col(f"`{key}`"), seed).alias("draws")
    )
    made = [
        StructField("n", LongType()),
        StructField("form", StringType()),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
        StructField("output", BinaryType()),
        *([StructField("restored", BinaryType())] if check else []),
    ]
    schema = StructType([packed.schema["row"], *made])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            index = Exceptions(data)
            units = (Lines if unit == "line" else Characters)(data, offsets, index)
            drawn = np.asarray(rows.column(2).flatten()).reshape(-1, 4)
            plain = (np.diff(offsets) == 0) | holding(data, offsets, raw_marks) | (drawn[:, 2] % 100 >= rate)
            one, two = drawn[:, 0] % (units.count + 1), drawn[:, 1] % (units.count + 1)
            a, b = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
            forms = np.where(plain, "plain", np.where(drawn[:, 3] % 100 < suffix_first, "spm", "psm")).tolist()
            text = data.tobytes()
            output = [
                text[start:end] if form == "plain" else joined(text[start:x], text[x:y], text[y:end], form, raw_marks)
                for start, end, x, y, form in zip(offsets[:-1].tolist(), offsets[1:].tolist(), a.tolist(), b.tolist(), forms)
            ]
            at = index.points(np.stack([offsets[:-1], a, b]))
            columns = [
                rows.column(0),
                pa.array(units.count.astype(np.int64)),
                pa.array(forms),
                *[pa.array(size, mask=plain) for size in (at[1] - at[0], at[2] - at[1])],
                pa.array(output, pa.binary()),
            ]
            if check:
                columns.append(pa.array([rebuilt(o, f, raw_marks) for o, f in zip(output, forms)], pa.binary()))
            yield pa.record_batch(columns, [f.name for f in schema])

    out = packed.mapInArrow(cut, schema)
    texts = [F.col(c).cast("string").alias(c) for c in ("output", *(["restored"] if check else []))]
    return out.select("row", "n", "form", "prefix_chars", "middle_chars", *texts)


def restore(transformed: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``transformed`` (with ``output`` and ``form``) with ``restored``, the texts it was made from.

    A NULL output or form is restored as NULL.
    """
    _checked(marks)
    p, s, m = marks
    output, form = F.col("output"), F.col("form")

    def parts(first, second):
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + F.lit(len(m) + 1))

    prefix, suffix, middle = parts(p, s)
    suffix_2, prefix_2, middle_2 = parts(s, p)
    text = F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix))
    return transformed.withColumn("restored", text.when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)))


FILL_SQL = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS t, sha256('7:' || COALESCE(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(COALESCE(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
c AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n,
         LEAST(('0x' || h[1:8])::BIGINT % (len(u) + 1), ('0x' || h[9:16])::BIGINT % (len(u) + 1)) AS a,
         GREATEST(('0x' || h[1:8])::BIGINT % (len(u) + 1), ('0x' || h[9:16])::BIGINT % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (
  SELECT *, COALESCE(array_to_string(u[1:a], ''), '') AS p, COALESCE(array_to_string(u[a + 1:b], ''), '') AS m,
         COALESCE(array_to_string(u[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM s
"""
