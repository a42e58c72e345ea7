"""Secrets in texts, and credentials in several parts that only together mean something.

Strong finds (``assign``, ``access``, ``hex``) are reported wherever they stand.
Weak parts (an account name, an unnamed random string, an address) are common and
harmless alone. They are linked: parts of one text and scope (lines up to a blank
line) meet if their intervals, widened by ``reach`` characters, overlap. A weak
part is reported when what complements it is there:

* ``identifier``: a secret,
* ``secret``: an identifier or an endpoint,
* ``endpoint``: an identifier and a secret.

Strong finds count as parts too: ``access`` as identifier, the others as secret.
Names of weak parts may carry more words around them (``DB_PASS``, ``db.user.name``,
``awsSecretAccessKey``); the last word that tells a class counts. An address of any
scheme is an endpoint; user and password inside it are parts of their own, and it
ends before a part in its query.
Only what tasks find leaves them, not the texts. The join looks from each part to
the nearest part of every class before and after it, with windows, so no pairs
are made however many parts a scope has.

Defined results: a NULL text is empty and has no spans; rows are handled one by
one, so repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from echofind.session import materialize

STRONG = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")

_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN = re.compile(rf"(password|passwd|secret|token|api_?key){_VALUE}", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAME = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)["']?\x20*+[:=]""")
_AFTER = re.compile(r"""\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[.-]")
_CLASS = re.compile(
    r"(?<![a-z])(?:"
    r"(?P<secret>secret(?:_?access)?(?:_?key)?|private_?key(?!_?id)|(?:api|account|shared|signing|encryption|master|storage|service|server|ssh|auth)_?key"
    r"|pwd|pass|passwd|password|pass_?phrase|auth|token|credentials?)"
    r"|(?P<identifier>user(?:_?name|_?id)?|uid|login|account(?:_?name|_?id)?|client_?id|access_?id|access_?key(?:_?id)?|consumer_?key)"
    r"|(?P<endpoint>host(?:_?name)?|endpoint|server))[0-9]*(?![a-z])"
)
#: After such a word the value tells something about the part, and is not the part.
_ABOUT = re.compile(r"_(?:agent|count|enabled|expiry|group|length|limit|rate|required|role|size|time|timeout|type|version)s?(?![a-z])")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9+.-])(?:jdbc:)?[A-Za-z][A-Za-z0-9+.-]*+://(?=([A-Za-z0-9._~:@!$&()*+,;=%-]*))[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+")
_QUOTED = re.compile(r"""["']([A-Za-z0-9+/_=.-]{16,}+)["']""")
_PIECE = re.compile(r"[?;&/#]")
_BLANK = re.compile(r"\n[ \t\r]*(?=\n)")
#: No strong find without one of these (in lower case).
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def strong_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """Kind, start and end of the strong finds; leftmost, without overlaps within a kind."""
    found = []
    small = raw.lower()
    if any(w in small for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _random_looking(value: str) -> bool:
    """Letters and digits, at three bits of entropy per character or more, in some piece between dots."""
    if "." in value:
        return any(_random_looking(piece) for piece in value.split("."))
    if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 3.0


def _named(text: str) -> list[tuple[str, int, int, int]]:
    """Class, start and end of values with a telling name, and the start of the name."""
    found = []
    for m in _NAME.finditer(text):
        name = _HUMP.sub("_", m[1]).lower()
        last = None
        for last in _CLASS.finditer(name):
            pass
        value = last and _AFTER.match(text, m.end())
        if not value or _ABOUT.match(name, last.end()) or text.startswith("://", value.end(1)):
            continue
        if last.end() < len(name) and "." in m[1] and value[1].isdigit():  # host and port
            continue
        if len(value[1]) >= (6 if last.lastgroup == "secret" else 3):
            found.append((last.lastgroup, value.start(1), value.end(1), m.start(1)))
    return found


def _address_parts(text: str, m: re.Match, inside: list[int]) -> list[tuple[str, int, int]]:
    """User, password and the rest of an address, which ends before the first of the starts ``inside`` it."""
    parts = []
    start, (a, b) = m.start(), m.span(1)
    info = text.rfind("@", a, b)
    if info >= 0:
        colon = text.find(":", a, info)
        user = colon if colon >= 0 else info
        parts = [("identifier", a, user), ("secret", user + 1, info)]
        start = info + 1
    end = m.end()
    first = bisect.bisect_left(inside, start)
    if first < len(inside) and inside[first] < end:
        cuts = [c.start() for c in _PIECE.finditer(text, max(start, a), inside[first])]
        end = cuts[-1] if cuts else end
    return [(kind, i, j) for kind, i, j in [*parts, ("endpoint", start, end)] if i < j]


def weak_parts(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Class, start and end of parts that mean nothing alone and overlap no strong find."""
    named = _named(text) if "=" in text or ":" in text else []
    found = []
    if "://" in text:
        inside = sorted([at for *_, at in named] + [a for _, a, _ in strong])
        for m in _ADDRESS.finditer(text):
            found += _address_parts(text, m, inside)
    found += [part[:3] for part in named]
    if '"' in text or "'" in text:
        found += [("secret", m.start(1), m.end(1)) for m in _QUOTED.finditer(text) if _random_looking(m[1])]
    taken, kept, reach = sorted((a, b) for _, a, b in strong), [], -1
    at = 0
    for kind, a, b in sorted(found, key=lambda p: (p[1], -p[2])):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= reach and not (at < len(taken) and taken[at][0] < b):
            kept.append((kind, a, b))
            reach = b
    return kept


_PART = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())])
_SPARK_PART = StructType(
    [StructField("kind", StringType()), *[StructField(n, LongType()) for n in ("start", "end", "scope")]]
)


def _parts(text: str | None, raw: bytes | None) -> list[dict]:
    """Strong finds and weak parts of a text, with the number of their scope."""
    if not text:
        return []
    strong = strong_spans(text, raw)
    parts = strong + weak_parts(text, strong)
    if not parts:
        return []
    breaks = [m.start() for m in _BLANK.finditer(text)]
    return [{"kind": k, "start": a, "end": b, "scope": bisect.bisect_right(breaks, a)} for k, a, b in parts]


def scan(documents: DataFrame, carry: list[str]) -> DataFrame:
    """One pass over the texts, written: ``number``, ``row`` (the ``carry`` columns) and ``parts``."""
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.monotonically_increasing_id().alias("number"), "text"
    )
    schema = StructType([rows.schema["row"], rows.schema["number"], StructField("parts", ArrayType(_SPARK_PART))])

    def found(batches):
        for batch in batches:
            for start in range(0, len(batch), 512):
                some = batch.slice(start, 512)
                texts = some.column(2)
                out = [_parts(t, r) for t, r in zip(texts.to_pylist(), texts.cast(pa.binary()).to_pylist())]
                yield pa.record_batch([some.column(0), some.column(1), pa.array(out, pa.list_(_PART))], ["row", "number", "parts"])

    # row numbers must not change when a task is run again
    return materialize(rows.mapInArrow(found, schema), "secret-parts")


def link(scanned: DataFrame, reach: int = 300) -> DataFrame:
    """The weak parts that are reported: ``number``, ``kind``, ``start``, ``end``."""
    parts = scanned.select("number", F.explode("parts").alias("p")).select("number", "p.*")
    kind = F.col("kind")
    strong = F.when(kind == "access", "identifier").when(kind.isin("assign", "hex"), "secret")
    parts = parts.withColumn("part", F.coalesce(strong, kind)).withColumn("weak", strong.isNull())
    scope = Window.partitionBy("number", "scope")
    ahead = scope.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = scope.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)

    def near(other: str) -> Column:
        here = F.col("part") == other
        before = F.max(F.when(here, F.col("end"))).over(ahead)
        after = F.min(F.when(here, F.col("start"))).over(back)
        return F.coalesce(F.col("start") - before <= reach, F.lit(False)) | F.coalesce(after - F.col("end") <= reach, F.lit(False))

    seen = parts.select("*", *[near(w).alias(f"near_{w}") for w in WEAK])
    told = (
        F.when(F.col("part") == "identifier", F.col("near_secret"))
        .when(F.col("part") == "secret", F.col("near_identifier") | F.col("near_endpoint"))
        .otherwise(F.col("near_identifier") & F.col("near_secret"))
    )
    return seen.where(F.col("weak") & told).select("number", "kind", "start", "end")


def digest(scanned: DataFrame, linked: DataFrame) -> DataFrame:
    """Per row: ``row``, counts per strong kind, a hash of the strong finds and all spans as text."""
    rank = F.array(*[F.lit(k) for k in (*STRONG, *WEAK)])

    def ordered(spans: Column) -> Column:
        keyed = F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
        )
        texts = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(texts, ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("strong", lambda p: p["kind"] == kind))

    kept = scanned.select(
        "number", "row", F.transform(F.filter("parts", lambda p: p["kind"].isin(*STRONG)), lambda p: F.struct(p["kind"], p["start"], p["end"])).alias("strong")
    )
    added = linked.groupBy("number").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    both = kept.join(added, "number", "left")
    every = F.when(F.col("added").isNull(), F.col("strong")).otherwise(F.concat("strong", "added"))
    return both.select(
        "row",
        *[count(k).cast("long").alias(f"n_{k}") for k in STRONG],
        F.sha2(ordered(F.col("strong")), 256).alias("base_sha256"),
        ordered(every).alias("spans"),
    )


def find(documents: DataFrame, carry: list[str] | None = None, reach: int = 300) -> DataFrame:
    """Per row of ``documents``: ``row`` (the ``carry`` columns, default all), counts, hash and spans."""
    scanned = scan(documents, carry or documents.columns)
    return digest(scanned, link(scanned, reach))
