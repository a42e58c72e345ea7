"""Personal data: fixed patterns, and identifiers found through contexts learnt from them.

Base entities come from fixed patterns over whole texts. Their contexts then
serve as seeds (bootstrapping): the two words before a mention are a lexical
pattern. Words are runs of letters and digits, whatever stands between them; numbers
are all alike, earlier mentions are words too, and ``^`` stands for words before a
text's start. Patterns and instances (the strings mentioned) form a graph. In each
round, until no score changes, a pattern's confidence is the share of all its occurrences in the corpus
that lead to an instance, each instance counting with its score; an unknown
instance's score is the chance that at least one of its confident patterns is
right. Unknown identifier-like strings that confident patterns lead to are
reported with kind ``id``.

Only DataFrame functions are used. Positions come from the lengths of matches
and of the gaps between them, summed per text with a window, and so do the words
before a mention (words of over 70 characters are in no pattern). Matches are rare, so
what leaves the scan is small; texts without any are never shuffled.

Defined results: a NULL text is empty and has no spans; rows are handled one by
one, so repeated rows repeat; equal starts sort by kind; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofind.session import broadcast_if_small, materialize

KINDS = ("email", "ip", "card", "phone")
#: Kind of what the contexts find; last in order.
LEARNT = "id"

# Possessive and tied to a run's start or the last match's end, these find what
# the plain forms find, but in time linear in the text.
_PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    LEARNT: r"(?<![0-9A-Za-z@._+/-])(?=[A-Za-z@._+/-]{0,16}[0-9])[0-9A-Za-z@._+/-]{5,}+",
}
#: A text without this has no such match; cheap to look for.
_HINT = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
    LEARNT: r"[0-9]",
}
#: What stands between words.
_BETWEEN = r"[^\p{L}\p{M}\p{N}]+"
#: Characters kept of a gap, in words, and matches looked back on.
_TAIL, _BACK = 160, 16
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", n.between(13, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _matches(text: Column, kind: str) -> Column:
    """Each match in order, with the length of the gap before it and the gap's last words."""
    pattern = F.lit(_PATTERN[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, _PATTERN[kind], -1)

    def words(gap: Column) -> Column:
        return F.right(F.regexp_replace(F.right(gap, F.lit(1000)), _BETWEEN, " "), F.lit(_TAIL))

    pairs = F.zip_with(
        found,
        F.slice(gaps, F.lit(1), F.size(found)),
        lambda m, g: F.struct(F.lit(kind).alias("kind"), m.alias("match"), F.length(g).alias("gap"), words(g).alias("tail")),
    )
    return F.when(text.rlike(_HINT[kind]), pairs).otherwise(F.array().cast("array<struct<kind:string,match:string,gap:int,tail:string>>"))


def scan(documents: DataFrame, carry: list[str]) -> DataFrame:
    """One pass over the texts, written: ``number`` of the row, ``row`` (the ``carry`` columns) and ``found``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [_matches(F.col("body"), k) for k in (*KINDS, LEARNT)]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text.alias("body"))
    rows = rows.select("row", F.monotonically_increasing_id().alias("number"), F.array(*found).alias("found"))
    # row numbers must not change when a task is run again
    return materialize(rows, "pii-scan")


def _plain_words(text: Column, between: str = _BETWEEN) -> Column:
    """Words in lower case with one blank between them, numbers as 0."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, between, " ")), "[0-9]+", "0")


def mentions(scanned: DataFrame) -> DataFrame:
    """``number``, ``kind``, ``start``, ``end``, ``match`` and ``pattern`` (NULL where a word goes on into the mention)."""
    each = scanned.select("number", F.explode("found").alias("all")).select("number", F.posexplode("all").alias("i", "m"))
    each = each.select("number", "i", "m.*")
    run = Window.partitionBy("number", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    # gaps and matches together are the text
    first = (F.col("i") == 0) & (F.col("gap") <= 1000) & (F.length("tail") < _TAIL)
    each = each.withColumn("tail", F.when(first, F.concat(F.lit(" ^ ^ "), "tail")).otherwise(F.col("tail")))
    gone = F.collect_list(F.concat("tail", F.right("match", F.lit(_TAIL)))).over(run.rowsBetween(-_BACK, -1))
    before = _plain_words(F.right(F.concat(F.array_join(gone, ""), "tail"), F.lit(_TAIL)), r"[^\p{L}\p{M}\p{N}^]+")
    apart = F.col("match").rlike("^" + _BETWEEN) | before.endswith(" ")
    pattern = F.when(apart, F.regexp_extract(before, "(?<= )([^ ]+ [^ ]+) ?$", 1))
    out = each.select(
        "number", "kind", "match", (end - F.length("match")).alias("start"), end.alias("end"), F.when(pattern != "", pattern).alias("pattern")
    )
    return out.where(_valid(F.col("kind"), F.col("match")))


def _apart(spans: DataFrame) -> DataFrame:
    """The unknown mentions that overlap no base span of their text."""
    base = F.col("kind") != LEARNT
    text = Window.partitionBy("number")
    gone = F.max(F.when(base, F.col("end"))).over(text.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("start"))).over(text.orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, 0))
    free = spans.select("*", gone.alias("gone"), ahead.alias("ahead")).where(~base)
    free = free.where("coalesce(gone <= start, true) and coalesce(ahead >= end, true)")
    return free.drop("gone", "ahead")


def _occurrences(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern's two words stand in the corpus, before anything at all."""
    body = documents.select(F.trim(_plain_words(F.col("text"))).alias("body")).where("body <> ''")
    tokens = body.select(F.concat(F.array(F.lit("^"), F.lit("^")), F.split("body", " ")).alias("w"))
    pairs = F.zip_with(
        F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
        F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    each = tokens.select(F.explode(pairs).alias("pattern"))
    return each.join(broadcast_if_small(patterns, 200_000), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n"))


def learn(
    documents: DataFrame, spans: DataFrame, least_seeds: int = 3, confident: float = 0.5
) -> DataFrame:
    """The unknown mentions that confident patterns lead to.

    ``spans`` as from ``mentions``. A pattern needs ``least_seeds`` different
    instances, and as many believed ones to be trusted. Scores only rise; rounds
    end when none does by a millionth.
    """

    def total(scores: DataFrame):
        return scores.agg(F.sum(F.col("score").cast("decimal(20,6)"))).first()[0] or 0

    known = spans.where(F.col("kind") != LEARNT)
    free = materialize(_apart(spans), "pii-free")
    edge = known.select("pattern", "match", F.lit(1.0).alias("seed")).union(free.select("pattern", "match", F.lit(0.0)))
    edge = edge.where("pattern IS NOT NULL").groupBy("pattern", "match").agg(F.count("*").alias("hits"), F.max("seed").alias("seed"))
    edge = materialize(edge, "pii-edges")
    often = edge.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("hits").alias("hits"))
    often = materialize(often.where(F.col("instances") >= least_seeds), "pii-patterns")
    # what stands before other words too often in the few texts that may hold a mention is no better in all of them
    may = documents.where(F.col("text").rlike("[0-9@]"))
    bound = _occurrences(may, often.select("pattern")).join(often, "pattern")
    able = materialize(bound.where(F.col("hits") >= confident * F.col("n")).select("pattern"), "pii-able")
    counted = _occurrences(documents, able)
    graph = materialize(edge.join(counted, "pattern"), "pii-graph")

    scores = graph.select("match", F.col("seed").alias("score")).groupBy("match").agg(F.max("score").alias("score"))
    seen = total(scores)
    while True:
        weighed = graph.join(scores, "match")
        trust = weighed.groupBy("pattern").agg(
            (F.sum(F.col("hits") * F.col("score")) / F.max("n")).alias("trust"),
            F.sum((F.col("score") >= confident).cast("int")).alias("believed"),
        )
        trust = trust.where((F.col("trust") >= confident) & (F.col("believed") >= least_seeds))
        trust = materialize(trust.select("pattern", F.least("trust", F.lit(1.0)).alias("trust")), "pii-trust")
        doubt = F.sum(F.log(F.greatest(1 - F.coalesce("trust", F.lit(0.0)), F.lit(1e-9))))
        told = graph.join(trust, "pattern", "left").groupBy("match").agg(
            F.max("seed").alias("seed"), (1 - F.exp(F.coalesce(doubt, F.lit(0.0)))).alias("told")
        )
        scores = materialize(told.select("match", F.greatest("seed", "told").alias("score")), "pii-scores")
        now = total(scores)
        if now <= seen:
            break
        seen = now
    led = free.join(trust.select("pattern"), "pattern", "left_semi")
    return led.join(scores.where(F.col("score") >= confident).select("match"), "match", "left_semi").select(spans.columns)


def find(documents: DataFrame, carry: list[str], **settings) -> tuple[DataFrame, DataFrame]:
    """All rows with their numbers (``number``, ``row``), and all spans (``number``, ``kind``, ``start``, ``end``).

    Offsets are code points, the end is exclusive.
    """
    scanned = scan(documents, carry)
    spans = materialize(mentions(scanned), "pii-mentions")
    added = learn(documents, spans, **settings)
    kept = ["number", "kind", "start", "end"]
    return scanned, spans.where(F.col("kind") != LEARNT).select(kept).union(added.select(kept))


def digest(scanned: DataFrame, spans: DataFrame) -> DataFrame:
    """Per row: ``row``, counts per kind, a hash of the base spans and all spans as text."""
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, LEARNT)]), F.col("kind"))
    listed = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind")))
    per_row = spans.groupBy("number").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS], listed.alias("spans")
    )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    every = scanned.select("number", "row").join(per_row, "number", "left")
    base = F.filter("spans", lambda s: s["kind"] != LEARNT)
    return every.select(
        "row",
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(joined(base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"),
    )


def mask(documents: DataFrame, **settings) -> DataFrame:
    """``documents`` with every span of ``text`` replaced by its kind in angle brackets.

    Spans that overlap are replaced together, by the kind of the first. A NULL
    text stays NULL; ``n_chars``, if there, is made to fit.
    """
    columns = documents.columns
    scanned, spans = find(documents, columns, **settings)
    text = Window.partitionBy("number").orderBy("start", "end")
    reach = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    chained = spans.withColumn("fresh", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    chained = chained.withColumn("chain", F.sum("fresh").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chained.groupBy("number", "chain").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end")).alias("kind")
    )
    pieces = whole.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))

    body = F.col("row")["text"]
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c["end"]))
    parts = F.zip_with(
        starts,
        F.col("cuts"),
        lambda at, c: F.concat(
            F.substring(body, (at + 1).cast("int"), F.coalesce((c["start"] - at).cast("int"), F.lit((1 << 31) - 1))),
            F.coalesce(F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">")), F.lit("")),
        ),
    )
    # only texts that may hold something go through a shuffle
    plain = F.forall("found", lambda f: F.size(f) == 0)
    hit = scanned.where(~plain).join(pieces, "number", "left")
    masked = F.when(F.col("cuts").isNull(), body).otherwise(F.array_join(parts, ""))

    def row(text: Column) -> list[Column]:
        made = {"text": text} | ({"n_chars": F.length(text).cast(documents.schema["n_chars"].dataType)} if "n_chars" in columns else {})
        return [made.get(c, F.col("row")[c]).alias(c) for c in columns]

    return scanned.where(plain).select(*row(body)).union(hit.select(*row(masked)))
