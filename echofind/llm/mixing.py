"""Mix sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order (by a hash of the id). A
document's virtual finish time is the number of its source's words up to and
including it, divided by the source's target; a second copy of the queue follows
the first, so a source may be repeated. The queues are merged by finish time and
cut where the total budget is spent.

Running sums are taken in slices of about ``SLICE`` rows: sums per slice, sums
over slices (in two levels), then sums within a slice, so a source with a third
of all rows is as many slices, not one task. Only DataFrame functions are used.

Defined results: a NULL source is a source of its own (last in order); a NULL
text has no words and is never taken; rows that are the same in id and size
are interchangeable, so which of them is taken first has no meaning, but as many
are taken on every run; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofind.session import materialize

#: Rows whose running sum one task makes at a time, on average.
SLICE = 2048
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words: runs without ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Number and target of each source, from ``source`` and ``source_size``.

    Sources by code point, NULL last, take the weights in turn. Targets share
    ``share`` times all sizes by weight; one that would pass ``repeats`` times its
    size stays there, and the rest share what is left. The common level is found
    in one pass over the sources in the order in which they reach their limit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * repeats)
    filling = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # the level if this source and all after it stay below their limits; the first such source sets it
    tried = weighed.withColumn("level", level).withColumn("turn", F.row_number().over(filling))
    below = F.col("level") * F.col("weight") <= F.col("most")
    found = tried.withColumn("level", F.min(F.when(below, F.struct("turn", "level"))).over(everything)["level"])
    reached = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double"))
    return found.select("source", F.row_number().over(order).alias("number"), "source_size", reached.alias("target"))


def _offsets(sliced: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Sum of ``value`` over all slices before each one, per key: keys, ``at``, ``before``.

    Two levels, so that no window holds more than the slices of one coarse slice
    or the coarse slices of one key.
    """
    sums = sliced.groupBy(*keys, at).agg(F.sum(value).alias("held"))
    sums = sums.withColumn("coarse", F.floor(F.col(at) / 1024))
    tops = sums.groupBy(*keys, "coarse").agg(F.sum("held").alias("top"))
    run = Window.partitionBy(*keys).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "coarse", F.coalesce(F.sum("top").over(run), F.lit(0)).alias("top"))
    inner = Window.partitionBy(*keys, "coarse").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.coalesce(F.sum("held").over(inner), F.lit(0)))
    same = [sums[k].eqNullSafe(tops[k]) for k in [*keys, "coarse"]]
    joined = sums.join(tops, same)
    return joined.select(*[sums[k] for k in keys], sums[at], (F.col("inside") + F.col("top")).alias("before"))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (the ``carry`` columns, default all), ``size``, ``source_size``, ``target`` and ``taken`` per row.

    ``documents`` has doc_id, source and text, and any other columns. ``taken`` is
    size times the number of copies in the mix, 0 to ``repeats``; the budget is
    ``share`` times all words.
    """
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or documents.columns]).alias("row"),
        F.col("source"),
        F.col("doc_id").alias("id"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("mark"),
    )
    # a narrow copy serves all sums; the whole rows are read once more, for their place in the queues
    narrow = materialize(rows.select("source", "size", "mark"), "mix-sizes")
    per_source = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per_source = materialize(per_source, "mix-sources")
    wanted = targets(per_source.select("source", "source_size"), weights, share, repeats)
    plan = per_source.select(F.col("source").alias("s"), "n").join(wanted, F.col("s").eqNullSafe(F.col("source")))
    plan = materialize(plan.select("s", "number", "source_size", "target", F.ceil(F.col("n") / SLICE).alias("slices")), "mix-plan")

    def sliced(some: DataFrame) -> DataFrame:
        # a row's slice is the place of its hash among equal parts of the hash's range
        place = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
        joined = some.join(plan, some["source"].eqNullSafe(plan["s"])).drop("s")
        return joined.withColumn("slice", F.floor(place * F.col("slices") / F.lit(1 << 32))).drop("slices")

    offsets = materialize(_offsets(sliced(narrow), ["number"], "slice", "size"), "mix-starts")
    queue = Window.partitionBy("number", "slice").orderBy("mark", F.col("id").asc_nulls_last(), "size")
    rows = sliced(rows).withColumn("inside", F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(offsets, ["number", "slice"]).withColumn("words", F.col("before") + F.col("inside"))
    rows = materialize(rows.drop("inside", "before", "slice", "number", "id"), "mix-queues")

    budget = (per_source.agg(F.sum("source_size")).first()[0] or 0) * share
    copies = [rows.where("size > 0").select(*_place(k), "size") for k in range(repeats)]
    merged = copies[0]
    for more in copies[1:]:
        merged = merged.union(more)
    cut = _cut(merged, budget)
    taken = F.lit(0)
    for k in range(repeats):
        held = F.lit(True) if cut is None else F.struct(*_place(k)) < F.struct(*[F.lit(v).alias(n) for n, v in cut.items()])
        taken = taken + F.when((F.col("size") > 0) & held, F.col("size")).otherwise(0)
    return rows.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _place(copy: int) -> list[Column]:
    """Place of a row's copy in the merged queue: finish time; then hash and source decide."""
    finish = F.try_divide((F.lit(copy) * F.col("source_size") + F.col("words")).cast("double"), F.col("target"))
    return [
        finish.alias("finish"),
        F.col("mark").alias("mark"),
        F.col("source").isNull().alias("none"),
        F.coalesce(F.col("source"), F.lit("")).alias("name"),
    ]


def _cut(copies: DataFrame, budget: float) -> dict | None:
    """The place of the first copy in the merged queue that passes the budget; None if all fit.

    Words pass at an even pace in finish time, so equal parts of its range are
    even slices. Their sums show the slice in which the budget ends, and only
    that one is sorted. The driver sees one row.
    """
    copies = materialize(copies, "mix-copies")
    whole = copies.agg(F.max("finish"), F.count("*")).first()
    if not whole[1]:
        return None
    slices = -(-whole[1] // SLICE)
    copies = copies.withColumn("slice", F.floor(F.col("finish") / F.lit(whole[0]) * F.lit(slices)))
    offsets = materialize(_offsets(copies, [], "slice", "size"), "mix-offsets")
    last = offsets.where(F.col("before") <= F.lit(budget)).agg(F.max(F.struct("slice", "before"))).first()[0]
    here = copies.where(F.col("slice") >= F.lit(last["slice"]))
    order = Window.orderBy("finish", "mark", "none", "name", "size").rowsBetween(Window.unboundedPreceding, 0)
    # the budget ends in this slice or just at its end, at the first row of the next
    first = (
        here.where(F.col("slice") == F.lit(last["slice"]))
        .withColumn("run", F.sum("size").over(order) + F.lit(last["before"]))
        .where(F.col("run") > F.lit(budget))
    )
    place = F.min(F.struct("finish", "mark", "none", "name"))
    found = first.agg(place).first()[0] or here.where(F.col("slice") > F.lit(last["slice"])).agg(place).first()[0]
    return found.asDict() if found else None


#: The same in SQL, for the table ``documents`` and the default settings.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
         md5('mix:' || COALESCE(doc_id::VARCHAR, '')) AS mark
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             2 * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER f AS turn,
             (SUM(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - COALESCE(SUM(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
      FROM w WINDOW f AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)),
l AS (SELECT arg_min(level, turn) AS level FROM o WHERE level * weight <= most),
t AS (SELECT source, source_size, COALESCE(LEAST(l.level * weight, most::DOUBLE), most::DOUBLE) AS target FROM o, l),
q AS (SELECT d.*, t.source_size, t.target,
             SUM(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS words,
             row_number() OVER () AS nr
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT nr, size, (k.k * source_size + words)::DOUBLE / target AS finish, mark, source IS NULL AS none, COALESCE(source, '') AS name
      FROM q, (VALUES (0), (1)) k(k) WHERE size > 0),
r AS (SELECT nr, size, SUM(size) OVER (ORDER BY finish, mark, none, name, size ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT nr, SUM(size)::BIGINT AS taken FROM r
      WHERE run <= (SELECT 1.5::DOUBLE * SUM(size) FROM d) GROUP BY nr)
SELECT q.doc_id, q.size, q.source_size, q.target, COALESCE(g.taken, 0) AS taken FROM q LEFT JOIN g USING (nr)
"""
