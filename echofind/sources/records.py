"""Records of CSV files that are split over tasks, line breaks in quotes included.

Spark's text reader cuts files into ranges of bytes. A task cannot know whether its range
begins inside a quoted value, so every line is read under both assumptions: what a line
does to the state (open quote or not) is a function of two values, and these functions
compose. One row per range then goes to its file's fold, which tells each range how it
began; records of one line are parsed where they lie, only the lines of longer ones meet
in a shuffle, keyed by their record.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofind.operators.upsert import assign_ids
from echofind.session import materialize

# A quote opens a value only where the value begins; after its closing quote anything may
# follow up to the comma. All loops are possessive, so long lines cost no stack.
_OPEN = r'"[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:{_OPEN}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = rf"\A﻿?{_FIELDS}{_OPEN}\z"
_STAYS = rf'\A[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,{_FIELDS}{_OPEN}\z)'

_BLANK, _WHOLE, _PART = 0, 1, 2
_RANGES = 500_000  # broadcast up to as many ranges (64 TB in ranges of 128 MB), else a join by key
_FILES = 10_000  # ranked on the driver up to as many files, else by a sort
_LINE_BITS = 40

_STATES = "open_out boolean, rec_out bigint, how_out tinyint, open_in boolean, rec_in bigint, how_in tinyint"
_LINES = f"file string, block bigint, n bigint, value string, {_STATES}, head string"
_RANGE = "file string, block bigint, open boolean, owner bigint, owner_rec bigint, base bigint, first_n bigint, header string"


class Records(NamedTuple):
    """``rows`` has position, layout, record; ``layouts`` the column names by number."""

    rows: DataFrame
    layouts: list[list[str]]


def states(to_out: np.ndarray, to_in: np.ndarray, start: bool) -> np.ndarray:
    """The state after every line: ``to_out`` and ``to_in`` are its values if none or one was open before."""
    at = np.arange(len(to_out))
    fixed = np.maximum.accumulate(np.where(to_out == to_in, at, -1))
    flips = np.cumsum(to_out & ~to_in)
    since = flips - np.where(fixed >= 0, flips[fixed], 0)
    return np.where(fixed >= 0, to_out[fixed], start) ^ (since % 2 == 1)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the records of each range under both assumptions; the lines come in order."""
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("value", pa.string())]
        + [f for h in ("out", "in") for f in ((f"open_{h}", pa.bool_()), (f"rec_{h}", pa.int64()), (f"how_{h}", pa.int8()))]
        + [("head", pa.string())]
    )
    last, carried = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file").cast(pa.string()), batch.column("block").to_numpy()
        changed = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
        cuts = [0, *(np.flatnonzero(changed) + 1), batch.num_rows]
        to_out, to_in, blank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("to_out", "to_in", "blank"))
        found = {c: [] for c in ("open_out", "rec_out", "how_out", "open_in", "rec_in", "how_in")}
        for low, high in zip(cuts, cuts[1:]):
            here = (file[low].as_py(), int(block[low]))
            if here != last:
                last, carried = here, {"out": (False, 0), "in": (True, 0)}
            for name in ("out", "in"):
                start, seen = carried[name]
                after = states(to_out[low:high], to_in[low:high], start)
                before = np.concatenate(([start], after[:-1]))
                empty = ~before & blank[low:high]
                record = seen + np.cumsum(~before & ~empty)
                how = np.where(empty, _BLANK, np.where(before | after, _PART, _WHOLE))
                carried[name] = (bool(after[-1]), int(record[-1]))
                for kind, values in (("open", after), ("rec", record), ("how", how)):
                    found[f"{kind}_{name}"].append(values)
        columns = {c: np.concatenate(parts) for c, parts in found.items()}
        value = batch.column("value").cast(pa.string())
        first = pa.array((block == 0) & (columns["rec_out"] == 1) & (columns["how_out"] != _BLANK))
        arrays = [file, pa.array(block), batch.column("n"), value]
        arrays += [pa.array(columns[f.name], f.type) for f in schema if f.name in columns]
        arrays.append(pc.if_else(first, value, pa.scalar(None, pa.string())))
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _chain(ranges: pd.DataFrame) -> pd.DataFrame:
    """How each range of one file begins, and the record its first lines go on with."""
    ranges = ranges.sort_values("block")
    rows, is_open, owner, owner_rec, base, header = [], False, -1, 0, 0, ranges["header"].iloc[0]
    for r in ranges.itertuples():
        rows.append((r.file, r.block, is_open, owner, owner_rec, base, r.first_n, header or None))
        records = r.rec_in if is_open else r.rec_out
        if records and not header:
            raise ValueError(f"no header in the first range of {r.file}")
        is_open = r.open_in if is_open else r.open_out
        base += r.lines
        if records:
            owner, owner_rec = r.block, records
    return pd.DataFrame(rows, columns=["file", "block", "open", "owner", "owner_rec", "base", "first_n", "header"])


def _ranked(ranges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(file, rank by name, layout), and the header of each layout."""
    files = ranges.where("block = 0 AND header IS NOT NULL").select("file", "header")
    few = files.limit(_FILES + 1).collect()
    schema = "file string, rank bigint, layout int"
    if len(few) <= _FILES:
        few = sorted(few)
        headers = list(dict.fromkeys(r.header for r in few))
        places = [(r.file, rank, headers.index(r.header)) for rank, r in enumerate(few)]
        return F.broadcast(ranges.sparkSession.createDataFrame(places, schema)), headers
    ranked = assign_ids(files, ["file"], last_id=-1, id_column="rank")
    headers = [r.header for r in ranked.groupBy("header").agg(F.min("rank").alias("rank")).orderBy("rank").collect()]
    numbers = ranges.sparkSession.createDataFrame(list(enumerate(headers)), "layout int, header string")
    return ranked.join(F.broadcast(numbers), "header").select("file", "rank", "layout"), headers


def _names(header: str) -> list[str]:
    """Column names as Spark's reader gives them: absent ones by place, repeated ones with their place."""
    given = next(csv.reader([header.removeprefix("﻿")]), [])
    lower = [g.lower() for g in given]
    return [f"_c{i}" if not g else f"{g}{i}" if lower.count(g.lower()) > 1 else g for i, g in enumerate(given)]


def _bare(text: Column) -> Column:
    """Without the first half of a line end."""
    return F.regexp_replace(text, r"\r\z", "")


def read_records(spark: SparkSession, path: str) -> Records:
    """All records of the files of a path, but their headers (the first record of each).

    ``position`` is the number of a record's first line in its file, plus the file's rank
    by name in the bits above the fortieth. Lines end with LF or CRLF; empty ones outside
    quotes are no records; a quote that is never closed takes in the rest of its file. A
    header lies in the first range of its file. The lines are written once, so both looks at them agree.
    Different headers are collected: there is one branch of the plan for each.
    """
    text = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        "value",
    )
    quoted = F.contains("value", F.lit('"'))
    lines = text.select(
        "*",
        (quoted & F.col("value").rlike(_OPENS)).alias("to_out"),
        (~quoted | F.col("value").rlike(_STAYS)).alias("to_in"),
        F.col("value").isin("", "\r", "﻿", "﻿\r").alias("blank"),
    )
    lines = materialize(lines.mapInArrow(_number, _LINES), "csv-lines")

    head = F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("n", "head"))))
    ends = lines.groupBy("file", "block").agg(
        *[F.max_by(c, "n").alias(c) for c in ("open_out", "open_in", "rec_out", "rec_in")],
        F.min("n").alias("first_n"),
        F.count("*").alias("lines"),
        _bare(F.concat_ws("\n", F.transform(head, lambda h: h["head"]))).alias("header"),
    )
    ranges = materialize(ends.groupBy("file").applyInPandas(_chain, _RANGE), "csv-ranges")
    files, headers = _ranked(ranges)
    starts = ranges.drop("header").join(files, "file")
    starts = F.broadcast(starts) if ranges.count() <= _RANGES else starts

    placed = lines.join(starts, ["file", "block"]).select(
        (F.shiftleft("rank", _LINE_BITS) + F.col("base") + F.col("n") - F.col("first_n") + 1).alias("position"),
        "rank", "layout", "block", "owner", "owner_rec", "value",
        F.when(F.col("open"), F.col("rec_in")).otherwise(F.col("rec_out")).alias("rec"),
        F.when(F.col("open"), F.col("how_in")).otherwise(F.col("how_out")).alias("how"),
    )
    goes_on = F.col("rec") == 0
    keyed = placed.where(F.col("how") != _BLANK).select(
        "position", "rank", "layout", "how", "value",
        F.when(goes_on, F.col("owner")).otherwise(F.col("block")).alias("key"),
        F.when(goes_on, F.col("owner_rec")).otherwise(F.col("rec")).alias("rec"),
    )
    keyed = keyed.where(~((F.col("key") == 0) & (F.col("rec") == 1)))
    single = keyed.where(F.col("how") == _WHOLE).select("position", "layout", _bare(F.col("value")).alias("record"))
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda v: v["value"]))
    longer = keyed.where(F.col("how") == _PART).groupBy("rank", "key", "rec", "layout")
    longer = longer.agg(F.min("position").alias("position"), _bare(joined).alias("record"))
    return Records(single.unionByName(longer.select(*single.columns)), [_names(h) for h in headers])
