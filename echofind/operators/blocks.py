"""Rows in packed blocks, and joins in which blocks of one side meet blocks of the other.

A table of vectors that must meet all of another is not copied for it: its rows are
packed into blocks (Arrow, compressed), the blocks are dealt to a few parts, and every
part of one side meets every part of the other by a nested-loop join. A part
is written once however many tasks read it, so what is written grows with the rows, not
with the number of meetings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofind.session import materialize

#: Bytes of packed blocks in one part; a task holds two of them.
PART_BYTES = 32 * 1024 * 1024
#: Bytes of rows that a task gathers before it packs the largest of its unfinished blocks.
HELD_BYTES = 64 * 1024 * 1024


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def packed(rows: DataFrame, size: int, key: str | None = None) -> DataFrame:
    """(block, spot, key, data), stored: ``rows`` in blocks of ``size`` at most, each of one ``key`` if there is one.

    ``block`` is unique; ``spot`` runs on within a task, for dealing.
    """

    def by_key(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
        table = pa.Table.from_batches([batch])
        if key is None or not table.num_rows:
            yield 0, table
            return
        table = table.sort_by(key)
        keys = table[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            yield int(keys[low]), table.slice(low, high - low)

    def run(batches):
        part, made, held, count, bytes_of = TaskContext.get().partitionId(), 0, {}, {}, {}

        def done(k: int):
            nonlocal made
            table = pa.concat_tables(held.pop(k))
            del count[k], bytes_of[k]
            for at in range(0, table.num_rows, size):
                data = pack(table.slice(at, size))
                yield pa.record_batch([pa.array([made << 32 | part]), pa.array([made + part]), pa.array([k]), pa.array([data])], names)
                made += 1

        for batch in batches:
            for k, table in by_key(batch):
                room = size - count.get(k, 0)
                for some in (table.slice(0, room), table.slice(room)):
                    if not some.num_rows:
                        continue
                    held.setdefault(k, []).append(some)
                    count[k] = count.get(k, 0) + some.num_rows
                    bytes_of[k] = bytes_of.get(k, 0) + some.nbytes
                    if count[k] >= size:
                        yield from done(k)
            while sum(bytes_of.values()) > HELD_BYTES:
                yield from done(max(bytes_of, key=bytes_of.get))
        for k in list(held):
            yield from done(k)

    names = ["block", "spot", "key", "data"]
    return materialize(rows.mapInArrow(run, "block bigint, spot bigint, key bigint, data binary"), "blocks")


def meetings(left: DataFrame, right: DataFrame, side: int) -> DataFrame:
    """Every part of ``left`` with every part of ``right``, one pair of parts for a task that reads them by :func:`met`.

    Either side is dealt to ``side`` parts, or more where one would pass
    :data:`PART_BYTES`. Each part has an empty block; only pairs with one are made, so
    a task gets a block once, not once for every partner. It holds both parts, packed.
    """

    def dealt(blocks: DataFrame, block: str, data: str) -> DataFrame:
        size = blocks.agg(F.sum(F.length("data").cast("bigint"))).first()[0] or 0
        parts = max(side, -(-size // PART_BYTES))
        none = blocks.sparkSession.range(parts).select(
            F.lit(-1).cast("bigint").alias("block"), F.col("id").alias("spot"), F.lit(0).cast("bigint").alias("key"), F.lit(None).cast("binary").alias("data")
        )
        blocks = blocks.union(none).repartitionById(parts, F.pmod("spot", F.lit(parts)).cast("int"))
        return blocks.select(F.col("block").alias(block), F.col("key").alias(f"{block}_key"), F.col("data").alias(data))

    left, right = dealt(left, "a", "mine"), dealt(right, "b", "other")
    return left.join(right.hint("shuffle_replicate_nl"), F.expr("(a < 0) <> (b < 0)"))


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, list[tuple[int, int, bytes]]]]:
    """Each left block of a task, its key and data; and the same of all right blocks."""
    ours, others = [], []
    for batch in batches:
        for a, a_key, mine, b, b_key, other in zip(*batch.columns):
            if a.as_py() < 0:
                others.append((b.as_py(), b_key.as_py(), other.as_py()))
            else:
                ours.append((a.as_py(), a_key.as_py(), mine.as_py()))
    for block in sorted(ours):
        yield *block, others
