"""Comparing the members of candidate groups pair by pair, in bounded blocks.

A group of any size is cut into chunks; each pair of chunks is one block, handled
by one task at a time. Blocks give, per member, how many others it links to and
one link to the smallest member it reaches, so what leaves a block grows with its
members, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from echofind.session import materialize


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch per block, from rows sorted by block."""
    held, block = [], None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("block"))
        ends = [*(np.flatnonzero(np.asarray(keys)[1:] != np.asarray(keys)[:-1]) + 1).tolist(), len(batch)] if len(batch) else []
        start = 0
        for end in ends:
            part = batch.slice(start, end - start)
            key = keys[start].as_py()
            if held and key != block:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
            block, start = key, end
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches over a symmetric matrix of links."""
    label = np.arange(len(linked))
    a, b = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def deal(members: DataFrame, group: str, node: str, size: str, chunk_size: int) -> DataFrame:
    """``members`` of groups of two or more, dealt to blocks and sorted by them.

    A group is cut into chunks whose sum of ``size`` stays near ``chunk_size``;
    each pair of chunks is a block, so two members of a group meet in one. Adds
    ``chunk``, ``block`` and ``same`` (both chunks are the same).
    """
    groups = members.groupBy(F.col(group).alias("_g")).agg(
        F.ceil(F.sum(F.col(size) + F.lit(1)) / F.lit(chunk_size)).cast("int").alias("_chunks"), F.count("*").alias("_n")
    )
    # one member has nobody to be compared with
    spread = members.join(groups.where("_n > 1"), F.col(group) == F.col("_g"))
    spread = spread.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), F.col(node)), F.col("_chunks")).cast("int"))
    dealt = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other"))
    low, high = F.least("chunk", "_other"), F.greatest("chunk", "_other")
    dealt = dealt.withColumn("block", F.xxhash64("_g", low, high)).withColumn("same", low == high)
    dealt = dealt.drop("_g", "_chunks", "_n", "_other")
    return dealt.repartition("block").sortWithinPartitions("block", "chunk", node)


def link(
    members: DataFrame,
    group: str,
    node: str,
    size: str,
    chunk_size: int,
    links: Callable[[pa.RecordBatch], np.ndarray],
    name: str,
) -> tuple[DataFrame, DataFrame]:
    """Links among the members of each group: (``node``, ``linked``) and pairs (``a``, ``b``).

    ``members`` has distinct nodes, their ``group``, ``copies`` (how many rows a
    node stands for), and a ``size`` whose sum per chunk stays near
    ``chunk_size``. ``links`` gets the rows of a block and returns the symmetric
    boolean matrix of links. ``linked`` counts linked rows, copies included;
    the pairs connect what is linked.
    """
    dealt = deal(members, group, node, size, chunk_size).drop(group)
    kind = members.schema[node].dataType
    schema = StructType([StructField("node", kind), StructField("root", kind), StructField("linked", LongType())])

    def compare(batches):
        for rows in _gathered(batches):
            matrix = links(rows)
            np.fill_diagonal(matrix, False)
            label = roots(matrix)
            chunk = np.asarray(rows.column(rows.schema.get_field_index("chunk")))
            if not rows.column(rows.schema.get_field_index("same"))[0].as_py():
                matrix &= chunk[:, None] != chunk[None, :]  # the rest is counted in the chunks' own blocks
            copies = np.asarray(rows.column(rows.schema.get_field_index("copies")))
            count = matrix @ copies
            some = np.flatnonzero((count > 0) | (label != np.arange(len(label))))
            nodes = rows.column(rows.schema.get_field_index(node))
            yield pa.record_batch(
                [nodes.take(pa.array(some)), nodes.take(pa.array(label[some])), pa.array(count[some].astype(np.int64))],
                ["node", "root", "linked"],
            )

    found = materialize(dealt.mapInArrow(compare, schema), name)
    counts = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    return counts, found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
