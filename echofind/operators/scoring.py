"""Scoring of vector blocks inside one task.

A block of queries meets a block of reports: one matrix product in single
precision gives all cosines to within a known error. Only pairs that can still
enter a query's best k within that error are looked at further, in double
precision, so after the first blocks nearly all pairs cost one multiplication
and one comparison. Ties go to the lower id.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from echofind.functions.vectors import NAN_UNITS, UNITS, matrix, unit_rows, units_to_distance

NO_ID = np.iinfo(np.int64).max
EMPTY = 2**31 - 2  # above every distance, NaN included
HITS = "query_id bigint, id bigint, distance double"

_TALL, _WIDE = 512, 2_048  # queries and reports of a tile, whose cosines are held at once
_PAIRS = 50_000  # pairs looked at again at once
# Below every cosine, in falling order: a zero vector takes part; the list of a
# query is not full; a filter rules the pair out.
_UNDEFINED, _OPEN, _BARRED = -3.0, -4.0, -5.0


@dataclass
class QueryBlock:
    """Query vectors with what each of them allows as an answer."""

    ids: np.ndarray
    vectors: np.ndarray
    exclude: np.ndarray
    filters: dict[str, np.ndarray]
    rows_of_key: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.vectors, self.undefined = _unit_or_zero(self.vectors)
        self.rough = self.vectors.astype(np.float32)

    @classmethod
    def of(cls, table: pa.Table, filters: tuple[str, ...] = (), keyed: bool = False) -> QueryBlock:
        block = cls(
            ids=table["query_id"].to_numpy(),
            vectors=matrix(table["embedding"]),
            exclude=table["exclude_id"].fill_null(NO_ID).to_numpy(),
            filters={f: np.array([v or None for v in table[f].to_pylist()], dtype=object) for f in filters},
        )
        if keyed:
            block.rows_of_key = _rows_by_value(*_keys(table))
        return block


class TopK:
    """The best k reports seen so far, for each query of a block; with ``least``, of those from that cosine on."""

    def __init__(self, queries: int, k: int, least: float | None = None):
        self.k = k
        self.least = least
        self.units = np.full((queries, k), EMPTY, dtype=np.int64)
        self.ids = np.full((queries, k), NO_ID, dtype=np.int64)

    def floor(self, rows: np.ndarray) -> np.ndarray:
        """The lowest cosine that could still enter, one unit of slack included."""
        last = self.units[rows, -1]
        floor = 1.0 - (last + 1) / UNITS
        floor[last == NAN_UNITS] = _UNDEFINED
        floor[last == EMPTY] = _OPEN
        return floor if self.least is None else np.maximum(floor, self.least)

    def offer(self, rows: np.ndarray, units: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates, one per element; an id offered twice counts once."""
        if len(rows) == 0:
            return
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, self.k), rows])
        units = np.concatenate([self.units[touched].ravel(), units])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((units, ids, rows))
        rows, units, ids = rows[order], units[order], ids[order]
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]) | (ids[1:] == NO_ID)
        rows, units, ids = rows[first], units[first], ids[first]
        order = np.lexsort((ids, units, rows))
        rows, units, ids = rows[order], units[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        # A row keeps k entries at least: its own old ones, empty or not, less double ids.
        self.units[touched], self.ids[touched] = EMPTY, NO_ID
        self.units[rows[kept], place[kept]] = units[kept]
        self.ids[rows[kept], place[kept]] = ids[kept]

    def to_batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        row, col = np.nonzero(self.units != EMPTY)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(query_ids[row], pa.int64()),
                pa.array(self.ids[row, col], pa.int64()),
                pa.array(units_to_distance(self.units[row, col]), pa.float64()),
            ],
            names=["query_id", "id", "distance"],
        )


    def to_table(self, query_ids) -> pa.Table:
        return pa.Table.from_batches([self.to_batch(np.asarray(query_ids, dtype=np.int64))])


class ReportBlock:
    """A block of reports, in id order so that column order breaks ties.

    Of reports with equal vectors and filter values only the k + 1 lowest ids
    can be among the best k of a query (it may exclude one), so a block full
    of copies is cut down before it is scored.
    """

    def __init__(self, data, k: int, filters: tuple[str, ...] = (), keyed: bool = False):
        ids = _column(data, "id").to_numpy(zero_copy_only=False)
        vectors = matrix(_column(data, "embedding"))
        values = {f: np.array(_column(data, f).to_pylist(), dtype=object) for f in filters}
        order = np.argsort(ids, kind="stable")
        keys, rows_of_keys = _keys(data) if keyed else (None, None)
        alike = list(values.values())
        if keyed and "key" in data.schema.names:
            alike.append(keys)
        order = order[_first_copies(vectors[order], [v[order] for v in alike], k + 1)]
        self.ids = ids[order]
        self.vectors, self.undefined = _unit_or_zero(vectors[order])
        self.rough = self.vectors.astype(np.float32)
        self.filters = {f: v[order] for f, v in values.items()}
        self.rows_of_key: dict[int, np.ndarray] = {}
        if keyed:
            place = np.full(len(ids), -1)
            place[order] = np.arange(len(order))
            rows = place[rows_of_keys]
            by_key = _rows_by_value(keys[rows >= 0], rows[rows >= 0])
            self.rows_of_key = {key: np.sort(part) for key, part in by_key.items()}


def _keys(data) -> tuple[np.ndarray, np.ndarray]:
    """Key values and the rows they belong to, from one key or a list of keys per row."""
    if "key" in data.schema.names:
        keys = _column(data, "key").to_numpy(zero_copy_only=False)
        return keys, np.arange(len(keys))
    lists = _column(data, "keys")
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def score(queries: QueryBlock, reports: ReportBlock, best: TopK, keyed: bool = False) -> None:
    """Offer the reports to the queries; with keys, only where a key is shared."""
    if len(reports.ids) == 0:
        return
    if not keyed:
        _score_rows(queries, reports, best, np.arange(len(queries.ids)), slice(None))
        return
    for key, columns in reports.rows_of_key.items():
        rows = queries.rows_of_key.get(key)
        if rows is not None:
            _score_rows(queries, reports, best, rows, columns)


def _score_rows(queries, reports, best, rows, columns) -> None:
    ids, vectors, undefined = reports.ids[columns], reports.vectors[columns], reports.undefined[columns]
    rough, slack = reports.rough[columns], _rough_error(vectors.shape[1])
    values = {name: column[columns] for name, column in reports.filters.items()}
    # reports of a tile after one another: all queries raise their floors with it
    for left, start in itertools.product(range(0, len(ids), _WIDE), range(0, len(rows), _TALL)):
        part, wide = rows[start : start + _TALL], slice(left, left + _WIDE)
        cosine = queries.rough[part] @ rough[wide].T
        cosine[:, undefined[wide]] = _UNDEFINED
        cosine[queries.undefined[part]] = _UNDEFINED
        for name, wanted in queries.filters.items():
            _apply_filter(cosine, wanted[part], values[name][wide])
        floor = best.floor(part)
        _raise_floor(floor, best, part, cosine, slack)
        least = np.nextafter((floor - slack).astype(np.float32), np.float32(-np.inf))
        row, column = divmod(np.flatnonzero(cosine >= least[:, None]), cosine.shape[1])
        column += left
        allowed = queries.exclude[part[row]] != ids[column]
        row, column = row[allowed], column[allowed]
        exact = np.empty(len(row))
        for at in range(0, len(row), _PAIRS):
            some = slice(at, at + _PAIRS)
            exact[some] = np.einsum("ij,ij->i", queries.vectors[part[row[some]]], vectors[column[some]])
        exact[undefined[column] | queries.undefined[part[row]]] = _UNDEFINED
        enters = exact >= floor[row]
        row, column = row[enters], column[enters]
        best.offer(part[row], _units(exact[enters]), ids[column])


def _rough_error(width: int) -> float:
    """A bound on the error of a single precision cosine of unit vectors, each of them rounded as well."""
    return (width + 8) * 2.0**-23


def _raise_floor(floor: np.ndarray, best: TopK, part: np.ndarray, cosine: np.ndarray, slack: float) -> None:
    """Where a list is not full, start from the (k + 1)th best cosine of this tile.

    One report may be excluded, hence k + 1; a unit and the cosines' error of slack keep all its ties.
    """
    if cosine.shape[1] <= best.k + 1:
        return
    open_rows = np.flatnonzero(best.units[part, -1] == EMPTY)
    if best.least is not None:
        reach = (cosine[open_rows] >= np.float32(best.least)).sum(1)
        open_rows = open_rows[reach > best.k]
    if len(open_rows):
        least = -np.partition(-cosine[open_rows], best.k, axis=1)[:, best.k].astype(np.float64)
        defined = least >= -1.5
        raised = np.where(defined, least - slack - 1 / UNITS, np.where(least == _UNDEFINED, _UNDEFINED, _OPEN))
        floor[open_rows] = np.maximum(floor[open_rows], raised)


def _units(cosine: np.ndarray) -> np.ndarray:
    units = np.rint(np.clip(1.0 - cosine, 0.0, 2.0) * UNITS).astype(np.int64)
    units[cosine == _UNDEFINED] = NAN_UNITS
    return units


def _unit_or_zero(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which rows are zero and have no direction."""
    undefined = ~vectors.any(axis=1) if vectors.size else np.zeros(len(vectors), dtype=bool)
    units = unit_rows(vectors)
    units[undefined] = 0.0
    return units, undefined


def _apply_filter(cosine: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> None:
    """No wanted value means no filter; a NULL value never matches."""
    for value in {w for w in wanted if w is not None}:
        cosine[np.ix_(wanted == value, values != value)] = _BARRED


def _first_copies(vectors: np.ndarray, values: list[np.ndarray], n: int) -> np.ndarray:
    """Rows to keep: of rows with equal vectors and values, the first n."""
    keep = np.ones(len(vectors), dtype=bool)
    if len(vectors) <= n:
        return keep
    # Equal rows have equal prints (nearly always); only large groups are looked at byte by byte.
    prints = vectors @ np.linspace(1.0, 2.0, vectors.shape[1])
    _, group, size = np.unique(prints, return_inverse=True, return_counts=True)
    crowded = np.flatnonzero(size[group] > n)
    if len(crowded):
        seen: dict[tuple, int] = {}
        for row in crowded:
            same = (vectors[row].tobytes(), *(v[row] for v in values))
            seen[same] = seen.get(same, 0) + 1
            keep[row] = seen[same] <= n
    return keep


def _rows_by_value(values: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    cuts = np.flatnonzero(np.diff(values)) + 1
    starts = np.concatenate([[0], cuts]).astype(int)
    return {int(values[s]): part for s, part in zip(starts, np.split(rows, cuts))} if len(values) else {}


def _column(data, name: str):
    column = data.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
