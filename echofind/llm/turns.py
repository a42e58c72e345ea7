"""Repairing the turns of conversations at least cost, by a grammar-compressed dynamic program.

A conversation is right if its role initials read ``(s?(ua)+)?``. Rows are kept (K, 0),
given the role user or assistant (R, 3), or deleted (D, 4; a must for blank rows and
repeats); empty rows of either role are inserted anywhere (I, 3); a truncated row that
stays adds 3. The audit holds the letters of the cheapest edits in order, of equal
ones the least.

Each row is one symbol: its role's initial with its first fault. Re-Pair gives pairs of
symbols that repeat over the conversations of a task a rule each; a rule has one
min-plus transfer matrix over the states of the expected roles, made from those of its
two parts, whose cells hold a cost and the audit as a rope that shares its parts.
Inserts stand before the row they precede, so no audit of a cell is the head of
another, and the least of a joint is the joint of the least.

Rows are sorted by range of conversation, turn and a hash, so that a conversation may
span tasks. One that lies within a task and is short is repaired there. The others
leave as pieces of at most ``PIECE_ROWS`` rows; repeats are found over all pieces by a
grouping, their symbols (a byte a row, as many as the audit has letters anyway) are
solved together, and the pieces are then repaired each by itself. Their texts meet only
in the stream of the digest, batch by batch, as SHA-256 has an order.

Defined results: a NULL role or text counts as one space; rows stand by turn, NULL
first, those of one turn by a hash of role and text (equal rows cannot be told apart);
a NULL conversation is one of its own; rows that repeat are duplicates; an empty table
gives an empty result. Columns other than conv_id, turn, role and text are not read.
Rows are numbered where they are read, so give a table, not a plan that orders its
rows anew when a task is run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from echofind.session import materialize

#: Rows and characters from which on a conversation is handled in pieces.
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 16
#: Rows whose conversations are compressed together.
BLOCK_ROWS = 20_000
#: Symbols that are compressed at a time; the matrices of a longer sequence's parts are multiplied.
SEGMENT = 1 << 20
#: Rules of a task's grammar, and sequences whose audit it remembers, before it starts anew.
RULES, REMEMBERED = 100_000, 200_000

SPACES = " \t\n\x0b\x0c\r"
ROLES = "sua"  # any other initial is the fourth
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3

# States: nothing yet, after the system's row, a user's row, an assistant's row.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Inserts that lead from one state to another, at least.
_INSERTS = {0: {0: 0, 2: 1, 3: 2}, 1: {1: 0, 2: 1, 3: 2}, 2: {2: 0, 3: 1}, 3: {3: 0, 2: 1}}
_STATES = range(4)


class Ropes:
    """Audits as trees that share their parts; one number per text of up to ``LEAF`` letters or pair of parts."""

    LEAF = 32

    def __init__(self):
        self.text: list[str | None] = [""]
        self.parts: list[tuple[int, int] | None] = [None]
        self.size = [0]
        self.known: dict = {"": 0}

    def leaf(self, text: str) -> int:
        if text not in self.known:
            self.known[text] = self._add(text, None, len(text))
        return self.known[text]

    def _add(self, text, parts, size) -> int:
        self.text.append(text)
        self.parts.append(parts)
        self.size.append(size)
        return len(self.size) - 1

    def join(self, a: int, b: int) -> int:
        if not a or not b:
            return a or b
        size = self.size[a] + self.size[b]
        if size <= self.LEAF:
            return self.leaf(self.text[a] + self.text[b])
        if (a, b) not in self.known:
            self.known[a, b] = self._add(None, (a, b), size)
        return self.known[a, b]

    def flat(self, rope: int) -> str:
        out, todo = [], [rope]
        while todo:
            at = todo.pop()
            if self.parts[at]:
                left, right = self.parts[at]
                todo += (right, left)
            else:
                out.append(self.text[at])
        return "".join(out)

    def less(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` stands before that of ``b``; parts they share are not read."""
        left, right = [a], [b]
        while left and right:
            x, y = left.pop(), right.pop()
            if x == y:
                continue
            if self.parts[x] and self.size[x] >= self.size[y]:
                left += self.parts[x][::-1]
                right.append(y)
            elif self.parts[y]:
                right += self.parts[y][::-1]
                left.append(x)
            elif self.parts[x]:
                left += self.parts[x][::-1]
                right.append(y)
            else:
                s, t = self.text[x], self.text[y]
                n = min(len(s), len(t))
                if s[:n] != t[:n]:
                    return s < t
                if len(s) > n:
                    left.append(self.leaf(s[n:]))
                if len(t) > n:
                    right.append(self.leaf(t[n:]))
        return bool(right)


#: A row's terminal: by initial (4) and whether it is truncated; one for all rows that must go.
GONE = 8


def terminals(codes: np.ndarray) -> np.ndarray:
    """Grammar terminals of row codes (four times the place of the initial, plus the fault)."""
    fault = codes & 3
    return np.where((fault == BLANK) | (fault == DUPLICATE), GONE, (codes >> 2) * 2 + (fault == TRUNCATED)).astype(np.int64)


class Grammar:
    """Rules over terminals, each with its transfer matrix."""

    def __init__(self):
        self.ropes = Ropes()
        self.rules: dict[tuple[int, int], int] = {}
        self.matrix = [self._terminal(t) for t in range(GONE + 1)]
        self.solved: dict[bytes, tuple[int, str]] = {}

    def _better(self, new, old) -> bool:
        return old is None or new[0] < old[0] or (new[0] == old[0] and new[1] != old[1] and self.ropes.less(new[1], old[1]))

    def _terminal(self, terminal: int) -> list[dict[int, tuple[int, int]]]:
        initial, cut = (ROLES + "-")[terminal // 2 % 4], CUT * (terminal % 2)
        rows = []
        for state in _STATES:
            row: dict = {}

            def offer(to, cost, letters):
                cell = (cost, self.ropes.leaf(letters))
                if self._better(cell, row.get(to)):
                    row[to] = cell

            for at, n in _INSERTS[state].items():
                offer(at, INSERT * n + DELETE, "I" * n + "D")
                if terminal != GONE:
                    if at in _NEXT.get(initial, {}):
                        offer(_NEXT[initial][at], INSERT * n + cut, "I" * n + "K")
                    offer(_NEXT["a" if at == 2 else "u"][at], INSERT * n + RETYPE + cut, "I" * n + "R")
            rows.append(row)
        return rows

    def times(self, row: dict, matrix: list[dict]) -> dict:
        """One row of a min-plus product."""
        out: dict = {}
        for at, (cost, rope) in row.items():
            for to, (more, tail) in matrix[at].items():
                known = out.get(to)
                if known is None or cost + more <= known[0]:
                    cell = (cost + more, self.ropes.join(rope, tail))
                    if self._better(cell, known):
                        out[to] = cell
        return out

    def rule(self, a: int, b: int) -> int:
        if (a, b) not in self.rules:
            self.matrix.append([self.times(row, self.matrix[b]) for row in self.matrix[a]])
            self.rules[a, b] = len(self.matrix) - 1
        return self.rules[a, b]

    def compress(self, symbols: np.ndarray) -> np.ndarray:
        """Re-Pair over sequences parted by -1: all pairs at least half as frequent as the first give way in a round."""
        while len(symbols) > 1:
            left, right = symbols[:-1], symbols[1:]
            at = np.flatnonzero((left >= 0) & (right >= 0))
            pair, place, often = np.unique(left[at] * len(self.matrix) + right[at], return_inverse=True, return_counts=True)
            if not len(pair) or often.max() < 2:
                break
            chosen = often * 2 > often.max()
            turn = np.empty(len(pair), np.int64)
            turn[np.lexsort((-pair, often))] = np.arange(1, len(pair) + 1)
            first = np.zeros(len(symbols) + 1, np.int64)  # by place + 1: how soon the pair that starts there is replaced
            first[at + 1] = np.where(chosen, turn, 0)[place]
            best = first[1:-1]
            wins = (best > 0) & (first[:-2] <= best) & (first[2:] <= best)
            where = np.flatnonzero(wins)
            head = np.ones(len(where), bool)  # of pairs that overlap, as in aaa, every other one from the left
            head[1:] = (where[1:] != where[:-1] + 1) | (best[where[1:]] != best[where[:-1]])
            nth = np.arange(len(where))
            where = where[(nth - np.maximum.accumulate(np.where(head, nth, 0))) % 2 == 0]
            size, named = len(self.matrix), {}
            made = pair[place[np.searchsorted(at, where)]]
            for code in np.unique(made).tolist():
                named[code] = self.rule(*divmod(code, size))
            symbols = symbols.copy()
            symbols[where] = [named[code] for code in made.tolist()]
            symbols = np.delete(symbols, where + 1)
        return symbols

    def _end(self, row: dict) -> tuple[int, str]:
        ends = {0: 0, 1: 2, 2: 1, 3: 0}
        return min((cost + INSERT * ends[at], self.ropes.flat(rope) + "I" * ends[at]) for at, (cost, rope) in row.items())

    def solve(self, sequences: list[bytes]) -> dict[bytes, tuple[int, str]]:
        """Cost and audit of each sequence of row codes."""
        new = [s for s in dict.fromkeys(sequences) if s not in self.solved]
        if new:
            rows = {s: {0: (0, 0)} for s in new}
            parts = [(s, s[i : i + SEGMENT]) for s in new for i in range(0, len(s), SEGMENT)]
            start = size = 0
            for stop, (_, part) in enumerate(parts, 1):
                size += len(part)
                if size >= SEGMENT or stop == len(parts):
                    self._advance(rows, parts[start:stop])
                    start, size = stop, 0
            self.solved |= {s: self._end(row) for s, row in rows.items()}
        return self.solved

    def _advance(self, rows: dict, parts: list[tuple[bytes, bytes]]) -> None:
        """Carry the cells of some sequences over their next parts, compressed together."""
        gap = np.full(1, -1, np.int64)
        packed = self.compress(np.concatenate([p for _, part in parts for p in (terminals(np.frombuffer(part, np.uint8)), gap)]))
        ends = np.flatnonzero(packed < 0)
        for (s, _), a, b in zip(parts, [0, *(ends[:-1] + 1).tolist()], ends.tolist()):
            for symbol in packed[a:b].tolist():
                rows[s] = self.times(rows[s], self.matrix[symbol])

    def full(self) -> bool:
        return len(self.matrix) > RULES or len(self.solved) > REMEMBERED


def apply(audit: str, roles: list[str], texts: list[str], state: int = 0) -> tuple[list[str], list[str], int]:
    """Roles and texts that an audit leaves of some rows, and the state reached."""
    out_roles, out_texts, i = [], [], 0
    for letter in audit:
        expected = "assistant" if state == 2 else "user"
        if letter == "D":
            i += 1
            continue
        if letter == "I":
            role, text = expected, ""
        else:
            role, text = roles[i] if letter == "K" else expected, texts[i]
            i += 1
        out_roles.append(role)
        out_texts.append(text)
        state = _NEXT[role[0]][state]
    return out_roles, out_texts, state


def faults(codes: bytes) -> list[int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials are not su, ua or au."""
    code = np.frombuffer(codes, np.uint8)
    count = np.bincount(code & 3, minlength=4)
    role = code >> 2
    pairs = role[:-1] * 4 + role[1:]
    return [*count[1:].tolist(), int(len(pairs) - np.isin(pairs, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]).sum())]


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows by conversation and turn, with their codes (repeats not yet among the faults)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    solid = F.rtrim(text, F.lit(SPACES))
    fault = F.when(solid == "", BLANK).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    order = ["conv", "turn", "tie", "number"]
    return (
        conversations.select(
            F.col("conv_id").alias("conv"),
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            (place * 4 + fault).cast("int").alias("code"),
            F.md5(F.concat(role, F.lit("\0"), text)).alias("tie"),
            F.monotonically_increasing_id().alias("number"),  # parts equal rows over tasks
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", "turn", "role", "text", "code")
    )


class _Conversation:
    """Rows of one conversation, as far as a task has read and not yet passed them on."""

    def __init__(self, conv, spans: bool):
        self.conv, self.spans = conv, spans
        self.clear()

    def clear(self):
        self.turns, self.roles, self.texts, self.codes, self.chars = [], [], [], bytearray(), 0

    def add(self, turn, role, text, code):
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.codes.append(code)
        self.chars += len(text) + len(role)

    def full(self) -> bool:
        return len(self.codes) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def stretch(self) -> tuple[int | None, int | None, int]:
        """First, last and number of distinct turns."""
        known = {t for t in self.turns if t is not None}
        return (min(known), max(known), len(known)) if known else (None, None, 0)

    def mark_repeats(self):
        seen = set()
        for i, row in enumerate(zip(self.roles, self.texts)):
            if row in seen and self.codes[i] & 3 != BLANK:
                self.codes[i] = self.codes[i] & ~3 | DUPLICATE
            seen.add(row)


def _gaps(least, most, distinct) -> int:
    return most - least + 1 - distinct if distinct else 0


def _digest(roles, texts) -> str:
    return hashlib.sha256("\n".join(map(":".join, zip(roles, texts))).encode("utf-8", "surrogatepass")).hexdigest()


FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_FOUND = [*[StructField(n, LongType()) for n in FOUND], StructField("audit", StringType())]
_ROWS = [StructField("roles", ArrayType(StringType())), StructField("texts", ArrayType(StringType()))]
_PIECE = [
    StructField("part", IntegerType()),
    StructField("no", IntegerType()),
    StructField("codes", BinaryType()),
    StructField("first", LongType()),
    StructField("last", LongType()),
    StructField("distinct", LongType()),
]
_DIGEST = StructField("repaired_sha256", StringType())


def _batch(rows: list[tuple], schema: StructType, kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(list(c), t.type) for c, t in zip(columns, kinds)], [f.name for f in schema])


def _kinds(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _scanned(conversations: DataFrame, keep_rows: bool) -> DataFrame:
    """Repaired conversations (``no`` is NULL) and pieces of those that span tasks or are long."""
    ordered = _ordered(conversations)
    schema = StructType([ordered.schema["conv"], *_PIECE, *_ROWS, *_FOUND, _DIGEST])
    kinds = _kinds(schema)
    no_piece, not_found = (None,) * len(_PIECE), (None,) * (len(_FOUND) + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, grammar = TaskContext.get().partitionId(), Grammar()
        held, waiting, pieces, now = [], 0, [], None
        n_pieces = 0

        def flush():
            nonlocal grammar
            if grammar.full():
                grammar = Grammar()
            solved = grammar.solve([bytes(c.codes) for c in held])
            out = []
            for c in held:
                cost, audit = solved[bytes(c.codes)]
                roles, texts, _ = apply(audit, c.roles, c.texts)
                rows = (roles, texts) if keep_rows else (None, None)
                out.append((c.conv, *no_piece, *rows, _gaps(*c.stretch()), *faults(bytes(c.codes)), cost, audit, _digest(roles, texts)))
            held.clear()
            return _batch(out, schema, kinds)

        def piece(c):
            nonlocal n_pieces
            pieces.append((c.conv, part, n_pieces, bytes(c.codes), *c.stretch(), c.roles, c.texts, *not_found))
            n_pieces += 1
            c.spans = True
            c.clear()

        def ends(c):
            nonlocal waiting
            if c.spans:
                if c.codes:
                    piece(c)
            else:
                c.mark_repeats()
                held.append(c)
                waiting += len(c.codes)

        for batch in batches:
            for conv, *row in zip(*[column.to_pylist() for column in batch.columns]):
                if now is None:
                    now = _Conversation(conv, spans=True)  # it may have begun in the task before
                elif conv != now.conv:
                    ends(now)
                    now = _Conversation(conv, spans=False)
                now.add(*row)
                if now.full():
                    piece(now)
                    if len(pieces) >= 64:
                        yield _batch(pieces, schema, kinds)
                        pieces.clear()
                if waiting >= BLOCK_ROWS:
                    yield flush()
                    waiting = 0
        if now is not None and now.codes:
            piece(now)  # it may go on in the next task
        yield flush()
        yield _batch(pieces, schema, kinds)

    return ordered.mapInArrow(scan, schema)


def _solved_pieces(pieces: DataFrame) -> DataFrame:
    """The letters of the audit for each piece, with the state before it; the last one has what was found in all."""
    each = pieces.select("conv", "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    keyed = each.select(
        "conv", F.struct("part", "no", "at").alias("place"), F.md5(F.concat("row.roles", F.lit("\0"), "row.texts")).alias("key")
    )
    firsts = keyed.groupBy("conv", "key").agg(F.min("place").alias("least"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv").alias("c"), F.col("key").alias("k"), "least")
    again = keyed.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where("place > least")
    repeats = again.groupBy("place.part", "place.no").agg(F.collect_list("place.at").alias("repeats"))
    one = F.struct("part", "no", "codes", "first", "last", "distinct", "repeats").alias("piece")
    gathered = pieces.join(repeats, ["part", "no"], "left").select("conv", one).groupBy("conv")
    gathered = gathered.agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    schema = StructType(
        [
            StructField("part", IntegerType()),
            StructField("no", IntegerType()),
            StructField("letters", StringType()),
            StructField("state", IntegerType()),
            StructField("place", LongType()),
            StructField("is_last", IntegerType()),
            *_FOUND,
        ]
    )
    kinds = _kinds(schema)

    def solve(batches):
        grammar = Grammar()
        for batch in batches:
            for pieces in batch.column(1):
                pieces = pieces.as_py()
                codes = bytearray()
                distinct, least, before = 0, None, None
                for p in pieces:
                    own = bytearray(p["codes"])
                    for i in p["repeats"] or ():
                        if own[i] & 3 != BLANK:
                            own[i] = own[i] & ~3 | DUPLICATE
                    codes += own
                    if p["distinct"]:
                        distinct += p["distinct"] - (before == p["first"])
                        least, before = p["first"] if least is None else least, p["last"]
                if grammar.full():
                    grammar = Grammar()
                cost, audit = grammar.solve([bytes(codes)])[bytes(codes)]
                found = (_gaps(least, before, distinct), *faults(bytes(codes)), cost, audit)
                out, at, state, place, row = [], 0, 0, 0, 0
                for i, p in enumerate(pieces):
                    last = i == len(pieces) - 1
                    end, rows = at, len(p["codes"])
                    while rows:  # the letters up to that of the piece's last row
                        rows -= audit[end] != "I"
                        end += 1
                    end = len(audit) if last else end
                    letters = audit[at:end]
                    out.append((p["part"], p["no"], letters, state, place, int(last), *(found if last else (None,) * len(found))))
                    state = _walk(letters, state, codes[row : row + len(p["codes"])])
                    place, at, row = place + len(letters) - letters.count("D"), end, row + len(p["codes"])
                yield _batch(out, schema, kinds)

    return gathered.mapInArrow(solve, schema)


def _walk(letters: str, state: int, codes: bytes) -> int:
    """The state after some letters of an audit over rows with these codes."""
    i = 0
    for letter in letters:
        if letter == "D":
            i += 1
            continue
        initial = "a" if state == 2 else "u"
        if letter != "I":
            initial = (ROLES + "-")[codes[i] >> 2] if letter == "K" else initial
            i += 1
        state = _NEXT[initial][state]
    return state


def audits(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    One row per conversation. ``gaps`` are turns that lack between the first and the
    last; a row's first fault counts: blank, duplicate (role and text seen earlier),
    truncated (not ended by ``.!?``). The digest is that of the repaired rows as
    ``role:text``, joined by line breaks.
    """
    found = materialize(_scanned(conversations, keep_rows=False), "turns")
    pieces = found.where("no IS NOT NULL").select("conv", *[f.name for f in (*_PIECE, *_ROWS)])
    named = [*FOUND, "audit", "repaired_sha256"]
    done = found.where("no IS NULL").select(F.col("conv").alias("conv_id"), *named)
    solved = _solved_pieces(pieces)
    parts = pieces.select("conv", "part", "no", "roles", "texts").join(solved, ["part", "no"])
    parts = parts.repartition("conv").sortWithinPartitions("conv", "part", "no")
    schema = StructType([found.schema["conv"], *_FOUND, _DIGEST])
    kinds = _kinds(schema)
    columns = ["conv", "roles", "texts", "letters", "state", "is_last", *FOUND, "audit"]

    def hashed(batches):
        digest, filled = hashlib.sha256(), False
        for batch in batches:
            for start in range(0, len(batch), 64):  # few texts as Python strings at a time
                out = []
                for row in zip(*[column.to_pylist() for column in batch.slice(start, 64).columns]):
                    conv, roles, texts, letters, state, is_last, *found = row
                    roles, texts, _ = apply(letters, roles, texts, state)
                    for role, text in zip(roles, texts):
                        digest.update(("\n" * filled + role + ":" + text).encode("utf-8", "surrogatepass"))
                        filled = True
                    if is_last:
                        out.append((conv, *found, digest.hexdigest()))
                        digest, filled = hashlib.sha256(), False
                yield _batch(out, schema, kinds)

    rest = parts.select(*columns).mapInArrow(hashed, schema)
    return done.union(rest.select(F.col("conv").alias("conv_id"), *named))


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired rows: ``conv_id``, ``place`` (from 0), ``role`` and ``text``."""
    found = materialize(_scanned(conversations, keep_rows=True), "turns")
    names = [f.name for f in (*_PIECE, *_ROWS)]
    pieces = found.where("no IS NOT NULL").select("conv", *names)
    done = found.where("no IS NULL").select("conv", F.lit(0).cast("long").alias("place"), "roles", "texts")
    parts = pieces.select("conv", "part", "no", "roles", "texts").join(_solved_pieces(pieces), ["part", "no"])
    schema = StructType([found.schema["conv"], StructField("place", LongType()), *_ROWS])
    kinds = _kinds(schema)

    def applied(batches):
        for batch in batches:
            for start in range(0, len(batch), 64):
                rows = zip(*[column.to_pylist() for column in batch.slice(start, 64).columns])
                out = [(conv, place, *apply(letters, roles, texts, state)[:2]) for conv, place, roles, texts, letters, state in rows]
                yield _batch(out, schema, kinds)

    rest = parts.select("conv", "place", "roles", "texts", "letters", "state").mapInArrow(applied, schema)
    each = done.union(rest).select("conv", "place", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    return each.select(F.col("conv").alias("conv_id"), (F.col("place") + F.col("at")).alias("place"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))
