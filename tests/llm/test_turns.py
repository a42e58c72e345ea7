import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import edges
import numpy as np
import pytest

from echofind.llm import queries, turns

ORDER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_repair(rows):
    """Cheapest edits of (turn, role, text) rows, searched row by row from the end."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserts):
        """Least (cost, audit) from row i on."""
        out = []
        for initial, to in ORDER[state].items():
            if initial != "s" and inserts < 3:
                cost, audit = best(i, to, inserts + 1)
                out.append((cost + 3, "I" + audit))
            if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                cost, audit = best(i + 1, to, 0)
                if rows[i][1][:1] == initial:
                    out.append((cost + extra, "K" + audit))
                if initial != "s":
                    out.append((cost + extra + 3, "R" + audit))
        if i < len(rows):
            cost, audit = best(i + 1, state, 0)
            out.append((cost + 4, "D" + audit))
        elif state in (0, 3):
            out.append((0, ""))
        return min(out) if out else (10**9, "")

    cost, audit = best(0, 0, 0)
    i, state, kept = 0, 0, []
    for letter in audit:
        expected = "assistant" if state == 2 else "user"
        role, text = (expected, "") if letter == "I" else rows[i][1:]
        i += letter != "I"
        if letter != "D":
            kept.append((role if letter == "K" else expected, text))
            state = ORDER[state][kept[-1][0][0]]
    known = {t for t, _, _ in rows if t is not None}
    return (
        max(known) - min(known) + 1 - len(known) if known else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        cost,
        audit,
        kept,
    )


def with_digest(found):
    return (*found[:-1], hashlib.sha256("\n".join(map(":".join, found[-1])).encode()).hexdigest())


def random_rows(seed, conversations, longest=9):
    r = random.Random(seed)
    texts = ["a.", "b!", "c", "d?", "", " \t\n", "é", "ok. ", "x.\x0b", "漢。", "end. "]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", "support", None]
    out = []
    for c in range(conversations):
        for t in range(r.randint(1, longest)):
            text = r.choice([*texts, None, f"say {c} {t}.", f"say {t}"])
            out.append((c, r.choice([t, t, t, None, t + 2, 0]), r.choice(roles), text))
    return out


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: plain_repair(own) for conv, own in groups.items()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("piece_rows, block_rows, parts", [(4096, 20_000, 1), (3, 50, 6), (2, 1, 3)])
def test_equals_plain_search(spark, monkeypatch, piece_rows, block_rows, parts):
    monkeypatch.setattr(turns, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(turns, "BLOCK_ROWS", block_rows)
    rows = random_rows(piece_rows, 150) + [(None, *r[1:]) for r in random_rows(1, 1, 30)]
    rows += [(1000, t, r, f"long {t}.") for t, r in enumerate(["user", "assistant", "assistant"] * 40)]
    rows += [(1001, None, "user", "the same.")] * 60 + [(1002, 5, None, None)] * 30
    wanted = expected(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        table = spark.createDataFrame(rows, SCHEMA).repartition(2).cache()
        found = {r["conv_id"]: tuple(r)[1:] for r in turns.audits(table).collect()}
        kept = defaultdict(dict)
        for conv, place, role, text in turns.repair(table).collect():
            kept[conv][place] = (role, text)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    assert found.keys() == wanted.keys()
    for conv, plain in wanted.items():
        assert found[conv] == with_digest(plain), (conv, plain)
        assert [kept[conv][i] for i in range(len(plain[-1]))] == plain[-1] and len(kept[conv]) == len(plain[-1])


def test_grammar_shares_rules_and_stays_exact():
    r = random.Random(4)
    phrase = [bytes(r.choices([4, 8, 7, 5, 0, 12, 11, 6], k=40)) for _ in range(4)]
    sequences = [b"".join(r.choices(phrase, k=30)) for _ in range(20)] + [bytes([4, 8]) * 700, bytes([6]) * 999, b""]
    whole, plain = turns.Grammar(), turns.Grammar()
    plain.compress = lambda symbols: symbols  # row by row
    assert whole.solve(sequences) == plain.solve(sequences)
    assert 0 < len(whole.rules) < sum(map(len, sequences)) / 10 and not plain.rules
    packed = whole.compress(turns.terminals(np.frombuffer(sequences[0], np.uint8)))
    assert len(packed) < len(sequences[0]) / 5
    assert whole.solve([b""])[b""] == (0, "")


def test_long_sequences_in_segments(monkeypatch):
    r = random.Random(6)
    sequence = bytes(r.choices([4, 8, 7, 5, 0, 12, 11, 6], k=5000))
    wanted = turns.Grammar().solve([sequence])[sequence]
    monkeypatch.setattr(turns, "SEGMENT", 700)
    assert turns.Grammar().solve([sequence, sequence[:900], b"\x04"])[sequence] == wanted


def test_a_conversation_of_a_third_of_the_rows(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"answer {t % 5000}." if t % 11 else "cut") for t in range(30_000)]
    rows += [(10 + c, t, ("user", "assistant")[t % 2], "fine.") for c in range(10_000) for t in range(6)]
    found = {r["conv_id"]: r for r in turns.audits(spark.createDataFrame(rows, SCHEMA)).where("conv_id IN (7, 10)").collect()}
    turn_texts, seen, codes = rows[:30_000], set(), bytearray()
    for _, _, role, text in turn_texts:
        fault = turns.DUPLICATE if (role, text) in seen else turns.TRUNCATED if text == "cut" else turns.OK
        seen.add((role, text))
        codes.append("sua".index(role[0]) * 4 + fault)
    assert (found[7]["cost"], found[7]["audit"]) == turns.Grammar().solve([bytes(codes)])[bytes(codes)]
    assert found[7]["gaps"] == 0 and found[7]["duplicate"] == 30_000 - len(seen)
    roles, texts, _ = turns.apply(found[7]["audit"], [r[2] for r in turn_texts], [r[3] for r in turn_texts])
    assert found[7]["repaired_sha256"] == hashlib.sha256("\n".join(map(":".join, zip(roles, texts))).encode()).hexdigest()
    assert found[10]["audit"] == "KKDDDD" and found[10]["duplicate"] == 4


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        out += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def check_query(spark, folder):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    wanted = expected(plain_damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_repaired_turns(spark, folder).collect()}
    assert found.keys() == {r[0] for r in rows}
    for conv, row in found.items():
        assert row == (with_digest(wanted[conv]) if conv in wanted else empty), conv


def test_query(spark, sf_dir):
    check_query(spark, sf_dir)


def test_edges(spark, tmp_path):
    rows = random_rows(9, 120, 5) + [(None, None, None, None)] * 2 + [(200, 1, "user", edges.prose(1, 60_000) + ".")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, place long")
    check_query(spark, edges.write(spark, tmp_path, conversations=table))
    nothing = spark.createDataFrame([], SCHEMA)
    assert turns.audits(nothing).count() == 0 and turns.repair(nothing).count() == 0
    assert queries.op11_repaired_turns(spark, edges.write(spark, tmp_path / "empty", conversations=nothing)).count() == 0
