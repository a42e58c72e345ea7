"""CSV files split over tasks against readers that see a file whole."""

import csv as reference
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofind.sources import csv, records

RANGE = "spark.sql.files.maxPartitionBytes"


@pytest.fixture()
def small_ranges(spark):
    before = {c: spark.conf.get(c) for c in (RANGE, "spark.sql.files.openCostInBytes")}
    spark.conf.set(RANGE, "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def _value(pick):
    parts = ["a", "b c", '"', ",", "\n", "\r\n", "x" * 30, "é\U0001f600", '""', '",', ',"', '"\n"', "\n\n"]
    return "".join(pick.choice(parts) for _ in range(pick.randrange(1, 9)))


def _whole(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return [tuple(v if v else None for v in row) for row in reference.reader(f) if row]


def test_states_equal_one_step_at_a_time():
    pick = np.random.default_rng(1)
    for size in (1, 2, 7, 50):
        to_out, to_in = pick.random(size) < 0.4, pick.random(size) < 0.6
        for start in (False, True):
            state, wanted = start, []
            for out, stays in zip(to_out, to_in):
                state = bool(stays if state else out)
                wanted.append(state)
            assert records.states(to_out, to_in, start).tolist() == wanted


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_ranges(spark, small_ranges, tmp_path, end):
    pick, folder = random.Random(end), tmp_path / "up.csv"
    folder.mkdir()
    wanted = []
    for n in range(3):
        path = folder / f"{n}.csv"
        with open(path, "w", encoding="utf-8-sig" if n else "utf-8", newline="") as f:
            out = reference.writer(f, lineterminator=end)
            out.writerow(["bug_id", "summary", "product"])
            for i in range(120):
                out.writerow([f"{n}-{i}", _value(pick), pick.choice(["p", "", _value(pick)])])
            if n == 1:  # one record over many ranges, then more
                out.writerow(["long", 'line, "quoted"\n' * 400, "p"])
                out.writerow(["after", "short", "p"])
        wanted += _whole(path)[1:]
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
    got = csv.read_upload(spark, str(folder)).orderBy("position").select("bug_id", "summary", "product")
    assert [tuple(r) for r in got.collect()] == wanted


def test_positions_are_lines(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_bytes(b'\n"bug_id",summary\n1,"two\nlines"\n\n2,say 5" or 6"\n3,"open, to the end\nof the file\n')
    rows = csv.read_upload(spark, str(path)).orderBy("position").collect()
    assert [(r.position, r.bug_id, r.summary) for r in rows] == [
        (3, "1", "two\nlines"),
        (6, "2", 'say 5" or 6"'),
        (7, "3", "open, to the end\nof the file"),
    ]


def test_empty_files_repeated_and_absent_names(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b"")
    (folder / "b.csv").write_bytes(b"\n\n")
    assert csv.read_upload(spark, str(folder)).count() == 0
    (folder / "c.csv").write_bytes(b"bug_id,summary\n")
    assert csv.read_upload(spark, str(folder)).count() == 0
    (folder / "d.csv").write_bytes(b"x,,X,summary\n1,2,3,4,5\n6\n")
    got = csv._read(spark, str(folder)).select("x0", "_c1", "X2", "summary", "bug_id").collect()
    assert sorted(map(tuple, got), key=str) == [("1", "2", "3", "4", None), ("6", None, None, None, None)]


def test_parsed_in_tasks_without_a_shuffle_of_whole_lines(spark, small_ranges, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text("bug_id,summary\n" + "".join(f"{i},text {i}\n" for i in range(500)))
    df = csv.read_upload(spark, str(path))
    assert df.select(F.sum("bug_id")).first()[0] == sum(range(500))
    assert [r.position for r in df.orderBy("position").limit(2).collect()] == [2, 3]
