import hashlib
import random
import re

import edges
import numpy as np
import pytest

from compare import connect, spark_rows, sql_rows
from echofind.llm import fill_middle, queries

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plain_code(doc_id, text, unit="line", rate=100, suffix_first=50):
    """The transformation on code points, one text at a time."""
    text = text or ""
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = LINE.findall(text) if unit == "line" else list(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(5)
    signs = ["a", "b ", "\n", "\n\n", "é", "漢", "😀", "<", "P>", "<P", "S>", "<M", "\r", " ", "x" * 50]
    out = ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(600)]
    out += [None, "", "\n", "\n\n", "no line break", "a <P> b\n", "<M>", "é\n" * 3, "😀", "<\nS>", "last\nline <"]
    return out + ["line é of a long text\n" * 150_000, "漢" * 1_200_000]


@pytest.mark.parametrize("unit, rate, first", [("line", 100, 50), ("character", 100, 50), ("line", 70, 0), ("character", 30, 100)])
def test_equals_plain_code(spark, unit, rate, first):
    rows = list(enumerate(texts())) + [(None, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = fill_middle.transform(docs, unit=unit, rate=rate, suffix_first=first, check=True)
    found = out.select("row.*", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    assert len(found) == len(rows) and {r["form"] for r in found} >= {"plain", "psm"} - ({"psm"} if first == 100 else set())
    for r in found:
        assert tuple(r[2:7]) == plain_code(r["doc_id"], r["text"], unit, rate, first)
        assert r["restored"] == (r["text"] or "")
    again = fill_middle.restore(out).select("row.text", "restored").collect()
    assert all(r["restored"] == (r["text"] or "") for r in again)


def test_index_of_exceptions():
    text = "aé漢😀b" * 3 + "plain"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fill_middle.Exceptions(data)
    assert len(index.byte) == 9  # only characters of more than one byte are recorded
    cuts = np.arange(len(text) + 1)
    sizes = np.array([len(text[:c].encode()) for c in cuts])
    assert (index.bytes(cuts) == sizes).all() and (index.points(sizes) == cuts).all()
    assert not len(fill_middle.Exceptions(np.frombuffer(b"ascii only", np.uint8)).byte)


def test_marks_that_could_hide(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "P<", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.transform(docs, marks=marks)
    with pytest.raises(ValueError):
        fill_middle.transform(docs, unit="word")


def test_edges(spark, tmp_path):
    docs = edges.documents(spark)
    out = fill_middle.transform(docs, check=True)
    rows = out.collect()
    assert len(rows) == docs.count() and set(out.select("row.*").columns) == set(docs.columns)
    assert all(r["restored"] == (r["row"]["text"] or "") for r in rows)
    assert fill_middle.transform(edges.empty(spark)).count() == 0
    folder = edges.write(spark, tmp_path, documents=docs)
    assert queries.op13_fill_middle(spark, folder).count() == len(rows)


def test_query_equals_sql(spark, sf_dir):
    found = queries.op13_fill_middle(spark, sf_dir)
    assert spark_rows(found) == sql_rows(connect(sf_dir), queries.SQL["op13_fill_middle"])
