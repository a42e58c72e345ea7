import html
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofind.functions import display, text
from echofind.functions.embed import HashEmbedder, embed, embed_report
from echofind.functions.text import Cleaner, clean_text, is_fractional, joined_text, na_to_null, numeric_id

EDGES = [
    # input, service, pipeline
    ("<b>Crash</b> https://example.com\n now", "Crash now", "Crash now"),
    ("see http://x.y<b>foo</b> bar", "see bar", "see foo bar"),
    ("a<>b", "a b", "a<>b"),
    ("www.a.b c", "www.a.b c", "c"),
    ("&lt;b&gt;x", "x", "x"),
    ("&amp;lt;b&amp;gt;x", "&lt;b&gt;x", "&lt;b&gt;x"),
    ("a \u001c b", "a b", "a b"),
    ("&ampfoo", "&foo", "&foo"),
    ("&#x80;", "€", "€"),
    ("&notit;", "¬it;", "¬it;"),
    ("  two\r\n\tlines ", "two lines", "two lines"),
    ("", "", ""),
]


def test_clean_edges(spark):
    rows = spark.createDataFrame(EDGES, "t string, s string, p string")
    got = rows.select(
        "t", "s", "p", clean_text(F.col("t")).alias("gs"), clean_text(F.col("t"), "pipeline").alias("gp")
    ).collect()
    assert [(r.t, r.gs, r.gp) for r in got] == EDGES


def test_null_text(spark):
    row = spark.sql("SELECT CAST(NULL AS string) AS t").select(
        clean_text(F.col("t")).alias("s"), clean_text(F.col("t"), "pipeline").alias("p")
    ).first()
    assert (row.s, row.p) == (None, "")


def test_escaped_twice_is_text_once_cleaned_and_a_tag_twice_cleaned():
    once = Cleaner("service")
    assert once("&amp;lt;b&amp;gt;x") == "&lt;b&gt;x"
    assert once(once("&amp;lt;b&amp;gt;x")) == "x"


@given(st.text(alphabet=st.sampled_from("ab <>&;/:.#\n\t  htpsw"), max_size=60))
def test_cleaning_settles_once_no_entity_is_left(text):
    for profile in ("service", "pipeline"):
        clean = Cleaner(profile)
        once = clean(text)
        assert re.search(r"\s\s|^\s|\s$|[\n\t]", once) is None
        if html.unescape(once) == once and profile == "service":
            assert clean(once) == once


def test_unknown_profile():
    with pytest.raises(ValueError):
        Cleaner("other")


def test_joined_text_of_empty_parts(spark):
    rows = spark.createDataFrame([("", "d"), ("s", ""), (None, "d")], "s string, d string")
    texts = [r[0] for r in rows.select(clean_text(joined_text(F.col("s"), F.col("d")), "pipeline")).collect()]
    assert texts == [". d", "s.", ". d"]


def test_numeric_ids(spark):
    cases = [("1e3", 1000, False), (" 7 ", 7, False), ("12.0", 12, False), ("x", None, False), ("12.5", None, True),
             ("9007199254740993", 9007199254740993, False), ("1d", None, False), ("nan", None, False), ("-4", -4, False)]
    rows = spark.createDataFrame([c[:1] for c in cases], "t string")
    got = rows.select("t", numeric_id(F.col("t")).alias("n"), is_fractional(F.col("t")).alias("f")).collect()
    assert [(r.t, r.n, r.f) for r in got] == cases


def test_missing_value_tokens(spark):
    rows = spark.createDataFrame([("None",), ("NA",), ("null",), ("",), ("Linux",), (None,)], "t string")
    assert [r[0] for r in rows.select(na_to_null(F.col("t"))).collect()] == [None, None, None, None, "Linux", None]


def test_embedding_is_unit_length_and_equal_for_equal_words(spark):
    rows = spark.createDataFrame([("The crash, the CRASH",), ("crash the crash the",), ("",), (None,)], "t string")
    a, b, empty, missing = (r[0] for r in rows.select(embed(F.col("t"))).collect())
    assert a == b and len(a) == 384
    assert abs(sum(x * x for x in a) - 1) < 1e-6
    assert empty == missing == [0.0] * 384


def test_own_embedder(spark):
    class Lengths:
        name, dim = "lengths", 2

        def encode(self, texts):
            import numpy as np

            assert len(texts) <= 32
            return np.array([[len(t), 1] for t in texts])

    rows = spark.createDataFrame([(i, "x" * i) for i in range(100)], "i int, t string")
    assert all(r[1] == [r[0], 1.0] for r in rows.select("i", embed(F.col("t"), Lengths())).collect())


def test_query_text_is_cleaned_before_it_is_embedded(spark):
    rows = spark.createDataFrame([("<b>crash</b> &amp;amp; burn", "crash & burn")], "t string, plain string")
    got = rows.select(embed_report(F.col("t")).alias("a"), embed(F.col("plain")).alias("b")).first()
    assert HashEmbedder().encode([]).shape == (0, 384)
    assert got.a != got.b  # "amp" is still a word after one decoding
    again = rows.select(embed_report(clean_text(F.col("t"))).alias("a"), embed(F.col("plain")).alias("b")).first()
    assert again.a == again.b


def test_display_rules(spark):
    rows = spark.createDataFrame([(0.95, None), (0.8, None), (0.6, None), (0.1, None), (float("nan"), None), (None, 0.25), (-0.2, None)], "s double, d double")
    pct = display.percent(display.similarity_of(F.col("s"), F.col("d")))
    got = rows.select(F.round(pct, 3), display.confidence_band(pct)).collect()
    assert [tuple(r) for r in got] == [
        (95.0, "Very high"), (80.0, "High"), (60.0, "Moderate"), (10.0, "Low"), (0.0, "Low"), (75.0, "High"), (0.0, "Low"),
    ]


def test_status_classes(spark):
    wanted = {"UNRESOLVED": "open", "New": "open", "reopened": "open", "RESOLVED": "resolved", "Closed": "resolved", "DUPLICATE": "neutral"}
    rows = spark.createDataFrame([(s,) for s in wanted], "s string")
    assert {r[0]: r[1] for r in rows.select("s", display.status_class(F.col("s"))).collect()} == wanted


def test_few_texts_of_a_batch_are_objects_at_once(monkeypatch):
    sizes, listed = [], pa.Array.to_pylist

    class Watched:
        def __init__(self, column):
            self.column = column

        def __len__(self):
            return len(self.column)

        def slice(self, at, most):
            return Watched(self.column.slice(at, most))

        def to_pylist(self):
            sizes.append(len(self.column))
            return listed(self.column)

    def run(make, texts):
        made = {}

        class Kept:
            asNondeterministic = lambda self: self
            __call__ = lambda self, column: column

        monkeypatch.setattr(F, "arrow_udf", lambda _: lambda f: made.setdefault("f", f) and Kept())
        make()
        monkeypatch.undo()
        return made["f"](Watched(pa.array(texts, pa.string()))).to_pylist()

    texts = [None if i % 7 == 0 else f"<b>word{i}</b> &amp; more" for i in range(1000)]
    cleaned = run(lambda: text.clean_text("t"), texts)
    assert cleaned == [None if t is None else text.Cleaner()(t) for t in texts]
    assert max(sizes) <= text.PART and sum(sizes) == 1000
    sizes.clear()
    vectors = run(lambda: embed("t", HashEmbedder(16), cleaner=text.Cleaner()), texts)
    assert np.array_equal(vectors, HashEmbedder(16).encode([text.Cleaner()(t or "") for t in texts]))
    assert max(sizes) <= 32 and sum(sizes) == 1000
    assert run(lambda: text.clean_text("t"), []) == [] == run(lambda: embed("t", HashEmbedder(16)), [])
