import math

import pytest
from pyspark.sql import functions as F

from echofind.functions import vectors
from echofind.operators import evaluate


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "a array<float>, b array<float>")


def test_distance_forms_agree(spark):
    rows = frame(spark, [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [-1.0, -2.0]), ([0.1, 0.2], [0.2, 0.4]), ([0.0, 0.0], [1.0, 1.0])])
    native = [r[0] for r in rows.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert native[:3] == [1.0, 2.0, 0.0] and math.isnan(native[3])
    for row, wanted in zip(rows.collect(), native):
        got = frame(spark, [row]).select(vectors.distance_to(row.b)(F.col("a"))).first()[0]
        assert got == wanted or (math.isnan(got) and math.isnan(wanted))


def test_constant_vectors_have_distance_zero(spark):
    rows = spark.range(1).select(
        vectors.constant_vector(F.lit(0.01).cast("float"), 384).alias("a"),
        vectors.constant_vector(F.lit(0.02).cast("float"), 384).alias("b"),
    )
    assert rows.select(vectors.cosine_distance(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_normalize(spark):
    rows = frame(spark, [([3.0, 4.0], [0.0, 0.0])])
    got = rows.select(vectors.l2_normalize(F.col("a")).alias("a"), vectors.l2_normalize(F.col("b")).alias("b")).first()
    assert got.a == [0.6, 0.8] and got.b == [0.0, 0.0]


def test_vector_text(spark):
    rows = frame(spark, [([0.1, -2.0, 0.0], [1.0])])
    text = vectors.vector_to_text(F.col("a"))
    got = rows.select(text.alias("t"), vectors.text_to_vector(text).alias("v")).first()
    assert got.t == "[0.10000000,-2.00000000,0.00000000]"
    assert got.v == [0.1, -2.0, 0.0]


def test_ragged_vectors_are_an_error(spark):
    rows = frame(spark, [([1.0, 2.0], [1.0]), ([1.0], [1.0])])
    with pytest.raises(Exception, match="length"):
        rows.coalesce(1).select(vectors.distance_to([1.0, 1.0])(F.col("a"))).collect()


def test_audit(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "embedding array<float>")
    assert tuple(evaluate.vector_audit(rows, 2).first()) == (3, 1)
