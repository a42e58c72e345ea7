"""Rows that every operator must take: NULLs, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

CLASH = (
    "row number kind start end size target taken score key node group block ids n_tokens spans words copies chunk "
    "mark slice words before query doc rank parts notices decoded least label n_removed predicted class_id"
).split()

#: Strings that collide under running sums modulo a power of two, whatever the letters' values.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
MORSE = THUE.translate(str.maketrans("ab", "ba"))

_SYLLABLES = "ta ri no pe lu ka mi so de fu ga zo".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars"""
    long = prose(1, 20_000)
    near = prose(2, 120)
    out = [
        (1, prose(3, 60), "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, "  \n\t ", "de", None),
        (5, long, "en", "a"),
        (6, near, "en", "b"),
        (7, near + " fuga", "en", "b"),
        (7, near + " fuga", "en", "b"),  # a row given twice
        (8, prose(3, 60), None, None),  # a copy of 1
        (None, prose(3, 60), "en", "c"),  # and one without an id
        (9, "zweiß é漢字 😀 naïve", "de", "a"),
        (9, "another text under the same id", "de", "c"),
        (None, None, None, None),
        (10, "word", "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, clash: bool = True):
    df = spark.createDataFrame(rows(), SCHEMA)
    if clash:
        for name in CLASH:
            if name not in df.columns:
                df = df.withColumn(name, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def write(spark, folder, **tables) -> str:
    """Tables as the Parquet files that queries read."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
