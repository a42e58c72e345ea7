import edges
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_their_columns_and_clean_rows(spark, tmp_path):
    good = [(i, edges.prose(i, 80) + ".", "en", f"s{i % 3}", 0) for i in range(60)]
    junk = [(100 + i, "### $$$ @@ " * 30, "en", "s0", 0) for i in range(20)]
    copies = [(200, good[0][1], "en", "s1", 0), (201, good[1][1] + " end", "en", "s1", 0)]
    private = [(300, edges.prose(300, 40) + " me@x.org " + edges.prose(301, 40) + ".", "en", "s2", 0)]
    rows = good + junk + copies + private + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, edges.SCHEMA).withColumn("row", F.lit("mine"))
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(15)]
    folder = edges.write(spark, tmp_path, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int"))
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{len(seen)}")
        if len(seen) < 4:
            assert out.columns == docs.columns
        now = spark.read.parquet(f"{folder}/{len(seen)}")
        seen[name] = sorted(r["doc_id"] for r in now.select("doc_id").collect())
    steps = list(seen.values())
    clean = {i for i, *_ in good}
    assert clean <= set(steps[0]) and not any(100 <= i < 200 for i in steps[0])
    assert set(steps[1]) == set(steps[0]) - {200, 201}
    assert steps[2] == steps[1]
    masked = spark.read.parquet(f"{folder}/2").where("doc_id = 300").first()["text"]
    assert " <EMAIL> " in masked and "me@x.org" not in masked
    assert set(steps[3]) <= set(steps[2]) and len(steps[3]) > len(set(steps[3]))
    assert steps[4] == steps[3]


def test_empty(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    folder = edges.write(spark, tmp_path, documents=edges.empty(spark), labels=labels)
    assert corpus_pipeline.run(spark, folder).count() == 0
