"""The vector index: pages, and which files a change writes."""

import os

from pyspark.sql import functions as F

from tessera.operators import vectors


def files(path):
    return {f"{os.path.basename(d)}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows_of(spark, ids):
    return spark.createDataFrame([(i, [float(i), 0.5], i % 3) for i in ids], "vec_id long, embedding array<float>, label int")


def test_pages(spark):
    rows = rows_of(spark, [i * 7 % 1009 - 100 for i in range(1009)]).repartition(5)
    got = sorted((r["page"], r["place"], r["vec_id"]) for r in vectors.pages(rows, "vec_id", 256).collect())
    assert got == [(i // 256, i % 256, i - 100) for i in range(1009)]
    one_by_one = [r["vec_id"] for page in vectors.each_page(rows, "vec_id", 256) for r in page]
    assert one_by_one == list(range(-100, 909))
    assert vectors.pages(rows.where("vec_id > 5000"), "vec_id").count() == 0
    assert list(vectors.each_page(rows.where("vec_id > 5000"), "vec_id")) == []


def test_changes_leave_other_buckets_unwritten(spark, tmp_path):
    path = f"{tmp_path}/index"
    vectors.write_index(rows_of(spark, range(2000)), path, "vec_id", 8)
    before = files(path)
    updates = spark.createDataFrame([(i, [-1.0, -2.0]) for i in range(2000, 2050)], "vec_id long, embedding array<float>")
    assert vectors.replace_vectors(spark, path, "vec_id", "embedding", 8, updates) == []
    assert files(path) == before
    wanted = [r[0] for r in rows_of(spark, range(2000)).where(vectors.bucket_of(F.col("vec_id"), 8).isin(2, 5)).orderBy("vec_id").limit(128).collect()]
    written = vectors.replace_vectors(spark, path, "vec_id", "embedding", 8, spark.createDataFrame([(i, [-1.0, -2.0]) for i in wanted], "vec_id long, embedding array<float>"))
    assert written == [2, 5]
    after = files(path)
    same = {f for f in before if not f.startswith(("bucket=2/", "bucket=5/"))}
    assert all(after[f] == before[f] for f in same) and not set(before) - same & set(after)
    got = {r["vec_id"]: (r["embedding"], r["label"]) for r in vectors.read_index(spark, path).collect()}
    assert got == {i: ([-1.0, -2.0] if i in wanted else [float(i), 0.5], i % 3) for i in range(2000)}
    vectors.upsert(spark, path, "vec_id", 8, rows_of(spark, [5000]).unionByName(rows_of(spark, [7]).withColumn("label", F.lit(9))))
    got = {r["vec_id"]: r["label"] for r in vectors.read_index(spark, path).collect()}
    assert len(got) == 2001 and got[5000] == 5000 % 3 and got[7] == 9
