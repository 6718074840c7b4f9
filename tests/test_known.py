"""Bloom filters and digest trees against plain joins, and what they spare."""

from pyspark.sql import functions as F

from corpusjobs.operators import known


def test_batches_against_a_large_table(spark):
    table = spark.range(200_000).select((F.col("id") * 2).cast("string").alias("key"), F.lit("old").alias("v"))
    new = spark.range(2_000).select((F.col("id") * 151).cast("string").alias("key"), F.lit("new").alias("v")).unionAll(spark.createDataFrame([(None, "new"), ("0", "again"), ("text", "new")], "key string, v string"))
    keys = {r["key"] for r in new.collect()}
    stored = {str(2 * k) for k in range(200_000)}
    got = sorted(str(r["key"]) for r in known.lacking(new, table, "key").collect())
    assert got == sorted([str(k) for k in keys if k not in stored])
    maybe = known.told_apart(table, new, "key")
    hits = {r["key"] for r in maybe.where("maybe").collect()}
    assert keys & stored <= hits and len(hits - keys) < 0.02 * 200_000  # what is shuffled follows the batch
    merged = known.upserted(table, new, "key")
    assert merged.count() == len(stored | keys) and merged.where("v = 'old'").count() == len(stored - keys)
    empty = table.limit(0)
    assert known.lacking(new, empty, "key").count() == new.count() and known.lacking(empty, table, "key").count() == 0
    assert known.upserted(empty, new, "key").count() == len(keys)


def test_a_large_filter_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(known, "MOST_KEYS", 10)
    table = spark.range(100)
    assert sorted(r["id"] for r in known.lacking(spark.range(90, 110), table, "id").collect()) == list(range(100, 110))


def test_one_changed_row_reads_one_leaf(spark, tmp_path):
    a = spark.range(5_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    b = a.withColumn("h", F.when(F.col("id") == 77, "changed").otherwise(F.col("h")))
    c = a.where("id not in (5, 6)").unionAll(spark.createDataFrame([(9_999, "x"), (10_000, None)], "id long, h string"))
    for name, df in (("a", a), ("b", b), ("c", c)):
        known.write_with_digests(df, str(tmp_path / name), "id", "h")
    at = {name: str(tmp_path / name) for name in "abc"}
    folders, leaves = known.differing(spark, at["a"], at["b"])
    assert len(folders) == 1 and leaves.count() == 1
    found = known.difference(spark, at["a"], at["b"], "id", "h")
    assert [(r["id"], r["b"]) for r in found.collect()] == [(77, "changed")]
    assert {r["id"]: (r["in a"], r["in b"]) for r in known.difference(spark, at["a"], at["c"], "id", "h").collect()} == {5: (True, False), 6: (True, False), 9_999: (False, True), 10_000: (False, True)}
    assert known.differing(spark, at["a"], at["a"])[0] == [] and known.difference(spark, at["a"], at["a"], "id", "h").collect() == []
    read = spark.read.parquet(f"{at['a']}/rows").where(F.col("folder").isin([f"p{f}" for f in folders]))
    assert read.count() < 60  # of 5,000 rows
