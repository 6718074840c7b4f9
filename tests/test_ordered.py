"""Global windows, windows of groups that span ranges, and batches, against plain loops."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusjobs.operators import corpus as C
from corpusjobs.operators import metrics as M
from corpusjobs.operators import ordered


@pytest.fixture
def many(spark):
    """More partitions, so that groups span ranges."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for k, v in {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        spark.conf.set(k, v)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(n=3000, seed=1):
    """One group with most rows, small ones, single rows, a null group."""
    pick = random.Random(seed)
    return [(k, "hot" if pick.random() < 0.7 else pick.choice(["a", "b", "c", None, f"single {k}"]), pick.randint(0, 5) if pick.random() < 0.9 else None) for k in range(n)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals(many, by):
    df = many.createDataFrame(rows(), "id long, g string, v long")
    w = Window.partitionBy(*by).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: (r["n"], r["s"]) for r in df.withColumns({"n": F.count("*").over(w), "s": F.coalesce(F.sum("v").over(w), F.lit(0))}).collect()}
    got = {r["id"]: (r["n"], r["s"]) for r in ordered.running(df, by, ["id"], {"n": F.lit(1), "s": F.coalesce("v", F.lit(0))}).collect()}
    assert got == want and len(got) == 3000
    assert ordered.running(df.limit(0), by, ["id"], {"n": F.lit(1)}).collect() == []


@pytest.mark.parametrize("n", [1, 31, 400])
def test_windows_over_borders(many, n):
    df = many.createDataFrame(rows(), "id long, g string, v long")
    w = Window.partitionBy("g").orderBy("id").rowsBetween(-n, 0)
    want = {r["id"]: (r["n"], r["s"]) for r in df.withColumns({"n": F.count("*").over(w), "s": F.sum("v").over(w)}).collect()}
    halo = ordered.with_halo(df, ["g"], ["id"], n)
    own = Window.partitionBy("part", "g").orderBy("id").rowsBetween(-n, 0)
    got = {r["id"]: (r["n"], r["s"]) for r in halo.withColumns({"n": F.count("*").over(own), "s": F.sum("v").over(own)}).where("not halo").collect()}
    assert got == want


def test_one_group_lies_in_many_tasks(many):
    df = many.range(40_000).select("id", F.lit("hot").alias("file"))
    assert sorted(r["id"] for r in C.assign_row_ids(df, "file", "id").collect()) == list(range(1, 40_001))  # in place of a column of that name
    sizes = [r["count"] for r in ordered.ranged(df, ["file", "id"]).groupBy("part").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * sorted(sizes)[6]


def test_row_ids_of_files(many):
    pick = random.Random(3)
    data = [(f, p) for f in ("b.json", "a.json", "c.json") for p in range({"a.json": 500, "b.json": 3000, "c.json": 1}[f])]
    want = {k: i + 1 for i, k in enumerate(sorted(data))}
    pick.shuffle(data)
    assert {(r["file"], r["pos"]): r["id"] for r in C.assign_row_ids(many.createDataFrame(data, "file string, pos long"), "file", "pos").collect()} == want


def test_rates_of_one_hot_run(many):
    df = many.range(2000).select("id", F.lit("run").alias("run"), F.timestamp_seconds(F.col("id") * 2).alias("ts"), (F.col("id") * 10).alias("done"), F.col("id").alias("failed"), (F.col("id") % 3 == 0).cast("int").alias("slow"), F.col("id").cast("double").alias("s"))
    assert {(r["done_rate"], r["failed_rate"]) for r in M.throughput_deltas(df, "run", "ts", "done", "failed").where("id > 0").collect()} == {(5.0, 0.5)}
    got = {r["id"]: (r["slow_rate"], r["mean_seconds"]) for r in M.rolling_health(df, "run", ["ts", "id"], "s", ["slow"], 4).collect()}
    assert all(got[k] == ((sum((k - j) % 3 == 0 for j in range(4)) / 4, k - 1.5) if k >= 3 else (None, None)) for k in range(2000))


def looped(sizes, most_rows, most_bytes):
    out, batch, n, total = [], 0, 0, 0
    for b in sizes:
        if n == most_rows or n and total + b > most_bytes:
            batch, n, total = batch + 1, 0, 0
        out.append(batch)
        n, total = n + 1, total + b
    return out


@pytest.mark.parametrize("sizes, most_rows, most_bytes", [([5, None, 3, 10, 1, 1, 9, 0, 0, 0], 3, 10), ([10] * 50, 4, 10), ([0] * 500, 7, 3), ("random", 16, 100), ("large", 5, 60)])
def test_batches_equal_the_loop(many, monkeypatch, sizes, most_rows, most_bytes):
    monkeypatch.setattr(ordered, "BLOCK", 64)
    pick = random.Random(5)
    if isinstance(sizes, str):
        sizes = [pick.choice([0, 1, 5, 20, most_bytes, None] if sizes == "random" else [1, 50, 60, 30]) for _ in range(2500)]
    ids = sorted(pick.sample(range(10_000), len(sizes)))
    df = many.createDataFrame(list(zip(ids, sizes)), "id long, bytes long")
    got = {r["id"]: r["batch"] for r in ordered.batches(df, "id", "bytes", most_rows, most_bytes).collect()}
    assert got == dict(zip(ids, looped([b or 0 for b in sizes], most_rows, most_bytes)))


def test_batches_refuse_large_rows(many):
    df = many.createDataFrame([(1, 5), (2, 11)], "id long, bytes long")
    with pytest.raises(Exception, match="larger than a batch"):
        ordered.batches(df, "id", "bytes", 3, 10).collect()
    assert ordered.batches(df.limit(0), "id", "bytes").collect() == []


def test_percentiles_of_a_large_group(many):
    """Exact values, heavy ties and both ends, in a group too large to be counted whole, beside small ones and an empty kind."""
    import numpy as np

    n = 90_000
    noise = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double") / 7
    value = F.when(F.col("id") % 5 == 0, 1000.0).when(F.col("id") % 11 == 0, None).otherwise(noise)
    group = F.when(F.col("id") < n - 300, "hot").when(F.col("id") < n - 10, "small").otherwise(None)
    df = many.range(n).select("id", group.alias("g"), value.alias("v"), (F.col("id") % 3 != 0).alias("ok")).withColumn("ok", F.when(F.col("g") == "small", False).otherwise(F.col("ok")))
    local = df.toPandas()
    got = {r["g"]: r for r in M.distribution(df, ["g"], "v").collect()}
    told = {r["g"]: r for r in M.stage_latency(df, ["g"], "v", "ok", F.lit(10.0)).collect()}
    for g in ("hot", "small", None):
        mine = local[local["g"].isna()] if g is None else local[local["g"] == g]
        x = np.sort(mine["v"].dropna().to_numpy())
        assert (got[g]["n"], got[g]["median"], got[g]["least"], got[g]["largest"]) == (len(x), pytest.approx(np.percentile(x, 50)), x[0], x[-1])
        assert got[g]["p95"] == x[int(np.ceil(0.95 * len(x))) - 1]
        good = np.sort(mine[mine["ok"]]["v"].dropna().to_numpy())
        want = [np.percentile(good, p) if len(good) else None for p in (50, 95, 99)]
        assert [told[g][c] for c in ("p50", "p95", "p99")] == [w if w is None else pytest.approx(w) for w in want]
        assert told[g]["all_p95"] == pytest.approx(np.percentile(x, 95))
    values = M.counted(df.where("g = 'hot'"), ["g"], "v", {"all": F.lit(True)}, {"all": [0.5, 0.95]}).count()
    assert values < 500  # of about 60,000 different ones
