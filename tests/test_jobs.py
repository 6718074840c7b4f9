import json

import pytest
from pyspark.sql import functions as F

from corpusjobs.operators import corpus as C
from corpusjobs.operators import search as V
from corpusjobs.sources import files


def test_registry_and_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"datasets": {"poems": {"id": 1, "path": "p", "tag": "content", "excludes": ["no.json"]}}}))
    r = files.read_registry(spark, str(tmp_path / "r.json")).collect()
    assert [(x["table"], x["name"], x["excludes"]) for x in r] == [("poems", "poems", ["no.json"])]
    d = tmp_path / "p"
    d.mkdir()
    (d / "a.json").write_text('[{"content":["x"]},{"content":["y","z"]}]')
    (d / "no.json").write_text("[{")
    found = files.read_json_records(files.scan_corpus_files(spark, str(d), ["no.json"]))
    assert [(x["file"], x["pos"]) for x in found.orderBy("pos").collect()] == [("a.json", 0), ("a.json", 1)]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.read_json_records(files.scan_corpus_files(spark, str(d))).collect()
    (tmp_path / "bad.json").write_text('{"datasets": {"1x": {}}}')
    with pytest.raises(ValueError):
        files.read_registry(spark, str(tmp_path / "bad.json"))


def test_manifest(spark, tmp_path):
    df = spark.range(20).select("id", F.lit("x").alias("v"))
    files.write_manifest(df, str(tmp_path / "m"), "id")
    assert files.read_manifest(spark, str(tmp_path / "m"), "id long, v string", "id").count() == 20
    files.write_manifest(df.unionAll(df.limit(1)), str(tmp_path / "n"), "id")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "n"), "id long, v string", "id")


def test_split_works_are_checked(spark):
    rows = [("c", 1, 1, 2, "done", "一"), ("c", 2, 2, 2, "done", "一"), ("c", 11, 1, 2, "done", "一"), ("c", 12, 2, 2, "done", "二"), ("c", 21, 1, 2, "done", "一"), ("c", 31, 1, 1, "pending", "一")]
    df = spark.createDataFrame(rows, "dataset string, id long, part long, part_count long, translation_status string, chapter string")
    assert {r["first_id"]: r["reason"] for r in C.validate_split(df, ["chapter"]).collect()} == {1: None, 11: "identity differs", 21: "parts missing", 31: "not done"}


def test_status_machine(spark):
    df = spark.createDataFrame([(1, "done", 0), (2, "processing", 0), (3, "failed", 1), (4, "failed", 3), (5, None, None)], "id int, translation_status string, translation_retry_count int")
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(C.pending(df, 3)) == [3, 5]
    assert ids(C.pending(df)) == [3, 4, 5]
    assert ids(C.pending(C.recycle(C.add_status_columns(df), "x"), 3)) == [2, 3, 5]
    assert ids(C.pending(df, 3, after=3)) == [5]


def test_nested_records_inherit(spark):
    json_ = '{"title":"选集","content":[{"type":"五言绝句","content":[{"chapter":"春晓","author":"孟浩然","paragraphs":["春眠不觉晓","处处闻啼鸟"]}]}]}'
    kind = "struct<title:string,content:array<struct<type:string,content:array<struct<chapter:string,author:string,paragraphs:array<string>>>>>>"
    df = spark.range(1).select(F.from_json(F.lit(json_), kind).alias("r")).select("r.*")
    r = C.expand_objects(df, ("content", "content"), {"title": "book", "type": "section"}).first()
    assert (r["book"], r["section"], r["chapter"], r["author"], list(r["paragraphs"])) == ("选集", "五言绝句", "春晓", "孟浩然", ["春眠不觉晓", "处处闻啼鸟"])


def test_split_cuts_aligned_fields(spark):
    df = spark.createDataFrame([(["天地玄黄", "宇宙洪荒", "日月盈昃"], ["tiandi", "yuzhou", "riyue"])], "p array<string>, s array<string>")
    got = C.split_long(df, "p", 2, 1000, ("s",)).orderBy("content_part").collect()
    assert [(len(r["p"]), len(r["s"]), r["content_part"], r["content_part_count"]) for r in got] == [(2, 2, 1, 2), (1, 1, 2, 2)]


def test_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1e30, -1e30]), (5, None), (6, [1.0]), (7, [-0.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {r["id"]: (r["why"], r["u"]) for r in df.select("id", V.vector_reason(F.col("v"), 2).alias("why"), V.normalize_vector(F.col("v"), 2).alias("u")).collect()}
    assert [got[k][0] for k in range(1, 8)] == [None, "zero", "not finite", None, "dimension", "dimension", None]
    assert got[1][1] == pytest.approx([0.6, 0.8]) and got[4][1] == pytest.approx([0.5**0.5, -(0.5**0.5)]) and str(got[7][1][0]) == "0.0"


def test_schema_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], ["b"], "done")], "id int, content array<string>, translation array<string>, translation_status string")
    files.validate_schema(df, "content")
    for bad in (df.drop("id"), df.withColumn("content_part", F.lit(1))):
        with pytest.raises(ValueError):
            files.validate_schema(bad, "content")
    files.write_works_export(df, df.select("id"), str(tmp_path / "x"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        files.write_works_export(df, df.select("id"), str(tmp_path / "x"))


def test_read_points(spark, tmp_path):
    ids = [f"00000000-0000-5000-8000-00000000000{k:x}" for k in range(10)]
    rows = [(ids[0], [1.0], "p", 3, "p:3"), (ids[1], [0.0], "p", 3, "p:3"), (ids[2].upper() + "F", [1.0], "p", 3, "p:3"), (None, [1.0], "p", 3, "p:3"), (ids[3], [1.0], " ", 3, "p:3"), (ids[4], [1.0], "p", None, "p:3"), (ids[5], [1.0], "p", 3, "p:4"), (ids[6], [1.0], "p", 3, None), (ids[7], [1.0], "p", 3, "p:1"), (ids[7], [2.0], "p", 3, "p:1"), (ids[8], None, "p", 3, "p:3")]
    df = spark.createDataFrame(rows, "point_id string, vector array<float>, dataset string, row long, work_id string").coalesce(1)
    df.write.parquet(str(tmp_path / "p"))
    back = files.read_points(spark, str(tmp_path / "p"), 1)
    got = sorted((r["point_id"] or "", r["work_id"] or "", r["reason"] or "") for r in back.collect())
    why = [None, "zero", "id", "id", "payload", "payload", "work id", "work id", "twice", "twice", "dimension"]
    assert got == sorted((r[0] or "", r[4] or "", w or "") for r, w in zip(rows, why))


def test_metric_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"host":"a","available":5}\n{"host":"b","avail\n\n{"host":null}\n')
    got = files.read_metric_jsonl(spark, str(tmp_path / "m.jsonl"), "host string, available long").collect()
    assert sorted((r["host"] or "", r["available"] or 0, r["broken"] or "") for r in got) == [("", 0, ""), ("", 0, '{"host":"b","avail'), ("a", 5, "")]


def test_field_catalog(spark, tmp_path):
    fields = spark.createDataFrame([("title", "TEXT"), ("original_id", "INTEGER"), ("translation", "TEXT")], "field string, type string")
    files.write_field_catalog(fields, str(tmp_path / "c"), ["translation"])
    assert {(r["field"], r["type"], r["added"], r["original_id"]) for r in spark.read.json(str(tmp_path / "c")).collect()} == {("title", "TEXT", False, False), ("original_id", "INTEGER", False, True), ("translation", "TEXT", True, False)}


def test_top_k_in_blocks(spark, sf, monkeypatch):
    """More queries than a block holds, and none at all."""
    points = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = points.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda df: sorted((r["query_id"], r["place"], r["id"]) for r in df.collect())
    whole = key(V.top_k(points, asked, 3))
    monkeypatch.setattr(V, "QUERY_BLOCK", 5)
    monkeypatch.setattr(V, "POINT_BLOCK", 60)
    assert key(V.top_k(points, asked, 3)) == whole and len(whole) == 3 * asked.count()
    assert key(V.top_k(points, asked.where("false"), 3)) == []


def test_top_k_in_scopes(spark, monkeypatch):
    """Points of other generations or datasets, or of none, are never hits; ties go by id; one scope has most points."""
    import numpy as np

    monkeypatch.setattr(V, "POINT_BLOCK", 50)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    x = np.random.default_rng(2).integers(-2, 3, size=(400, 3)).astype(np.float64)
    rows = [(k, v.tolist(), "v1" if k % 3 else "v2", "big" if k % 10 else None if k % 20 else "small") for k, v in enumerate(x)]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>, generation string, dataset string")
    asked = points.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in V.top_k(points, asked, 4, scope=("generation", "dataset")).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    unit = {k: v / np.linalg.norm(v) for k, v, _, _ in ((k, np.array(v), g, d) for k, v, g, d in rows) if np.linalg.norm(v)}
    want = {}
    for q, _, g, d in rows:
        if q % 4 == 0 and q in unit and d:
            near = [(-round(float(unit[q] @ unit[p]), 12), p) for p, _, h, e in rows if (h, e) == (g, d) and p in unit]
            want[q] = [p for _, p in sorted(near)[:4]]
    assert got.keys() == want.keys()
    assert all(sorted(round(float(unit[q] @ unit[p]), 9) for p in got[q]) == sorted(round(float(unit[q] @ unit[p]), 9) for p in want[q]) for q in want)


def test_scores_by_tiles(spark):
    """Memory of two large blocks is that of a tile; copies of a vector rank by id, wherever they stand in a tile."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    x = np.random.default_rng(5).normal(size=(500, 16)).astype(np.float32)
    held = pa.table({"own": np.arange(20_000)[::-1].copy(), "vec": pa.FixedSizeListArray.from_arrays(pa.array(np.tile(x, (40, 1)).ravel()), 16).cast(pa.list_(pa.float32()))})
    tracemalloc.start()
    found = V.best_of_blocks(40, 6)(held.slice(0, 2_000), held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 2**20
    ids, asked = found.column("id").to_numpy().reshape(2_000, 40), held.column("own").to_numpy()[:2_000]
    assert (ids == asked[:, None] % 500 + np.arange(0, 20_000, 500)[None, :]).all()


def test_long_vectors_are_normalised_in_one_pass(spark):
    """The largest component is found once for a vector, and not once for each of its components."""
    import time

    wide = spark.range(100, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(4_000)), lambda k: (k + F.col("id")).cast("double")).alias("v"))
    start = time.time()
    (got,) = wide.select(V.normalize_vector(F.col("v")).alias("u")).agg(F.sum(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)).alias("s")).collect()
    assert abs(got["s"] - 100) < 1e-3 and time.time() - start < 15


def test_split_works_without_distinct_counts(spark):
    """No row is made for each distinct count; reasons as before, also of nulls among identities and of parts that come twice."""
    rows = [(1, 1, 2, "x", None), (2, 2, 2, "x", None), (11, 1, 2, "x", None), (12, 2, 2, "x", "a"), (21, 1, 3, "x", "a"), (21, 1, 3, "x", "a"), (23, 3, 3, "x", "a"), (31, 1, 2, "x", "a"), (32, 2, 2, "y", "a"), (41, 1, 1, "x", "a"), (51, 1, 2, "x", "a"), (52, 2, 3, "x", "a")]
    df = spark.createDataFrame(rows, "id long, part long, part_count long, who string, title string").withColumns({"dataset": F.lit("d"), "translation_status": F.lit("done")})
    found = C.validate_split(df, ["who", "title"])
    want = {1: None, 11: "identity differs", 21: "parts missing", 31: "identity differs", 41: None, 51: "counts differ"}
    assert {r["first_id"]: r["reason"] for r in found.collect()} == want
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
