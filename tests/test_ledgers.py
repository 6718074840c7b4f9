"""What survives failures: versioned tables, streams with a commit log, ledgers of calls."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from corpusjobs.operators import calls, translation
from corpusjobs.operators import metrics as M
from corpusjobs.sources import versions
from corpusjobs.streaming import jobs


def ids(df):
    return sorted(r["id"] for r in df.collect())


def poisoned(df, bad):
    """df, but a task fails as it comes to the id `bad`."""
    return df.withColumn("v", F.when(F.col("id") == bad, F.raise_error(F.lit("poison")).cast("string")).otherwise(F.lit("x")))


def test_failing_replacement_keeps_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_table(spark.range(10).withColumns({"v": F.lit("x"), "dataset": F.lit("a")}), path)
    with pytest.raises(ValueError, match="exists"):
        versions.replace_table(spark.range(3).withColumn("dataset", F.lit("a")), path)
    with pytest.raises(Exception, match="poison"):
        versions.replace_table(poisoned(spark.range(0, 40, 1, 4), 35).withColumn("dataset", F.lit("b")), path, force=True)
    assert ids(versions.read_table(spark, path)) == list(range(10))
    versions.replace_table(spark.range(3).withColumns({"v": F.lit("y"), "dataset": F.lit("c")}), path, force=True)
    assert ids(versions.read_table(spark, path)) == [0, 1, 2] and versions.read_table(spark, path).columns == ["id", "v", "dataset"]
    gone = versions.vacuum(spark, path)
    assert len(gone) >= 1 and len(os.listdir(f"{path}/data")) == 1 and ids(versions.read_table(spark, path)) == [0, 1, 2]


def test_killed_replacement_keeps_the_old_rows(spark, tmp_path):
    path, begun = str(tmp_path / "t"), tmp_path / "begun"
    versions.replace_table(spark.range(10), path, by=None)
    sign = str(begun)

    def slow(frames):
        for f in frames:
            open(sign, "w").close()
            time.sleep(3)
            yield f

    failed = []

    def replace():
        spark.sparkContext.setJobGroup("replacement", "to be killed")
        try:
            versions.replace_table(spark.range(0, 400, 1, 8).mapInPandas(slow, "id long"), path, force=True, by=None)
        except Exception as e:
            failed.append(e)

    from pyspark import InheritableThread

    job = InheritableThread(target=replace)
    job.start()
    while not begun.exists():
        time.sleep(0.1)
    spark.sparkContext.cancelJobGroup("replacement")
    job.join()
    assert failed and ids(versions.read_table(spark, path)) == list(range(10))


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    first = versions.write(spark.range(2), path, True)
    versions.commit(spark, path, first.folder, True, None, first.number)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, first.folder, True, None, first.number)
    assert [e.number for e in versions.entries(spark, path)] == [2] and not [n for n in os.listdir(f"{path}/log") if n.startswith(".") and not n.endswith(".crc")]
    assert versions.read_table(spark, str(tmp_path / "none"), "id long").count() == 0
    with pytest.raises(ValueError):
        versions.read_table(spark, str(tmp_path / "none"))


def test_added_rows_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        versions.write(spark.range(k, k + 2).withColumn("p", F.lit(f"p{k % 2}")), path, False, "p", f"b{k}")
    whole = sorted(map(tuple, versions.read_table(spark, path).select("id", "p").collect()))
    assert len(whole) == 8 and versions.has_batch(spark, path, "b1")
    versions.compact(spark, path, "p")
    assert len(versions.entries(spark, path)) == 1 and versions.has_batch(spark, path, "b3")
    versions.vacuum(spark, path)
    assert sorted(map(tuple, versions.read_table(spark, path).select("id", "p").collect())) == whole


ROWS = [("p", 1, ["甲", "乙"], ["a", "b"], "done"), ("p", 2, ["丙"], ["c"], "done"), ("p", 3, ["丁"], ["d"], "pending")]
POEMS = "dataset string, id long, content array<string>, translation array<string>, translation_status string"


def points(df):
    return sorted(map(tuple, df.select("point_id", "work_id", "translation_hash").collect()))


def test_stream_equals_batch(spark, tmp_path):
    rows, out = spark.createDataFrame(ROWS, POEMS), str(tmp_path / "out")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing to add
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        jobs.stream_points(stream, out, str(tmp_path / "check"), "v1").awaitTermination()
    want = points(jobs.index_points(rows, "v1"))
    assert points(versions.read_table(spark, out)) == want and len(want) == 3
    jobs.upsert(jobs.index_points(rows, "v1").limit(1), out)  # known points add nothing
    assert points(versions.read_table(spark, out)) == want


def test_failed_batch_gives_each_point_once(spark, tmp_path, monkeypatch):
    """A batch whose job ends after half of its files, and one that ends between its data and its entry; both run again."""
    rows, out = spark.createDataFrame(ROWS * 1 + [("p", 10 + k, ["甲"], [f"t{k}"], "done") for k in range(200)], POEMS).repartition(8), str(tmp_path / "out")
    rows.write.parquet(str(tmp_path / "in"))
    want = points(jobs.index_points(rows, "v1"))
    write, commit = versions.write, versions.commit
    left = ["half", "entry"]

    def failing_write(df, path, *a):
        if left and left[0] == "half":
            left.pop(0)
            some = df.where("prefix < 'p8'").drop("prefix")
            some.write.mode("append").parquet(f"{path}/data/_version=broken/prefix=p00")  # whole files that no entry names
            raise RuntimeError("lost after half of the files")
        return write(df, path, *a)

    def failing_commit(*a):
        if left and left[0] == "entry":
            left.pop(0)
            raise RuntimeError("lost before the entry")
        return commit(*a)

    monkeypatch.setattr(versions, "write", failing_write)
    monkeypatch.setattr(versions, "commit", failing_commit)
    for k in range(4):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = jobs.stream_points(stream, out, str(tmp_path / "check"), "v1")
        if k < 2:
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination()
            assert not versions.entries(spark, out)
        else:
            query.awaitTermination()
            assert points(versions.read_table(spark, out)) == want
    jobs.upsert(jobs.index_points(rows, "v2"), out, "v1:0")  # a batch with a known id adds nothing
    assert points(versions.read_table(spark, out)) == want


def test_streams_of_requests_and_samples(spark, tmp_path):
    """Closed windows and their samples equal the batch join; rows later than the watermark are dropped on both sides, others not."""
    t = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    requests = [[(t(s), "get", float(s)) for s in range(0, 300, 7)], [(t(295), "get", 1.0), (t(292), "put", 1.0), (t(360), "get", 2.0)], [(t(30), "get", 9999.0), (t(361), "get", 3.0)], [(t(700), "get", 0.0)]]
    samples = [[(t(s), "h", s) for s in range(3, 180, 10)], [(t(295), "h", 1), (t(355), "h", 5)], [(t(5), "h", 9999), (t(290), "h", 7)], [(t(700), "h", 0)]]
    late = {"requests": {(t(30), "get", 9999.0)}, "samples": {(t(5), "h", 9999)}}
    kinds = {"requests": "ts string, event_type string, value double", "samples": "at string, host string, available long"}
    frames = {}
    for name, files in (("requests", requests), ("samples", samples)):
        time_column = kinds[name].split()[0]
        frame = lambda rows, kind=kinds[name], c=time_column: spark.createDataFrame(rows, kind).withColumn(c, F.col(c).cast("timestamp"))
        for k, rows in enumerate(files):
            frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(1.1)  # files are taken in the order of their times
        frames[name] = frame([r for rows in files for r in rows if r not in late[name]])
    stream = lambda name: spark.readStream.schema(frames[name].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = str(tmp_path / "out")
    for _ in range(2):
        jobs.stream_stage_metrics(stream("requests"), stream("samples"), out, str(tmp_path / "check"), "60 seconds", "10 seconds").awaitTermination()
    windows = jobs.windowed(frames["requests"], "60 seconds").withColumn("end", F.expr("start + interval 60 seconds - interval 1 microsecond"))
    inner = M.samples_in_stage(frames["samples"], windows, "at", "start", "end")
    want = windows.join(inner.select("start", "event_type", "at", "host", "available"), ["start", "event_type"], "left").where("end < timestamp '2026-01-01 00:11:30'")
    columns = ["start", "event_type", "requests", "total", "slowest", "at", "host", "available"]
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert key(versions.read_table(spark, out)) == key(want)
    assert any("None" in x for x in key(want)) and want.count() > 20


def counting(path, answer):
    """A caller's function that writes down what it is asked, one file for each process."""

    def call(requests):
        with open(f"{path}/{os.getpid()}", "a") as f:
            f.write("".join(json.dumps([r[0], r[1], r[2]]) + "\n" for r in requests))
        return answer(requests)

    return call


def asked(path):
    return [json.loads(x) for f in os.listdir(path) for x in open(f"{path}/{f}")]


def test_each_text_is_embedded_once(spark, tmp_path):
    """A task that dies takes only its own requests with it; what follows may fail and be run again without a call."""
    seen, ledger, dead = tmp_path / "seen", str(tmp_path / "ledger"), str(tmp_path / "dead")
    seen.mkdir()
    rows = spark.createDataFrame([(k, f"text {k % 40}") for k in range(80)] + [(99, None)], "id long, text string")

    def answer(requests):
        if any(r[2] == "text 7" for r in requests) and not os.path.exists(dead):
            open(dead, "w").close()
            os._exit(1)  # the worker dies, and with it the task
        return [[float(r[2].split()[1])] for r in requests]

    def job():
        return calls.embed(rows, counting(str(seen), answer), "text", 1, ledger, batch=1, per_task=4)

    with pytest.raises(Exception):
        job()
    before = len(asked(seen))
    found = job()
    times = {}
    for _, _, text in asked(seen):
        times[text] = times.get(text, 0) + 1
    repeated = {k for k, n in times.items() if n > 1}
    assert len(times) == 40 and "text 7" in repeated and before > 4
    with pytest.raises(Exception, match="downstream"):
        found.select(F.when(F.col("id") == 50, F.raise_error(F.lit("downstream")).cast("string"))).collect()
    got = {r["id"]: (r["embedding"], r["embed_error"]) for r in found.collect()}
    assert got == {**{k: ([float(k % 40)], None) for k in range(80)}, 99: (None, None)}
    assert len(asked(seen)) == sum(times.values())  # reading, failing and reading again asked for nothing
    assert sum(n - 1 for n in times.values()) <= 4 * 4  # no more than the requests of tasks that were under way


@pytest.mark.parametrize("error, attempt, want", [(calls.CallError("x", 429), 0, 30), (calls.CallError("x", 429), 2, 120), (calls.CallError("x", 429, 7.0), 1, 7), (calls.CallError("x", 429, -1.0), 0, 30), (calls.CallError("x", 503), 1, 2), (calls.CallError("x", 408), 0, 1), (calls.CallError("x", transient=True), 2, 4), (calls.CallError("x", 503), 3, None), (calls.CallError("x", 400), 0, None), (calls.CallError("x"), 0, None), (ValueError("x"), 0, None)])
def test_backoff(error, attempt, want):
    assert calls.backoff(error, attempt) == want


def test_retries_wait_until_they_are_due(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "text string")

    def answer(requests):
        (key, attempt, text, _) = requests[0]
        if text == "bb" and attempt < 2:
            raise calls.CallError("slow down", 429, 100.0)
        if text == "ccc":
            return [[1.0, 2.0]]
        return [[float(len(text))]]

    waited = str(tmp_path / "waited")

    def wait(seconds):
        with open(waited, "a") as f:
            f.write(f"{seconds}\n")

    got = {r["text"]: (r["embedding"], r["embed_error"]) for r in calls.embed(rows, answer, "text", 1, str(tmp_path / "ledger"), batch=1, wait=wait).collect()}
    assert got["a"] == ([1.0], None) and got["bb"] == ([2.0], None) and got["ccc"][0] is None and "dimensions" in got["ccc"][1]
    pauses = [float(x) for x in open(waited)]
    assert len(pauses) == 2 and all(80 < p <= 100 for p in pauses)


def test_translation_outcomes(spark, tmp_path):
    """One row for each way a row can end; retries say what was wrong; no answer is asked for twice."""
    seen, ledger = tmp_path / "seen", str(tmp_path / "ledger")
    seen.mkdir()
    rows = [
        (1, ["古文"]), (2, None), (3, [" ", "　"]), (4, ["。", "——"]), (5, ["照抄"]), (6, ["永远照抄"]), (7, ["敏感"] * 2), (8, [f"缺行{k}" for k in range(3)]),
        (9, ["缺行甲", "拒绝"]), (10, ["缺行甲", "敏感"]), (11, ["断线"]), (12, [f"长诗{k}" for k in range(20)]), (13, [f"长诗{k}" for k in range(8)] + ["敏感"] + ["永远照抄"]), (14, ["断线永远", "乙"]),
    ]

    def answered(lines):
        return json.dumps({"translation": {str(k + 1): x for k, x in enumerate(lines)}, "interpretation": "said"})

    def answer(requests):
        ((_, attempt, request, hint),) = requests
        lines = json.loads(request)
        if any(x == "敏感" for x in lines) and (len(lines) == 1 or lines[0] == "敏感"):
            raise calls.CallError("400 contentfilter", 400)
        if any("断线" in x for x in lines) and (attempt == 0 or "断线永远" in lines):
            raise calls.CallError("connection error", transient=True)
        if lines == ["拒绝"]:
            return [answered(["无法翻译"])]
        if lines[0].startswith("缺行") and len(lines) > 1 or "敏感" in lines:
            return [answered(["只有一行"])]
        if lines == ["永远照抄"] or lines == ["照抄"] and hint is None:
            return [answered(lines)]
        return [answered([f"今译：{x}" for x in lines])]

    df = spark.createDataFrame(rows, "id long, lines array<string>")

    def job():
        return {r["id"]: r for r in translation.translate(df, counting(str(seen), answer), ledger, retries=2, wait=lambda s: None).collect()}

    got = job()
    made = asked(seen)
    assert len(made) == len({(k, a) for k, a, _ in made})  # no request twice
    said = {k: (r["outcome"], r["reason"], r["attempts"]) for k, r in got.items()}
    assert said[1] == ("done", None, 1) and got[1]["translation"] == ["今译：古文"] and got[1]["interpretation"] == "said"
    assert said[2] == said[3] == ("skipped", "empty", 0) and said[4] == ("skipped", "punctuation", 0)
    assert said[5] == ("done", None, 2) and said[6] == ("failed", "identical", 3)
    assert said[7][0] == "skipped" and "contentfilter" in said[7][1] and said[7][2] == 1
    assert said[8] == ("done", None, 6) and got[8]["translation"] == [f"今译：缺行{k}" for k in range(3)] and got[8]["interpretation"] == "said\nsaid\nsaid"
    assert said[9] == ("failed", "refusal", 3 + 1 + 3) and said[10][0] == "skipped"
    assert said[11] == ("done", None, 2)
    assert said[12] == ("done", None, 3) and got[12]["translation"] == [f"今译：长诗{k}" for k in range(20)]
    assert said[13][0] == "skipped"  # its second chunk falls back to lines, of which the first is refused for good
    assert said[14][0] == "failed" and "connection error" in said[14][1] and said[14][2] == 3  # transport isn't mended by single lines
    again = job()
    assert again == got and len(asked(seen)) == len(made)  # a job run again reads its ledger


def test_each_answer_is_judged_once(spark, tmp_path, monkeypatch):
    """A round judges only what the one before left open."""
    sizes, judged = [], translation.judged
    monkeypatch.setattr(translation, "judged", lambda pieces, facts, retries: sizes.append(pieces.count()) or judged(pieces, facts, retries))
    answer = lambda requests: ["no JSON" if r[1] == 0 and "3" in r[2] else json.dumps({"translation": {"1": f"en: {json.loads(r[2])[0]}"}, "interpretation": "said"}) for r in requests]
    rows = spark.createDataFrame([(k, [f"line {k}"]) for k in range(9)], "id long, lines array<string>")
    got = {r["id"]: (r["outcome"], r["attempts"]) for r in translation.translate(rows, answer, str(tmp_path / "ledger"), retries=2).collect()}
    assert got == {k: ("done", 2 if k == 3 else 1) for k in range(9)} and sizes[:3] == [9, 9, 1] and sum(sizes[3:]) == 0


def test_streamed_files_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    """More rows make more files, and still two batches."""
    from corpusjobs.plans import corpus, surviving

    assert [surviving.stream_files(n) for n in (0, 40_000, 40_001, 3_000_000)] == [4, 4, 6, 300]
    texts = spark.range(90_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(surviving, "scratch", lambda spark, name: str(tmp_path / name))
    batches, upsert = [], jobs.upsert
    monkeypatch.setattr(jobs, "upsert", lambda new, path, batch=None: batches.append(batch) or upsert(new, path, batch))
    (got,) = surviving.stream_index_sentences(spark, str(tmp_path)).collect()
    assert got["works"] == 90_000 - sum((k + 1) % 7 == 0 for k in range(90_000)) and batches == ["v1:0", "v1:1"] * 2
    assert len([f for f in os.listdir(tmp_path / "stream" / "rows") if f.endswith(".parquet")]) == 10


def test_answers_are_grouped_once(spark, tmp_path):
    """Facts told twice by a lost task need no shuffle of their own."""
    tasks = spark.createDataFrame([(str(k), f"text {k}") for k in range(5)], "key string, request string")
    call = lambda requests: [r[2].upper() for r in requests]
    found = calls.answers(tasks, call, str(tmp_path / "ledger"), "string")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    calls.read_facts(spark, str(tmp_path / "ledger"), "string").write.mode("append").parquet(str(tmp_path / "twice"))
    calls.read_facts(spark, str(tmp_path / "ledger"), "string").write.mode("append").parquet(str(tmp_path / "twice"))
    again = calls.answers(tasks, call, str(tmp_path / "twice"), "string").collect()
    assert {r["key"]: r["answer"] for r in again} == {str(k): f"TEXT {k}" for k in range(5)} and len(again) == 5
