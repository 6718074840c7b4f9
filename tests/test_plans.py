"""Every plan with SQL against DuckDB on the smallest tables, and the others against loops."""

import math
import os

import duckdb
import pytest

from corpusjobs.registered import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    return con


def said(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    v = v.asDict() if hasattr(v, "asDict") else v
    if isinstance(v, dict):
        return str(sorted((str(k), said(x)) for k, x in v.items()))
    return str([said(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(str([said(r[c]) for c in columns]) for r in df.collect()) == sorted(str([said(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())


def test_chunk_lines_plan(spark, sf, duck):
    import hashlib

    want = set()
    for i, text in duck.execute("select doc_id, text from documents").fetchall():
        chunk, part = 0, []
        lines = text.split("\n")
        for line in [*lines, None]:
            if line is None or part and (len(part) == 8 or sum(map(len, part)) + len(line) > 600):
                want.add((i, chunk, len(part), sum(map(len, part)), hashlib.sha256("\n".join(part).encode()).hexdigest()))
                chunk, part = chunk + 1, []
            part.append(line)
    assert {tuple(r[c] for c in ("doc_id", "chunk", "n_lines", "n_chars", "lines_sha256")) for r in QUERIES["chunk_lines"](spark, sf).collect()} == want


def test_budgets(spark, sf, duck):
    rows = duck.execute("select user_id, event_id, epoch_us(ts) / 1e6 from events order by ts, event_id").fetchall()
    held, tokens, minute, bucket = {}, {}, {}, {}
    for u, e, t in rows:
        own = [x for x in held.get(u, []) if x + 60 > t]
        minute[e] = len(own) < 3
        held[u] = own + [t] * minute[e]
        left, last = tokens.get(u, (2.0, t))
        left = min(2, left + (t - last) / 600)
        bucket[e] = left >= 1
        tokens[u] = (left - bucket[e], t)
    assert {r["event_id"]: r["admitted"] for r in QUERIES["minute_budget_replay"](spark, sf).collect()} == minute
    assert {r["event_id"]: r["admitted"] for r in QUERIES["token_bucket_replay"](spark, sf).collect()} == bucket


def test_whole_tables(spark, sf, duck):
    """Every document, sentence, source and language is in the queries named _all."""
    import collections
    import hashlib
    import re

    docs = duck.execute("select doc_id, lang, text from documents").fetchall()
    told = lambda name, *c: sorted(map(str, (tuple(r[x] for x in c) for r in QUERIES[name](spark, sf).collect())))
    assert told("translate_all", "doc_id", "translation") == sorted(str((i, hashlib.sha256(f"en: {t}".encode()).hexdigest())) for i, _, t in docs)
    assert told("body_extract_all", "doc_id", "line", "text") == sorted(str((i, k, x)) for i, _, t in docs for k, x in enumerate(t.split("\n")))
    assert told("union_datasets_all", "doc_id", "lang", "second") == sorted([*(str((i, lang, i % 2 == 0)) for i, lang, _ in docs), *(str((i, None, None)) for (i,) in duck.execute("select item_id from benchmark").fetchall())])
    words = collections.Counter(w for _, _, t in docs for w in re.findall(r"[^\W\d_]+", t.lower()))
    assert told("frequency_topk_all", "word", "n") == sorted(map(str, sorted(words.items(), key=lambda x: (-x[1], x[0]))[:100]))
    cuts = {"lookup_hits": " WHERE f.source_row_id % 10 = 3 AND f.normalized_index < 3", "resolve_original": " WHERE k LIKE '%:0'"}
    for name, cut in cuts.items():
        assert cut not in SQL[name]  # the SQL takes all rows by itself
        found = duck.execute(SQL[name])
        assert told(f"{name}_all", *(names := [d[0] for d in found.description])) == sorted(map(str, found.fetchall())), names


def test_approximate_search(spark, sf, duck):
    """Recall of the ten nearest other points, also of vectors without clusters, where many cells must be looked into."""
    import numpy as np

    from corpusjobs.operators import search

    (got,) = QUERIES["ann_recall_at_10"](spark, sf).collect()
    n = duck.execute("select count(*) from embeddings where vec_id % 20 = 0").fetchone()[0]
    assert got["queries"] == n and got["neighbours"] == 10 * n and 0.9 <= got["recall"] <= 1
    (same,) = QUERIES["search_parity_at_10"](spark, sf).collect()
    assert (same["queries"], same["changed"]) == (n, 0)
    x = np.random.default_rng(4).normal(size=(6000, 24)).astype(np.float32)
    x[3000:] = x[3000] + x[3000:] * 0.3  # half of the points in one place, so that a cell has several parts
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = points.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    scores = unit[::10] @ unit.T
    scores[np.arange(600), np.arange(0, 6000, 10)] = -2
    want = np.argsort(-scores, axis=1)[:, :10]
    for cells, least, most in ((None, 0.9, 1.0), (4, 0.9, 1.0)):
        found = {}
        for r in search.ann_top_k(points, asked, 10, others=True, cells=cells).collect():
            found.setdefault(r["query_id"], set()).add(r["id"])
        assert all(len(f) == 10 and q not in f for q, f in found.items())
        assert least <= np.mean([len(found[10 * k] & set(w)) / 10 for k, w in enumerate(want.tolist())]) <= most
    few = search.ann_top_k(points, asked, 10, probes=1).where("place = 1").where("id = query_id").count()
    assert few == 600


def test_whole_texts(spark, sf, duck, tmp_path):
    """What stands behind the first characters is parsed, trimmed and checked for refusals too."""
    assert "left(text" not in SQL["normalize_translation"]  # the SQL takes whole texts by itself
    found = duck.execute(SQL["normalize_translation"])
    assert sorted(str((r["doc_id"], r["lines"])) for r in QUERIES["normalize_whole_translation"](spark, sf).collect()) == sorted(str((i, lines)) for i, lines in found.fetchall())
    long = "x" * 40
    rows = [(0, f'{long} "a\\b"\n\tc  ', "en", "s"), (6, f"{long} \\u0041 ", "en", "s"), (1, "y" * 30 + " z ", "en", "s"), (12, "（无法翻译）。" + "x" * 60000 + "!", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lines = {r["doc_id"]: r["lines"] for r in QUERIES["normalize_whole_translation"](spark, str(tmp_path)).collect()}
    assert lines == {i: [lang, source, text.strip()] for i, text, lang, source in rows}
    refusals = [(1, "。" * 40 + "无法翻译", "s"), (2, "无法翻译" + "。" * 40 + "x", "s"), (6, long, "s")]
    spark.createDataFrame(refusals, "doc_id long, text string, source string").write.mode("overwrite").parquet(f"{tmp_path}/refusals/documents.parquet")
    assert {r["doc_id"]: r["refuses"] for r in QUERIES["refusal_flags"](spark, f"{tmp_path}/refusals").collect()} == {1: True, 2: False, 6: True}
