"""Quality rules, mixing, vectors, chats, the n-gram join and the pipeline against brute force."""

import collections
import itertools
import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusjobs.llm import embedding_dedup, mixing, ngram_jaccard, quality, tool_calls
from corpusjobs.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [(1, None, "en", "a"), (2, "", "en", None), (3, "x " * 20000, None, "a"), (3, "x " * 20000, None, "a"), (None, "some words here", "en", "b"), (None, None, None, None), (4, "a b\na b\n\nc", "de", "b"), (5, "# " * 30, "en", "a"), (6, "one two three four five six seven eight nine ten", "en", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and names that clash with the operators' own."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({"measures": F.lit(1), "row": F.lit("x"), "h": F.lit(2), "kept": F.lit("?"), "n_chars": F.lit(0)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (6, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def measures(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def plain_badness(text):
    n, chars, symbols, dups, repeats = measures(text)
    if not n:
        return 0.0
    text = text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    mean, found = chars / n, [symbols / max(chars, 1) / 0.1, repeats / n / 0.3]
    if n >= 10:
        capitals = sum(unicodedata.category(c) == "Lu" for c in text)
        found += [capitals / chars / 0.5, text.count("!") / n / 0.5, mean / 15, 2 / mean]
    if len(lines) >= 4:
        found.append(dups / len(lines) / 0.5)
    return max(found)


def test_kept_documents_equal_the_plain_rules(spark, sf):
    """Badness, proven cutoffs and what they keep, whole, against loops with exact binomial sums; half of the strata get a cutoff."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 5 < 3, "many").when(F.col("doc_id") % 5 == 3, "few").otherwise(None).alias("lang"))
    labels = docs.where("doc_id % 7 != 1 or lang = 'few' and doc_id % 3 = 0").select("doc_id", F.when((F.col("lang") == "few") & (F.col("doc_id") % 10 != 3), 0).otherwise(1).alias("quality"))
    graded = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows, cutoffs = docs.collect(), {}
    told = {}
    for r in rows:
        n, *_, repeats = measures(r["text"])
        told[r["doc_id"]] = (n < 20 or 100 * repeats > 30 * n, plain_badness(r["text"]), r["lang"])
    strata = {lang for _, _, lang in told.values()}
    for lang in strata:
        good = [b for i, (failed, b, s) in told.items() if s == lang and graded.get(i) == 1 and not failed]
        for c in quality.CUTOFFS:
            rejected = sum(b >= c for b in good)
            tail = sum(math.comb(len(good), k) * 0.03**k * 0.97 ** (len(good) - k) for k in range(rejected + 1))
            if tail > 0.05 / len(strata):
                break
            cutoffs[lang] = c
    got = quality.judged(docs, labels).collect()
    assert len(got) == len(rows) and 0 < len(cutoffs) < len(strata)
    for r in got:
        failed, bad, lang = told[r["doc_id"]]
        assert r["base_failed"] == failed and r["badness"] == pytest.approx(bad) and r["cutoff"] == cutoffs.get(lang)
        assert r["kept"] == (not failed and bad < cutoffs.get(lang, math.inf))
    assert 0 < sum(r["kept"] for r in got) < len(got)


def test_quality_measures(spark, sf, odd, labels):
    for docs, graded in ((spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")), (odd, labels)):
        got = collections.Counter(tuple(r) for r in quality.judged(docs, graded).select("doc_id", *quality.MEASURES, "base_failed").collect())
        want = collections.Counter((r["doc_id"], *(m := measures(r["text"])), m[0] < 20 or 100 * m[4] > 30 * m[0]) for r in docs.collect())
        assert got == want
    assert quality.judged(odd.limit(0), labels.limit(0)).count() == 0


def test_binomial_bound_is_exact(spark):
    cases = [(0, 100, 0.03), (3, 200, 0.03), (17, 500, 0.05), (0, 0, 0.03), (5, 5, 0.03)]
    for k, n, p in cases:
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(F.exp(quality.log_binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p))).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_their_promise(spark):
    """A stratum with enough clean holdouts gets the strictest cutoff, one with noisy ones a laxer, one with few none."""
    rows = [("clean", 0.1, True)] * 600 + [("noisy", 1.1, True)] * 60 + [("noisy", 0.1, True)] * 600 + [("few", 0.1, True)] * 20 + [(None, 0.1, True)] * 600 + [("bad", 9.0, False)] * 50
    got = {r["stratum"]: r["cutoff"] for r in quality.calibrate(spark.createDataFrame(rows, "stratum string, badness double, good boolean")).collect()}
    assert got == {"clean": 1.0, "noisy": 1.25, None: 1.0}


def test_kept_documents_keep_their_columns(spark, odd, labels):
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == 0  # the clean row has ten words, too few for the base
    assert quality.keep_good(odd.limit(0), labels).count() == 0


def water(sizes, weights):
    total, full = 1.5 * sum(sizes), set()
    while True:
        rest, weight = total - sum(2 * sizes[i] for i in full), sum(w for i, w in enumerate(weights) if i not in full)
        t = [2 * s if i in full else rest * weights[i] / weight for i, s in enumerate(sizes)]
        new = {i for i, x in enumerate(t) if x > 2 * sizes[i]} - full
        if not new:
            return t
        full |= new


def test_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = lambda x: sorted(map(tuple, x[["doc_id", "taken"]].to_numpy().tolist()))
    assert key(got) == key(again)
    size = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()}
    assert all(r.size_ == size[r.doc_id][1] and r.taken % max(r.size_, 1) == 0 and r.taken <= 2 * r.size_ for r in got.rename(columns={"size": "size_"}).itertuples())
    names = sorted({s for s, _ in size.values()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for s, n in size.values() if s == name) for name in names]
    for name, target in zip(names, water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])):
        own = got[[size[i][0] == name for i in got["doc_id"]]]
        largest = own["size"].max()
        assert own["target"].iloc[0] == pytest.approx(target) and abs(own["taken"].sum() - target) <= largest / 2 + 1


def test_mixture_of_odd_rows(spark, odd):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.where("taken > 2 * size").count() == 0
    assert mixing.mix(odd.limit(0)).count() == 0
    copies = mixing.mixed_documents(odd)
    assert copies.columns == odd.columns
    want = got.agg(F.sum("copies")).first()[0] - got.where("size = 0").agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    assert copies.where("text is not null and text != ''").count() == want


def closure(ids, links):
    own = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if (m := min(own[a], own[b])) != max(own[a], own[b]):
                own[a] = own[b] = m
                changed = True
    return own


def test_components(spark):
    pick = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in pick.integers(0, 200, (150, 2)) if a != b] + [(300 + k, 301 + k) for k in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 1), (5, 5)], "a long, b long")).collect()}
    want = closure({x for p in links for x in p}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark):
    pick = np.random.default_rng(1)
    base = pick.normal(size=(60, 16))
    rows = []
    for i in range(600):
        v = base[i % 60] + (pick.normal(size=16) * 0.09 if i >= 120 else 0)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3 if i % 50 else None))
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [None, 1.0], 1), (704, [1.0, 2.0], 1), (705, [2.0, 4.0], 1), (706, rows[3][1], rows[3][2]), (706, rows[3][1], rows[3][2]), (None, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("x"))
    got = embedding_dedup.near_duplicates(df, tile=64).toPandas()
    good = [(k, i, np.array(v), lab) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] >= 0.98 * np.linalg.norm(a[2]) * np.linalg.norm(b[2])]
    count = collections.Counter(x for p in links for x in p)
    names = closure({i for i, *_ in rows if i is not None}, [(rows[a][0], rows[b][0]) for a, b in links])
    want = collections.Counter((i, count[k], names.get(i)) for k, (i, *_) in enumerate(rows))
    null = lambda x: None if x is None or x != x else int(x)
    assert collections.Counter((null(r.vec_id), int(r.n_links), null(r.component_id)) for r in got.itertuples()) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join_equals_brute_force(spark, odd):
    pick = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in pick.integers(0, 500, 120)) for _ in range(40)]
    texts += [" ".join(w if pick.random() > 0.012 else "zz" for w in texts[k % 8].split()) for k in range(260)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"q{x}" for x in pick.integers(0, 900, 60)) for _ in range(200)] + ["a b", "a b", "A  b", "", None]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    count, names = collections.Counter(x for p in links for x in p), closure(sets, links)
    assert got == {i: (count[i], names[i]) for i in sets}
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in ngram_jaccard.similar_documents(odd).collect()) == sorted((str(r[0]), 1 if r[0] == 3 else 0) for r in ROWS)
    assert ngram_jaccard.similar_documents(odd.limit(0)).count() == 0
    kept = ngram_jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_ngram_join_of_dense_groups(spark):
    """Over 1,000 near copies, over 128 lengths of one repeated word or two, and small sets that many texts hold."""
    pick = np.random.default_rng(8)
    base = [f"d{k}" for k in range(80)]
    texts = [" ".join(f"x{pick.integers(10**9)}" if pick.random() < 0.012 else w for w in base) for _ in range(1300)]
    texts += [" ".join(base[: pick.integers(60, 81)]) + f" e{k}" for k in range(200)]
    texts += [" ".join(["ha"] * k) for k in range(1, 160)] + [" ".join(["ho", "hi"] * k) for k in range(1, 160)] + [" ".join(["a", "b", "c"] * k) for k in range(1, 160)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    column = {x: k for k, x in enumerate(sorted(set().union(*sets.values())))}
    marked = np.zeros((len(rows), len(column)), np.float32)
    for i, own in sets.items():
        marked[i, [column[x] for x in own]] = 1
    both, size = marked @ marked.T, marked.sum(axis=1)
    near = (both >= 0.8 * (size[:, None] + size[None, :] - both)) & ~np.eye(len(rows), dtype=bool)
    names = closure(sets, [(int(a), int(b)) for a, b in np.argwhere(np.triu(near))])
    assert {i: n for i, (n, _) in got.items()} == {i: int(n) for i, n in enumerate(near.sum(axis=1))}
    assert {i: c for i, (_, c) in got.items()} == names


def test_ngram_join_of_short_crowded_texts(spark):
    """Sets of a few shingles that many texts share: 4 of 5 is the threshold itself, and nothing may be missed there."""
    texts = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(8)]
        texts += [" ".join(base)] + [" ".join([*base, f"e{g}x{k}"]) for k in range(150)] + [" ".join([f"f{g}x{k}", *base]) for k in range(150)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (300 if i % 301 == 0 else 1, i // 301 * 301) for i in range(len(rows))}


def test_ngram_join_recurses(spark, monkeypatch):
    """Texts that share half their shingles are split by deeper paths; those of a crowd of similar texts go to tiles."""
    monkeypatch.setattr(ngram_jaccard, "TILE", 24)
    monkeypatch.setattr(ngram_jaccard, "BUCKET", 8)
    asked = []
    plain = ngram_jaccard.hashes
    monkeypatch.setattr(ngram_jaccard, "hashes", lambda runs, depth: asked.append(depth) or plain(runs, depth))
    pick = np.random.default_rng(12)
    passage = [f"p{k}" for k in range(80)]
    texts = [" ".join(passage + [f"q{x}" for x in pick.integers(0, 10**6, 40)]) for _ in range(150)]
    texts += [t + " end" for t in texts[:40]] + [" ".join(w if pick.random() > 0.01 else "zz" for w in texts[0].split()) for _ in range(120)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    count, names = collections.Counter(x for p in links for x in p), closure(sets, links)
    assert got == {i: (count[i], names[i]) for i in sets} and len(asked) > 1


def rows_made(spark, first, node):
    """Output rows of the plan nodes whose text begins so, over all executions from `first` on."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(store.executionsList().size()):
        of = store.executionsList().apply(k).executionId()
        nodes = store.planGraph(of).allNodes()
        for n in (nodes.apply(j) for j in range(nodes.size())):
            if of >= first and n.desc().startswith(node):
                values = store.executionMetrics(of).get(n.metrics().apply(0).accumulatorId())
                made += int(values.get().replace(",", "")) if values.isDefined() else 0
    return made


def test_ngram_paths_are_made_once(spark, monkeypatch):
    """A crowd makes a row for each class and run of paths at most, not one for each side of the join that counts them."""
    monkeypatch.setattr(ngram_jaccard, "BUCKET", 8)
    asked = []
    plain = ngram_jaccard.hashes
    monkeypatch.setattr(ngram_jaccard, "hashes", lambda runs, depth: asked.append(runs) or plain(runs, depth))
    rows = [(k, " ".join([f"d{w}" for w in range(60)] + [f"e{k}"])) for k in range(100)]
    store = spark._jsparkSession.sharedState().statusStore()
    spark.range(1).collect()
    first = 1 + max(store.executionsList().apply(k).executionId() for k in range(store.executionsList().size()))
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (99, 0) for k in range(100)}
    assert 0 < rows_made(spark, first, "Generate explode(array_distinct(runs") <= 100 * sum(asked)


def test_ngram_join_of_documents(spark, sf):
    """Recall, measured over the documents of sf0.01: no link is missed and none is added."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    shared = collections.Counter()
    holders = collections.defaultdict(list)
    for i, own in sets.items():
        for x in own:
            holders[x].append(i)
    for who in holders.values():
        shared.update(itertools.combinations(who, 2))
    links = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    count, names = collections.Counter(x for p in links for x in p), closure(sets, links)
    assert got == {i: (count[i], names[i]) for i in sets} and len(links) > 50


def test_ngram_paths_meet_their_recall():
    """Pairs of similarity 0.8, of equal size or one within the other: a run finds its power, all runs what is asked."""
    pick = np.random.default_rng(3)
    for depth in (2, 4):
        n = ngram_jaccard.splits(0.8, 0.9999999, depth)
        assert (1 - 0.8**depth) ** n <= 1e-7 < (1 - 0.8**depth) ** (n - 1)
        factors = ngram_jaccard.hashes(n, depth)
        for shared, a, b in ((400, 50, 50), (400, 0, 100)):
            met = np.zeros((1000, n), bool)
            for k in range(len(met)):
                x = pick.integers(0, 2**63, shared + a + b)
                met[k] = ngram_jaccard.paths(x[: shared + a], factors) == ngram_jaccard.paths(np.concatenate([x[:shared], x[shared + a :]]), factors)
            assert abs(met.mean() - 0.8**depth) < 0.03 and met.any(axis=1).all()


def test_least_shared_is_the_exact_tail():
    for n, k in enumerate(ngram_jaccard.least_shared(0.8, 0.999, 40)):
        below = sum(math.comb(n, j) * 0.8**j * 0.2 ** (n - j) for j in range(k))
        assert below <= 0.001 and (k == n or below + math.comb(n, k) * 0.8**k * 0.2 ** (n - k) > 0.001)


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "add", '{"y": 2, "x": {"b":1,"a":[1, 2]}}', None), (1, 1, "b", "add", '{"x": 1}', ["a"]), (1, 2, "c", "add", "[1]", ["b", "a", "gone"]), (1, 3, "d", "no", "{}", ["e"]), (1, 4, "e", "add", '{"x":{},"y":"z","q":1}', ["d"]), (None, 5, "f", "add", None, None), (1, 6, None, "add", '{"x":{},"y":1}', ["a"]), (1, 0, "a", "add", '{"x":{},"y":1}', None)],
        "conv_id long, turn long, call_id string, tool string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, 9, "a", "ok"), (2, 9, "a", "ok"), (1, 9, None, None), (1, 10, "c", None)], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("add", "x", "object", True), ("add", "y", "number", True)], "tool string, name string, type string, required boolean")
    got = {(r["kind"], r["conv_id"], r["turn"], r["problems"]): (r["level"], r["linked"], r["message"]) for r in tool_calls.link(calls, results, schemas).collect()}
    assert got == {
        ("call", 1, 0, ""): (0, True, got["call", 1, 0, ""][2]),
        ("call", 1, 1, "type of x, missing y"): (1, False, '{"arguments":{"x":1},"id":"b","name":"add"}'),
        ("call", 1, 2, "not an object"): (2, True, '{"arguments":[1],"id":"c","name":"add"}'),
        ("call", 1, 3, "unknown tool"): (None, False, '{"arguments":{},"id":"d","name":"no"}'),
        ("call", 1, 4, "type of y, unknown q"): (None, False, '{"arguments":{"q":1,"x":{},"y":"z"},"id":"e","name":"add"}'),
        ("call", None, 5, "not an object"): (0, False, '{"arguments":null,"id":"f","name":"add"}'),
        ("call", 1, 6, ""): (0, False, '{"arguments":{"x":{},"y":1},"id":null,"name":"add"}'),
        ("result", 1, 9, ""): (0, True, '{"call_id":"a","content":"ok"}'),
        ("result", 2, 9, "no call"): (0, False, '{"call_id":"a","content":"ok"}'),
        ("result", 1, 9, "no call"): (0, False, '{"call_id":null,"content":null}'),
        ("result", 1, 10, ""): (2, True, '{"call_id":"c","content":null}'),
    }
    assert tool_calls.link(calls, results, schemas).count() == 12
    assert '{"arguments":{"x":{"a":[1,2],"b":1},"y":2},"id":"a","name":"add"}' in {r["message"] for r in tool_calls.link(calls, results, schemas).collect()}
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_conversations_equal_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rows = con.execute(tool_calls.SQL)
    names = [d[0] for d in rows.description]
    got = tool_calls.whole_conversations(spark.read.parquet(f"{sf}/conversations.parquet")).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows.fetchall()))


def test_every_turn_has_a_row(spark, sf):
    from corpusjobs.llm.queries import QUERIES

    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, None, None), (None, None, "tool", 'a "b"'), (2, 0, "", ""), (2, 0, "", "")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = collections.Counter((r["conv_id"], r["turn"], r["call_id"], r["level"], r["linked"], r["valid"], r["problems"], r["message"]) for r in tool_calls.whole_conversations(chats).where("kind = 'turn'").collect())
    other = (None, 0, False, False, "no call or result")
    assert got == collections.Counter({(1, 0, *other, '{"content":"be brief","role":"system"}'): 1, (1, 3, *other, '{"content":null,"role":null}'): 1, (None, None, *other, '{"content":"a \\"b\\"","role":"tool"}'): 1, (2, 0, *other, '{"content":"","role":""}'): 2})
    assert tool_calls.whole_conversations(chats).count() == len(rows)
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = lambda df: collections.Counter(map(tuple, df.select("conv_id", "turn").collect()))
    assert turns(QUERIES["op5_tool_calls"](spark, sf)) == turns(table) and table.where("role = 'system'").count() > 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, sf).cache()
        assert at.columns == docs.columns, name
        assert at.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "quality rules":
            base = {r["doc_id"]: measures(r["text"]) for r in before.collect()}
            assert not {r["doc_id"] for r in at.collect()} & {i for i, m in base.items() if m[0] < 20 or 100 * m[4] > 30 * m[0]}
        if name == "n-gram Jaccard join":
            sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
            links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            assert {r["doc_id"] for r in at.collect()} == {i for i, c in closure(sets, links).items() if i == c}
    assert corpus_pipeline.STAGES[-1][1](spark, at, sf).count() == at.count() > 0


def test_pipeline_run(spark, sf, tmp_path):
    """run() over odd rows among documents: the stages' rows, by the rules, and ids and texts as the library has them."""
    import hashlib

    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, "some words " * 30, None, None, None), (9001, None, None, "src1", 0), (9002, "", "en", None, 0), (9003, "12 34 " * 40, "en", "src1", 0), (9004, "x " * 30_000, "en", "src1", 0), (9004, "x " * 30_000, "en", "src1", 0)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("row", F.lit(1)).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert got and {r["doc_id"] for r in got} <= set(texts)  # none of the odd rows passes the base rules
    for r in got[:50]:
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def plain_levels(after):
    """Levels of one conversation's calls, from the ids each waits for; None in circles and behind them."""
    done = {}
    while ready := [c for c, up in after.items() if c not in done and all(done.get(p) is not None for p in up if p in after)]:
        done |= {c: max((done[p] + 1 for p in after[c] if p in after), default=0) for c in ready}
    return {c: done.get(c) for c in after}


@pytest.mark.parametrize("block", [1000, 3])
def test_levels_of_random_chats(spark, monkeypatch, block):
    """Chains, several parents, calls that wait for later turns, circles and unknown ids, against a plain loop."""
    monkeypatch.setattr(tool_calls, "BLOCK", block)
    pick = np.random.default_rng(9)
    rows = []
    for conv in range(60):
        n = int(pick.integers(1, 14))
        for k in range(n):
            most = 1 if conv % 3 == 0 else 3
            up = [f"c{x}" for x in pick.integers(max(0, k - 4), k + (conv % 5 == 4) * 2 + (k == 0), int(pick.integers(0, most + 1)))] if k or conv % 5 == 4 else None
            rows.append((conv, k, f"c{k}", [*(up or []), None, "gone"] if k % 7 == 1 else up))
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.levels(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after array<string>")).collect()}
    want = {}
    for conv in range(60):
        for c, level in plain_levels({c: [p for p in up or [] if p] for i, _, c, up in rows if i == conv}).items():
            want[conv, c] = level
    assert got == want and None in want.values()


def test_levels_of_a_deep_chat_need_few_jobs(spark):
    calls = spark.createDataFrame([(1, k, f"c{k}", [f"c{k - 1}", f"c{k // 2}"] if k else None) for k in range(300)], "conv_id long, turn long, call_id string, after array<string>")
    spark.sparkContext.setJobGroup("deep", "")
    assert {r["call_id"]: r["level"] for r in tool_calls.levels(calls).collect()} == {f"c{k}": k for k in range(300)}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs < 60


@pytest.mark.parametrize("n, ahead, most", [(40, True, 60), (2000, False, 90), (2000, True, 90)])
def test_levels_need_no_round_for_each(spark, n, ahead, most):
    """Calls that each wait for the next two turns, or the two before, also in a chat of several blocks."""
    at = lambda k: n - 1 - k if ahead else k
    calls = spark.createDataFrame([(1, at(k), f"c{k}", [f"c{x}" for x in (k - 1, k - 2) if x >= 0]) for k in range(n)], "conv_id long, turn long, call_id string, after array<string>")
    spark.sparkContext.setJobGroup(f"ahead {n} {ahead}", "")
    assert {r["call_id"]: r["level"] for r in tool_calls.levels(calls).collect()} == {f"c{k}": k for k in range(n)}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ahead {n} {ahead}"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs < most


def test_calls_with_long_arguments_and_clashing_columns(spark):
    long = '{"x":{"a":"' + "y" * 300_000 + '"},"y":1.5}'
    calls = spark.createDataFrame([(1, 0, "a", "add", long, None, 9, "?", True)], "conv_id long, turn long, call_id string, tool string, arguments string, after array<string>, level int, wrong string, linked boolean")
    results = spark.createDataFrame([(1, 1, "a", "ok", 3, False)], "conv_id long, turn long, call_id string, content string, level int, called boolean")
    schemas = spark.createDataFrame([("add", "x", "object", True), ("add", "y", "number", True)], "tool string, name string, type string, required boolean")
    got = {r["kind"]: r for r in tool_calls.link(calls, results, schemas).collect()}
    assert got["call"]["valid"] and got["call"]["linked"] and got["call"]["level"] == 0 and len(got["call"]["message"]) > 300_000 and got["result"]["linked"]


def test_long_chains_and_circles(spark):
    calls = spark.range(500).select(F.lit(1).alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.array((F.col("id") - 1).cast("string")).alias("after"))
    circle = spark.createDataFrame([(2, "a", ["b"]), (2, "b", ["a"]), (2, "c", ["a"])], "conv_id int, call_id string, after array<string>")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.levels(calls.unionAll(circle)).collect()}
    assert got == {(1, str(k)): k for k in range(500)} | {(2, x): None for x in "abc"}
