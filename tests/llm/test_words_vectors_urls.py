"""Whitening, spelling variants and URL filters against plain versions."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusjobs.llm import spelling_variants, url_filter, whitening
from corpusjobs.llm.queries import QUERIES, URL_RULES

# Whitening


def plain_whitening(vectors, components=8):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = np.array([[float(c) - s / len(x) for c, s in zip(r, sums)] for r in x])
    values, eigen = np.linalg.eigh(y.T @ y / n)
    values, eigen = values[::-1][:components], eigen[:, ::-1][:, :components]
    return n, [int(((n * r - sums) ** 2).sum()) for r in x], y @ eigen / np.sqrt(values), values / (y**2).sum() * n


def assert_whitened(rows, vectors):
    n, deviation, white, share = plain_whitening(list(vectors.values()))
    at = {k: i for i, k in enumerate(vectors)}
    sign = {}
    assert len(rows) == n * white.shape[1] and {(r["vec_id"], r["component"]) for r in rows} == {(k, c + 1) for k in vectors for c in range(white.shape[1])}
    for r in rows:
        i, c = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i] and abs(r["explained"] / share[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
        sign.setdefault(c, np.sign(r["whitened"] * white[i, c]))
        assert abs(r["whitened"] - sign[c] * white[i, c]) < 1e-6


def test_whitening_equals_the_eigenvectors(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert_whitened(QUERIES["op11_whitening"](spark, sf).collect(), vectors)


def test_whitening_of_odd_rows(spark):
    pick = np.random.default_rng(3)
    rows = [(k, [float(c) for c in pick.normal(size=5) * [9, 5, 3, 2, 1]], "x") for k in range(60)]
    odd = [(100, None, "x"), (101, [1.0, None, 2.0, 3.0, 4.0], "x"), (102, [float("nan")] * 5, "x"), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0], None)]
    short = [(104, [1.0], "x"), (105, [], None)]
    df = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<double>, component string")
    filled = {k: v for k, v, _ in rows} | {104: [1.0, 0, 0, 0, 0], 105: [0.0] * 5}
    assert_whitened(whitening.whiten(df).collect(), filled)
    assert whitening.whiten(df.where("vec_id between 100 and 103")).collect() == []
    alone = whitening.whiten(df.where("vec_id = 0")).collect()
    assert len(alone) == 5 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 for r in alone)
    twice = whitening.whiten(df.where("vec_id < 60").unionAll(df.where("vec_id < 60"))).collect()
    assert len(twice) == 600 and twice[0]["n"] == 120
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 4 and all(r["deviation"] == 2**63 - 1 for r in huge)


def test_spectral_division_on_hard_matrices():
    pick = np.random.default_rng(0)
    q = np.linalg.qr(pick.normal(size=(40, 40)))[0]
    spectra = [np.linspace(-1, 1, 40), np.r_[1.0, np.zeros(39)], np.r_[np.full(12, 1.0), np.full(28, 0.5)], 10.0 ** -np.arange(40.0), np.r_[1 + 1e-13 * np.arange(10), np.linspace(0.1, 1, 30)], np.ones(40)]
    for values in spectra:
        a = q @ np.diag(values) @ q.T
        e, v = whitening.principal((a + a.T) / 2, 8)
        assert np.abs(e - np.sort(values)[::-1][:8]).max() < 1e-13 and np.abs(v.T @ v - np.eye(8)).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-13
    for a in (np.zeros((3, 3)), np.ones((1, 1)), np.diag([3.0, 2, 2])):
        e, v = whitening.principal(a, 8)
        assert len(e) == len(a) and np.abs(a @ v - v * e).max() < 1e-14


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(1).normal(size=(20, 20))
    a = a + a.T
    u = whitening.polar(a)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-13 and np.abs(u @ a - a @ u).max() < 1e-12 and np.linalg.eigvalsh(u @ a).min() > 0


# Spelling variants


def plain_words(docs, letters=6, least=5):
    found = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= letters:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least}


def plain_variants(docs, least=5):
    n = plain_words(docs, least=least)
    patterns = collections.defaultdict(set)
    for w in n:
        for k in range(len(w) + 1):
            patterns[w[:k] + "*" + w[k:]].add(w)  # a letter that another word has more
            if k < len(w):
                patterns[w[:k] + "*" + w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for some in patterns.values():
        for w in some:
            near[w] |= some - {w}
    out = {}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def as_plain(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_documents(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(docs)
    assert as_plain(QUERIES["op12_spelling_variants"](spark, folder)) == want
    assert sum(v[0] is not None for v in want.values()) > 100


def test_variants_in_cut_tries(spark):
    """Small branches and leaves with more words than a branch may hold, hot letters, marks, chains of forms."""
    pick = random.Random(4)
    words = {"".join(pick.choice("aaab") for _ in range(pick.randint(6, 9))) for _ in range(900)} | {"".join(pick.choice("etéß÷xyzq") for _ in range(6)) for _ in range(300)} | {"abcdef", "abcdeg", "abcdgg"}
    counts = {w: pick.choice([5, 6, 30, 31, 200]) for w in words} | {"abcdef": 5, "abcdeg": 25, "abcdgg": 125}
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(sorted(counts.items()))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_variants(docs)
    for branch in (7, 60):
        assert as_plain(spelling_variants.variants(df, branch=branch)) == want
    assert want["abcdef"][:2] == ("abcdeg", "abcdgg")


def test_parts_of_hot_branches(spark):
    pick = random.Random(9)
    counts = {"".join(pick.sample("abcdefg", 7)): 5 + k for k in range(400)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling_variants.near_words(words.unionAll(spark.createDataFrame([("abcdef", 9), ("abcdeff", 8)], "word string, n long")), branch=16, asking=32).collect()}
    every = {**counts, "abcdef": 9, "abcdeff": 8}
    near = {w: [v for v in every if v != w and (len(v) == len(w) and sum(a != b for a, b in zip(v, w)) == 1 or len(v) == len(w) + 1 and any(v[:k] + v[k + 1 :] == w for k in range(len(v))) or len(v) == len(w) - 1 and any(w[:k] + w[k + 1 :] == v for k in range(len(w))))] for w in every}
    assert got == {w: (len(v), f := min(v, key=lambda x: (-every[x], x)), every[f]) for w, v in near.items() if v}


def test_variants_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "short words only"), (None, "abcdefg " * 6), (4, "ABCDEFG-" * 3), (4, "ABCDEFG-" * 3), (5, "zyxwvu" * 5000), (7, ("ab" * 200 + " ") * 6 + ("ab" * 90 + "c" + "ab" * 110 + " ") * 40 + ("ab" * 90 + "bb" + "ab" * 109 + " ") * 5), (8, ("q" * 64 + " ") * 5 + ("q" * 65 + " ") * 5 + ("q" * 66 + " ") * 5), (6, "\U0001f984abcdefh" * 40 + "Éabcdef" * 7 + "éabcdef" * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "form": F.lit(None).cast("int")})
    assert as_plain(spelling_variants.variants(df)) == plain_variants(rows)
    assert spelling_variants.variants(df.limit(0)).collect() == [] and spelling_variants.variants(df.where("doc_id < 3")).collect() == []


def test_one_edit_of_all_short_words():
    words = ["".join(w) for k in range(5) for w in itertools.product("ab", repeat=k)]
    c, n = spelling_variants.codes(words, 4)
    edits = lambda w: {w[:k] + x + w[k + d :] for k in range(len(w) + 1) for d in (0, 1) for x in ("", "a", "b")} - {w}
    for i, w in enumerate(words):
        got = spelling_variants.one_edit(np.repeat(c[[i]], len(words), axis=0), np.repeat(n[[i]], len(words)), c, n)
        assert [words[k] for k in np.flatnonzero(got)] == [v for v in words if v in edits(w)] == [v for v in words if spelling_variants.one_edit_apart(w, v)]


# URL filters

URLS = [None, "", "no scheme", "http://", "http://NET", "http://Net/", "https://a.NET/x?y#z", "x://notnet/", "http://example.net/en", "http://example.net/en/1", "http://sub.example.net/en/?q", "http://xexample.net/en/", "http://example.com/de/a", "http://example.com/DE/a", "http://a.b.example.com/de/", "http://example.org/fr/", "http://org/fr/x", "http://example.net:80/en/", "http://u@example.net/", "a://b://c/d", "http://example.net?/en/", "http://example.net#/", "http://é.Énet/ü", "http://a.net/" + "x" * 30000]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(t), t, v) for v, t in URL_RULES if (h := t.split("/", 1)[0]) is not None and (host == h or host.endswith("." + h)) and path.startswith(t[len(h) :])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_of_urls(spark, sf):
    odd = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, rule string")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for df in (odd, pages):
        urls = {r["page_id"]: r["url"] for r in df.collect()}
        got = url_filter.judged(df, URL_RULES).collect()
        assert sorted(r["page_id"] for r in got) == sorted(urls)
        for r in got:
            host, path, rule, verdict = plain_url(urls[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
            assert verdict is None or r["verdict"] == verdict
    assert url_filter.judged(odd.limit(0), URL_RULES).collect() == []
    assert {r["verdict"] for r in url_filter.judged(odd.where("page_id < 4"), URL_RULES).collect()} == {"allow"}


def plain_probability(urls, order, least):
    """P(symbol | context) by the definition, from the urls of one kind; contexts and characters from all of them."""
    spreads = [(f"\x02{u}\x03", a) for u, a in urls]
    met = {k: collections.Counter() for k in (0, 1)}
    for s, a in spreads:
        for at in range(1, len(s)):
            for n in range(min(order, at) + 1):
                met[a][s[at - n : at], s[at]] += 1
    total = collections.Counter()
    for k in (0, 1):
        for (c, _), n in met[k].items():
            total[c] += n
    alphabet = {x for k in (0, 1) for c, x in met[k] if c == ""}

    def p(kind, context, symbol):
        lower = p(kind, context[1:], symbol) if context else 1 / (len(alphabet) + 1)
        if context and total[context] < least:
            return lower
        n, kinds = sum(v for (c, _), v in met[kind].items() if c == context), sum(c == context for c, _ in met[kind])
        return (met[kind][context, symbol] + kinds * lower) / (n + kinds) if n else lower

    return p


def test_scores_equal_the_definition(spark):
    pick = random.Random(2)
    urls = [("http://" + "".join(pick.choice("abcd/") for _ in range(pick.randint(0, 8))), pick.randint(0, 1)) for _ in range(60)]
    urls = sorted(set(urls))
    df = spark.createDataFrame(urls, "url string, allowed int")
    counts = [tuple(r) for r in url_filter.gram_counts(df, 3, 2).select("context", "symbol", "allowed", "blocked").collect()]
    model, p = url_filter.ratios(counts, 3), plain_probability(urls, 3, 2)
    for u in ["", "http://abcab", "zzz", "é/ab", *[u for u, _ in urls[:10]]]:
        s = f"\x02{u}\x03"
        want = sum(math.log(p(1, s[max(0, at - 3) : at], s[at]) / p(0, s[max(0, at - 3) : at], s[at])) for at in range(1, len(s))) / (len(s) - 1)
        assert abs(model.score(u) - want) < 1e-9


def test_models_tell_kinds_apart(spark):
    """Hosts that no rule names are judged by how they are spelt."""
    pick = random.Random(8)
    good, bad = ["garden", "kitchen", "museum", "library"], ["casino", "pills", "xxx", "bets"]

    def urls(kind, tld, n):
        return [f"http://{pick.choice(kind)}{pick.choice(kind)}{k}.{tld}/{pick.choice(kind)}/{k}" for k in range(n)]

    rows = urls(good, "fine", 400) + urls(bad, "awful", 400) + urls(good, "other", 100) + urls(bad, "other", 100)
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judged(df, [("allow", "fine/"), ("block", "awful/")]).collect()}
    assert sum(got[k]["verdict"] == ("allow" if k < 900 else "block") for k in range(800, 1000)) >= 195
    assert all(got[k]["score"] is None for k in range(800))


@pytest.mark.parametrize("scored, want", [([], 0.0), ([(1.0, 1)], 0.0), ([(1.0, 1), (-1.0, 0)], 0.0), ([(3.0, 1), (2.0, 1), (1.0, 0), (1.0, 0)], 1.5), ([(-3.0, 0), (-2.0, 1)], -2.5)])
def test_threshold(scored, want):
    assert url_filter.threshold(scored) == want


def test_all_decided_urls_teach(spark):
    """Counts, scores and threshold of over 20,000 urls of a kind against the same model in memory, learnt from all of them."""
    pick = random.Random(5)
    parts = {"fine": ["garden", "museum", "press"], "awful": ["casino", "pills", "press"], "other": ["garden", "pills", "press", "é\U0001f600"]}
    rows = [f"http://{pick.choice(parts[z])}{k % 997}.{z}/{pick.choice(parts[z])}/{k}" for z, n in (("fine", 26_000), ("awful", 3_000), ("other", 200)) for k in range(n)]
    rows += ["http://press.other/" + "ab" * 3000, None, "", "no scheme"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").repartition(4)
    got = {r["page_id"]: r for r in url_filter.judged(df, [("allow", "fine/"), ("block", "awful/")]).collect()}
    urls = spark.createDataFrame([(u, u.split("/")[2], int(".fine/" in u)) for u in rows[:29_000]], "url string, host string, allowed int")
    urls = urls.select("url", "allowed", (F.pmod(F.xxhash64("host", F.lit("calibration")), F.lit(5)) == 0).alias("aside"))
    counts = [tuple(r) for r in url_filter.gram_counts(urls.where("not aside"), 5, 2).select("context", "symbol", "allowed", "blocked").collect()]
    model = url_filter.ratios(counts, 5)
    cut = url_filter.threshold([(model.score(r["url"]), r["allowed"]) for r in urls.where("aside").collect()])
    assert sorted(got) == list(range(len(rows)))
    for k, u in enumerate(rows[29_000:], 29_000):
        want = model.score(u or "")
        assert abs(got[k]["score"] - want) < 1e-8 and (abs(want - cut) < 1e-7 or got[k]["verdict"] == ("block" if want < cut else "allow"))
    assert {got[k]["verdict"] for k in range(29_000, 29_200)} == {"allow", "block"}


def test_threshold_of_a_table(spark):
    """The cut from running counts is the one that passes over all scores in memory."""
    pick = random.Random(4)
    cases = [[], [(1.0, 1)], [(1.0, 1), (-1.0, 0)], [(3.0, 1), (2.0, 1), (1.0, 0), (1.0, 0)], [(-3.0, 0), (-2.0, 1)], [(2.0, 0), (1.0, 1)], [(round(pick.gauss(a - 0.5, 1), 2), a) for a in [0, 1] * 150]]
    for scored in cases:
        assert url_filter.cutoff(spark.createDataFrame(scored, "score double, allowed int")) == pytest.approx(url_filter.threshold(scored))
