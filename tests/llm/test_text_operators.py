"""SentencePiece, token records, language ID, HTML and the hidden Markov model against the libraries and brute force."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusjobs.llm import hidden_markov_lm as H
from corpusjobs.llm import common, html_text, language_id, ngram_jaccard, sentencepiece_bpe, token_records

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a  b ", "a\tb\nc", "▁x ▁▁", "🦄 <s> <0x0A>", "\x00é ", "the " * 3000, "ß" * 500, "Ein Haus.\nzwei"]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_bpe.PieceModel(PIECES)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "a b", "en", None, None), (3, "a  b ", "en", "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, score int")


def test_pieces_equal_the_library(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pick, letters = random.Random(1), list("abcthe  \n\t▁.,!$019éüñ梦の🦄\x00́　'ing<>s") + ["  ", "▁▁", "the ", "<s>", "<0x0A>", "    "]
    for _ in range(3000):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 30)))
        ids = sp.encode(text)
        assert pieces.encode(text).tolist() == ids
        assert pieces.decode(ids) == sp.decode(ids)


def test_pieces_of_documents_equal_the_library(pieces, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in pq.read_table(f"{sf.replace('0.001', '0.01')}/documents.parquet", columns=["text"]).column(0).to_pylist():
        ids = sp.encode(text or "")
        assert pieces.encode(text).tolist() == ids
        assert pieces.decode(ids) == sp.decode(ids)


def test_remembered_pairs_are_the_models_own_strings():
    """A pair remembered with parts of a text would keep two strings of its own."""
    own, pick = sentencepiece_bpe.PieceModel(PIECES), random.Random(2)
    for _ in range(300):
        own.encode("".join(pick.choice("abcdeinorst") for _ in range(20)))
    kept = [p for pair in own.fits for p in pair if p in own.ids]
    assert len(kept) > 1000
    assert len({id(p) for p in kept}) == len(set(kept))


def test_a_worker_holds_the_memory_of_one_operator():
    """The hashes of words let a model go, and what Arrow kept for reuse goes back to the system with it."""
    import pyarrow as pa

    def mb():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    common.held(("pieces", "none"), lambda: ["a model"])
    ngram_jaccard.shingles("one two three four five six")  # whatever the other tests left has gone
    common.held(("pieces", "none"), lambda: bytearray(b"x" * 200_000_000))
    batches = [pa.array(np.full(100_000, k)).cast(pa.int32()) for k in range(200)]
    before = mb()
    del batches
    ngram_jaccard.shingles("one two three four five six")
    assert list(common._held) == ["hashes of words"]
    assert mb() < before - 250


def test_encoding_of_odd_rows(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_bpe.digests(sentencepiece_bpe.encode_texts(odd, PIECES)).collect()
    want = []
    for i, t in [*enumerate(TEXTS), (None, "a b"), (3, "a  b ")]:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sentencepiece_bpe.encode_texts(odd.limit(0), PIECES).count() == 0


def test_records_round_trip(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    special = [(100, "hello <|endoftext|> world"), (101, "<|startoftext|>a<|endoftext|><|endoftext|"), (102, "<|ENDOFTEXT|> it's a'b rock'# x_!? don't' é́! ½²")]
    more = spark.createDataFrame(special, "doc_id long, text string")
    got = sorted(token_records.round_trip(odd.select("doc_id", "text").union(more), WORDS).collect(), key=lambda r: r["start"])
    start, want = 0, {}
    for i, x in [*enumerate(TEXTS), (None, "a b"), (3, "a  b "), *special]:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: -1 if i is None else i)
    assert token_records.round_trip(odd.limit(0), WORDS).count() == 0


def test_token_ids_of_documents_equal_the_library(sf):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table(f"{sf.replace('0.001', '0.01')}/documents.parquet", columns=["text"]).column(0).to_pylist()
    library, code = Tokenizer.from_file(WORDS), token_records.encoder(WORDS)
    pick, letters = random.Random(2), list("abThe  \n\t.,!'#_<|>$019éüñß梦\x00́　½²") + ["'s", "'ll", "<|endoftext|>", "endoftext"]
    texts += ["".join(pick.choice(letters) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, code.encode(texts)):
        assert np.frombuffer(ids, code.kind).tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_python_sees_only_different_stems(monkeypatch):
    """However often words come, in upper case or with marks behind them, each stem is looked up once for many texts."""
    import pyarrow as pa

    code, seen = token_records.WordEncoder(WORDS), []
    monkeypatch.setattr(code, "stem", lambda low, stem=code.stem: seen.append(low) or stem(low))
    texts = ["The cat, THE CAT! été. Été?\n", None, " the  cat... "] * 1000
    got = code.encode(pa.array(texts))
    assert sorted(x for x in seen if x) == ["cat", "the", "été"]
    assert len(seen) <= 4
    want = {t: np.array(code.library.encode(t or "", add_special_tokens=False).ids, code.kind).tobytes() for t in texts}
    assert got == [want[t] for t in texts]


def test_token_ids_of_odd_characters_equal_the_library(monkeypatch):
    """All characters of the first blocks, and those that become Latin letters in lower case; also while memories are turned over."""
    code = token_records.WordEncoder(WORDS)
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x700 or all(x in token_records.LETTERS for x in chr(c).lower()))]
    texts = [f"Ab{c}Cd {c} {c}! x{c} {c}y É{c}. '{c}" for c in odd]
    want = [np.array(code.library.encode(t, add_special_tokens=False).ids, code.kind).tobytes() for t in texts]
    assert code.encode(texts) == want
    for name in ("STEMS", "WORDS", "LONG"):
        monkeypatch.setattr(token_records, name, 3)
    assert code.encode(texts) == want
    assert code.encode([]) == []


def test_words_between_any_white_space_are_remembered():
    """Words between no-break or wide spaces, too, go to the library once, not with all words beside them."""
    code = token_records.WordEncoder(WORDS)
    pick, letters = random.Random(3), ["été", "Haus", "x1"]
    texts = ["".join(pick.choice(letters) + pick.choice("\xa0\u3000\u2009\x85 ") for _ in range(20)) for _ in range(200)]
    want = [np.array(code.library.encode(t, add_special_tokens=False).ids, code.kind).tobytes() for t in texts]
    assert code.encode(texts) == want
    assert len(code.words) <= 2 and len(code.stems) <= 3
    apart = [f"{t}\x1c{t} \x1f" for t in texts[:20]]
    assert code.encode(apart + texts) == [np.array(code.library.encode(t, add_special_tokens=False).ids, code.kind).tobytes() for t in apart] + want


def test_batches_are_encoded_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_records, "ROWS", 3)
    monkeypatch.setattr(token_records, "BYTES", 10)
    texts = ["a" * 4, "b" * 6, "c", None, "", None, "d" * 50, "", "é" * 5, "e"]
    parts = [b.column(1).to_pylist() for b in token_records.together(pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": texts}).slice(0))]
    assert parts == [texts[:2], texts[2:5], texts[5:6], texts[6:7], texts[7:9], texts[9:]]
    assert [t for p in parts for t in p] == texts


def test_records_are_read_in_any_order(spark, odd, tmp_path):
    """A reader that jumps to shuffled places of the index finds each record there."""
    folder = f"file://{tmp_path}/records"
    manifest = token_records.write_records(odd, folder, WORDS).collect()
    library, found = token_records.encoder(WORDS), []
    for shard in manifest:
        data, index = (open(f"{tmp_path}/records/{shard['path']}{end}", "rb").read() for end in ("", ".idx"))
        places = np.frombuffer(index, "<u8").reshape(-1, 2).tolist()
        random.Random(5).shuffle(places)
        for at, _ in places:
            payload, _ = token_records.unframe(memoryview(data), at)
            found.append((int.from_bytes(payload[:8], "little", signed=True), payload[9:]))
    end = np.array([1], library.kind).tobytes()
    want = [(token_records.NO_ID if r["doc_id"] is None else r["doc_id"], library.encode([r["text"]])[0] + end) for r in odd.collect()]
    assert sorted(found) == sorted(want)


def test_damaged_records_are_refused():
    data = bytearray(token_records.frame(b"payload"))
    assert token_records.unframe(memoryview(data), 0) == (b"payload", len(data))
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(memoryview(bad), 0)


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark, odd):
    got = {r["doc_id"]: r for r in language_id.predicted(odd).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[0]["score"] == 0
    assert language_id.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0
    assert language_id.predicted(odd.limit(0)).count() == 0


def test_numbers_are_no_letters(spark):
    """Letters are Unicode's L in prediction as in learning; ties go to the first language."""
    rows = [(1, "½ ² Ⅷ", "de"), (2, "①②③ 12 _", "de"), (3, "ab½cd", "de"), (4, "ab½cd", "en"), (5, "ª", "en")]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.keys[0]) == {"ab", "cd", "ª"}
    scorer = language_id.Scorer(model)
    assert scorer.predict("½ ² Ⅷ") == scorer.predict("①②③") == ("und", 0.0)
    same = language_id.LanguageModel(["de", "en"], {0: ["a"]}, {0: np.zeros((1, 2))})
    assert language_id.Scorer(same).predict("a") == ("de", 0.5)


def plain_language(model, text):
    """The prediction by the definition: sums over words, backing off for each unseen one."""
    import regex

    total = np.zeros(len(model.languages))
    for w in regex.findall(r"\p{L}+", text.lower()):
        if w in (own := dict(zip(model.keys[0], model.values[0]))):
            total += own[w]
            continue
        for n in (4, 3, 2, 1):
            spread, known = (f" {w} " if n > 1 else w), dict(zip(model.keys.get(n, []), model.values.get(n, [])))
            if found := [known[spread[k : k + n]] for k in range(len(spread) - n + 1) if spread[k : k + n] in known]:
                total += np.mean(found, axis=0)
                break
    return model.languages[int(total.argmax())], 1 / np.exp(total - total.max()).sum()


def test_predictions_equal_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").where("text is not null").limit(12)
    model = language_id.learn(docs, entries=400)
    scorer = language_id.Scorer(model)
    for r in docs.collect():
        text = " ".join(r["text"].split()[:60])
        lang, score = scorer.predict(text)
        want = plain_language(model, text)
        assert (lang == want[0] or "und" == lang) and score == pytest.approx(want[1] if lang != "und" else 0)


PAGE = """<html><head><title>t</title><script>var a="</p>"</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a><a href=/x>News</a></nav>
<div class="cookie-notice">We use cookies, and this sentence about them is long enough to look like text.</div>
<div id="main-content"><h2>A title</h2><p>First &amp; long paragraph of the text, with a <b>bold</b>   word and more words to make it a real one.<p>Second paragraph, which is also long enough to be taken for content by its ratio.</p><p>Short.</p>
<p>Last paragraph of the article with quite a number of words in it, so that it counts.</p></div>
<aside>Related: other things</aside><div class="comments"><p>Reader: I liked this article a great deal and want to say so at length.</p></div><form><input><button>Send</button></form><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    want = "A title\nFirst & long paragraph of the text, with a bold word and more words to make it a real one.\nSecond paragraph, which is also long enough to be taken for content by its ratio.\nShort.\nLast paragraph of the article with quite a number of words in it, so that it counts."
    assert html_text.extract(PAGE) == want


LONG = "A paragraph of the article with quite a number of words in it, so that its ratio of text to tags is high. " * 3
LINKS = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(8))


def test_ratios_decide(monkeypatch):
    """Without an article element, and for doubtful lines in one, it is the clusters that choose."""
    page = f"<body><ul>{LINKS}</ul><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul>{LINKS}</ul></body>"
    want = "\n".join([LONG.strip(), "Short.", LONG.strip()])
    article = f"<article><h1>Title</h1><p>{LONG}</p><ul>{LINKS}</ul></article>"
    assert html_text.extract(page) == want
    assert html_text.extract(article) == "Title\n" + LONG.strip()
    monkeypatch.setattr(html_text, "clustered", lambda ratios, smooth=True: np.ones(len(ratios), bool))
    assert html_text.extract(page) != want and "link 3" in html_text.extract(article)


def test_names_drop_no_paragraph_of_an_article():
    page = f'<article><p>{LONG}</p><p class="search">We search for truth</p><div class="menu-of-the-day"><p>Soup</p></div><p id="share">{LONG}</p><div class="ad-slot">Buy</div><p>{LONG}</p></article><div class="cookie-notice">{LONG}</div>'
    assert html_text.extract(page).split("\n") == [LONG.strip(), "We search for truth", "Soup", LONG.strip(), LONG.strip()]


def article_of(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h\d|ul|ol|li|div|table|tr|td|th|blockquote|pre)\b[^>]*>", re.sub(r"<!--.*?-->|<(script|style|form|aside|nav)\b.*?</\1>", "", body, flags=re.S))
    plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br[^>]*>", " ", b))).split()) for b in blocks]
    return [b for b in plain if b]


def test_main_text_of_pages_is_their_article(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect()}
    for r in html_text.main_texts(spark.createDataFrame(list(pages.values()))).collect():
        assert r["text"] == "\n".join(article_of(pages[r["page_id"]]["html"])) and r["n_chars"] == len(r["text"])


def test_clusters_find_the_article_without_names(sf, monkeypatch):
    """With article and main made div, and then menus, headers and footers too, it is ratios, smoothing and clusters that tell."""
    pages = [r["html"] for r in pq.read_table(f"{sf.replace('0.001', '0.01')}/pages.parquet", columns=["html"]).to_pylist()]

    def found(names):
        """Pages with exactly their article, lines of articles that were lost, other lines."""
        same = lost = other = 0
        for page in pages:
            want, got = article_of(page), html_text.extract(re.sub(rf"<(/?)({names})\b", r"<\1div", page)).split("\n")
            same, lost, other = same + (want == got), lost + len(set(want) - set(got)), other + len(set(got) - set(want))
        return same, lost, other

    assert found("article|main") == (250, 0, 0)
    every = "article|main|nav|header|footer|aside"
    same, lost, other = found(every)
    assert same >= 244 and lost == 0 and other <= 6
    smoothed = html_text.smoothed
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, sigma=1.0: ratios)
    less, missing, _ = found(every)
    assert less < same and missing > 0
    monkeypatch.setattr(html_text, "smoothed", smoothed)
    monkeypatch.setattr(html_text, "clustered", lambda ratios, smooth=True: np.ones(len(ratios), bool))
    less, _, more = found(every)
    assert less < same and more > 100


def test_several_articles_and_headers_in_main():
    page = f"<main><header><h1>Title</h1></header><article><p>{LONG}</p></article><aside>{LONG}</aside><article><p>{LONG}</p><p>Short.</p></article></main><article><p>teaser</p></article>"
    assert html_text.extract(page).split("\n") == ["Title", LONG.strip(), LONG.strip(), "Short."]
    page = f"<div><article><p>{LONG}</p></article><ul>{LINKS}</ul><article><p>{LONG}</p><p>Short.</p></article><article><p>teaser</p></article></div>"
    assert html_text.extract(page).split("\n") == [LONG.strip(), LONG.strip(), "Short."]


def test_main_text_of_a_very_long_page(spark):
    page = "<main>" + "".join(f"<p>{LONG} {k}</p>" for k in range(3000)) + "</main>"
    assert html_text.extract(page).count("\n") == 2999
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_odd_pages(spark):
    assert [html_text.extract(p) for p in (None, "", "<p>", "plain", "<article><p>cut &am", "<nav>a<article>b</article>")] == ["", "", "", "plain", "cut &am", "b"]
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a</p>", "x"), (None, None, "<p>a</p>", None)], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.main_texts(df).collect()) == [("", 0), ("a", 1), ("a", 1)]


def test_forward_recursion_equals_the_sum_over_paths():
    pick = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = H.HiddenModel(norm(pick.random(3), 0), norm(pick.random((3, 3)), 1), norm(pick.random((4, 3)), 0))
    found = [pick.integers(0, 4, n).astype(np.int32) for n in (1, 5, 3)]
    for where, group in H.similar(found):
        for k, ll in zip(where, m.likelihood(group)):
            total = sum(m.start[p[0]] * m.emit[found[k][0], p[0]] * math.prod(m.move[a, b] * m.emit[s, b] for a, b, s in zip(p, p[1:], found[k][1:])) for p in itertools.product(range(3), repeat=len(found[k])))
            assert ll == pytest.approx(math.log10(total))


def test_baum_welch_counts_equal_the_sum_over_paths():
    pick = np.random.default_rng(8)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = H.HiddenModel(norm(pick.random(2), 0), norm(pick.random((2, 2)), 1), norm(pick.random((3, 2)), 0))
    found = [pick.integers(0, 3, n).astype(np.int32) for n in (5, 4, 1)]
    starts, moves, emissions, total = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for x in found:
        paths = list(itertools.product(range(2), repeat=len(x)))
        p = np.array([m.start[q[0]] * math.prod(m.emit[s, k] for s, k in zip(x, q)) * math.prod(m.move[a, b] for a, b in zip(q, q[1:])) for q in paths])
        total += math.log(p.sum())
        for q, weight in zip(paths, p / p.sum()):
            starts[q[0]] += weight
            np.add.at(moves, (list(q[:-1]), list(q[1:])), weight)
            np.add.at(emissions, (x, list(q)), weight)
    got = H.summed(m, found)
    assert got[0] == pytest.approx(total, rel=1e-5)
    for g, w in zip(got[1:], (starts, moves, emissions)):
        assert np.allclose(g, w, rtol=1e-4, atol=1e-6)


def test_baum_welch_rounds_never_lose():
    pick = np.random.default_rng(4)
    found = [pick.integers(0, 6, n).astype(np.int32) for n in pick.integers(1, 40, 50)]
    model, last = H.started(np.array([np.bincount(x, minlength=6) for x in found], np.float32), 3), -np.inf
    for _ in range(6):
        now, *counts = H.summed(model, found)
        assert now >= last - 0.5
        model, last = H.HiddenModel.of(*counts), now


def base_scores(rows):
    """held_out, n_tokens, n_known, train_tokens and base_score by the contract's formula."""
    import collections
    import re

    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), None]
    out = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c = collections.Counter(w for (i, t), ho in zip(rows, out) if not ho and i is not None for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, ho, len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for (i, t), ho in zip(rows, out)]


@pytest.mark.parametrize("bounds", [{}, {"frequent": 300, "own": 100, "shared": 16}])
def test_base_scores_equal_the_formula(spark, sf, bounds):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (None, "Some words"), (902, "ÄB ab AB"), (902, "ÄB ab AB"), (903, "long " * 70_000 + "unseen"), (910, "neverseen neverseen x"), (917, "neverseen"), (921, "neverseen")]
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in H.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), **bounds).collect()), key=str)
    want = sorted(base_scores(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_scores_of_held_out_documents(spark, sf):
    got = H.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), frequent=500, own=200).toPandas()
    held = got[got["held_out"]]
    assert len(got) == 200 and held["score"].sum() > held["base_score"].sum()


def test_scores_of_odd_rows(spark, odd):
    got = H.score_documents(odd, frequent=4, own=2, shared=4).toPandas()
    assert len(got) == odd.count() and got["n_tokens"].min() == 1 and got["score"].notna().all()
    assert H.score_documents(odd.limit(0)).count() == 0
