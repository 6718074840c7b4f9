"""Language identification, word first with backoff to character n-grams.

A known word is scored by the logarithm of its relative frequency in each language. For an unseen
word the longest n-grams are scored of which at least one is known, then the next shorter ones, down
to single characters. A text goes to the language with the highest sum; the score is that
language's share when the sums are taken as log likelihoods (0 to 1).

Learning takes a bounded sample: of each language about `docs_per_language` documents, chosen by a hash
of their id and text, and keeps at most `entries` words and as many n-grams of each order, shared out
among the languages, the most frequent first (whole counts of equal size are kept or left together).

Words are runs of letters (Unicode's L) in lower case. A text that is null or has no letter is `und`
with score 0; so is every text if nothing could be learnt. Of languages with equal sums the first in
code point order is told. Rows whose language or text is null teach nothing. Repeated rows get repeated
results, an empty table none.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusjobs.llm.common import held, slices, small

UNKNOWN = "und"
#: N-grams of 4 characters down to 1; words are padded with a space on each side from 2 upwards.
ORDERS = (4, 3, 2, 1)
#: Runs of letters, among which other numbers (½, ², Ⅷ) may stand; letters() takes these out.
RUNS = re.compile(r"[^\W\d_]+")
#: Unseen words whose scores a Python worker remembers before it starts anew.
REMEMBERED = 100_000


@dataclass
class LanguageModel:
    """Log frequencies: for each order (0: words) its keys and a matrix with a column for each language."""

    languages: list[str]
    keys: dict[int, list[str]]
    values: dict[int, np.ndarray]


def letters(text: str) -> list[str]:
    """The words of a text: runs of letters by Unicode (L), in lower case."""
    found = RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


class Scorer:
    """Predictions with a model; keeps the scores of words it has met in one matrix."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.places = {n: {g: k for k, g in enumerate(model.keys.get(n, []))} for n in ORDERS}
        self.start()

    def start(self) -> None:
        known = self.model.keys.get(0, [])
        self.rows = {w: k for k, w in enumerate(known)}
        self.scores = np.zeros((len(known) + REMEMBERED, len(self.model.languages)))
        if known:
            self.scores[: len(known)] = self.model.values[0]

    def unseen(self, word: str) -> np.ndarray | float:
        """The scores of a word that isn't known: the mean over its longest n-grams that are."""
        for n in ORDERS:
            spread = f" {word} " if n > 1 else word
            places = self.places[n]
            found = [places[g] for k in range(len(spread) - n + 1) if (g := spread[k : k + n]) in places]
            if found:
                return self.model.values[n][found].mean(axis=0)
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letters(text) if text else []
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        try:
            rows = list(map(self.rows.__getitem__, found))
        except KeyError:
            rows = []
            if len(self.rows) + len(found) > len(self.scores):
                self.start()
                if len(self.rows) + len(found) > len(self.scores):  # a text with more words than are remembered
                    extra = np.zeros((len(found), self.scores.shape[1]))
                    self.scores = np.concatenate([self.scores, extra])
            for w in found:
                if (k := self.rows.get(w)) is None:
                    k = self.rows[w] = len(self.rows)
                    self.scores[k] = self.unseen(w)
                rows.append(k)
        sums = self.scores[rows].sum(axis=0)
        best = int(sums.argmax())
        return self.model.languages[best], float(1 / np.exp(sums - sums[best]).sum())


def held_out(doc_id: Column, remainder: int = 2, of: int = 4) -> Column:
    """Whether a document is left out of learning; never for a null id, which teaches nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def learn(rows: DataFrame, docs_per_language: int = 5_000, entries: int = 60_000) -> LanguageModel:
    """A model from rows (doc_id, text, lang); see the module's text for the bounds."""
    own = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return LanguageModel([], {}, {})
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / sizes[k]))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = own.where(chance < share[F.col("lang")])
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    words = sample.select("lang", word.alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), F.col("key"), F.lit(" "))

    def grams(n: int) -> Column:
        spread = F.col("key") if n == 1 else padded
        places = F.sequence(F.lit(1), F.greatest(F.length(spread) - (n - 1), F.lit(1)))
        return F.filter(F.transform(places, lambda k: F.struct(F.lit(n).alias("order"), F.substring(spread, k, F.lit(n)).alias("key"))), lambda g: F.length(g["key"]) == n)

    every = F.concat(F.array(F.struct(F.lit(0).alias("order"), "key")), *[grams(n) for n in ORDERS])
    counts = words.select("lang", "n", F.explode(every).alias("of")).groupBy("lang", "of.order", "of.key").agg(F.sum("n").alias("n")).cache()
    # The least count that keeps a language's table within its share, from the number of keys with each count.
    each = max(1, entries // len(languages))
    sizes_by_count = counts.groupBy("lang", "order", "n").agg(F.count("*").alias("keys"))
    running = F.sum("keys").over(Window.partitionBy("lang", "order").orderBy(F.desc("n")))
    least = sizes_by_count.withColumn("running", running).where(F.col("running") <= each).groupBy("lang", "order").agg(F.min("n").alias("least"))
    totals = {(r["lang"], r["order"]): (r["total"], r["distinct"]) for r in counts.groupBy("lang", "order").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).collect()}
    kept = counts.join(small(least), ["lang", "order"]).where("n >= least").select("order", "key").distinct()
    found = counts.join(kept, ["order", "key"]).groupBy("order", "key").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    keys: dict[int, list[str]] = {}
    rows_of: dict[int, list[list[int]]] = {}
    for r in found.collect():  # at most `entries` keys of each order
        keys.setdefault(r["order"], []).append(r["key"])
        rows_of.setdefault(r["order"], []).append([r["by"].get(k, 0) for k in languages])
    counts.unpersist()
    values = {}
    for n, rows_n in rows_of.items():
        total, distinct = (np.array([totals.get((k, n), (0, 0))[j] for k in languages], np.float64) for j in (0, 1))
        values[n] = np.log((np.array(rows_n, np.float64) + 0.1) / (total + 0.1 * (distinct + 1)))
    return LanguageModel(languages, keys, values)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score", drop_text: bool = False) -> DataFrame:
    """docs with the predicted language and its score; columns of these names are replaced, and the text is left out on demand."""
    keep = [c for c in docs.columns if c not in (lang, score, text)]
    back = [] if drop_text else [text]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").cast("string").alias(c) for c in back], F.lit("").alias(lang), F.lit(0.0).alias(score)).schema
    sent, name = docs.sparkSession.sparkContext.broadcast(model), ("languages", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(name, lambda: Scorer(sent.value))
        for batch in slices(batches):
            found = [scorer.predict(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + len(back)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, *back, lang, score])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, schema)


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learnt from the documents that aren't held out."""
    aside = held_out(F.col("doc_id"))
    model = learn(docs.where(~aside & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", aside.alias("held_out"), "text"), model, drop_text=True).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with a predicted language whose score is at least so high, with their own columns."""
    model = learn(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return identify(docs, model, lang="predicted language", score="predicted score").where((F.col("predicted language") != UNKNOWN) & (F.col("predicted score") >= least)).select(*[f"`{c}`" for c in docs.columns])
