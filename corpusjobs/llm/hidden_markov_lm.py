"""Language-model scores of a hidden Markov model, and of the unigram base it is compared with.

Tokens are words in lower case (A-Z) and one end for each text. Counts of all tokens come from all
training texts. The `own` most frequent words are symbols of the hidden model; every other word belongs
to one of `shared` symbols by its beginning and its last byte, and has its share of that symbol:
(c + 0.1) / (the symbol's sum of c + 0.1, and 0.1 for unknown words). Each text is taken apart once; its
symbols are written to the shared folder, which the rounds and the scoring read.

Training: every Baum-Welch round runs over all training texts, whose expected counts are summed in each
partition and then across partitions. Rounds go on until the log likelihood grows by less than `settled`
of itself, or to `rounds`. Only the start comes from a sample: clusters of the symbol counts of about
`sample` whole texts. The score is the log10 probability of the whole text: the scaled forward recursion
over its symbols, and the words' shares.

Counts of the `frequent` most frequent words travel with the tasks; the rest of the words of each text
are joined with the count table. Null text counts as empty (its end is scored). A null id is never held
out and teaches nothing. Repeated rows get repeated results. Texts of any length are one sequence. An
empty table gives an empty result; columns other than doc_id and text aren't read. Of words of equal counts at the edge of the
`own` ones the first in byte order is in; at the edge of the `frequent` ones all are in or none.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import scratch, slices

#: Tokens of padded texts, and texts, that are worked on at once: many, since each place of all texts is one step.
AT_ONCE, TEXTS = 250_000, 2_048
SMOOTH = 0.1


class Places(dict):
    """Places of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class WordTable:
    """The frequent words with their counts, and the symbols of all words."""

    words: list[bytes]  # most frequent first
    counts: np.ndarray
    own: int
    shared: int
    sums: np.ndarray  # of each shared symbol: the sum of c + 0.1 over its words, and 0.1
    tokens: int
    distinct: int
    texts: int

    def __post_init__(self) -> None:
        self.end, self.symbols = self.own + self.shared, self.own + self.shared + 1

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("places", "symbol", "share")}

    def prepare(self) -> WordTable:
        if not hasattr(self, "places"):
            self.places = Places((w, k) for k, w in enumerate(self.words))
            self.symbol = np.array([k if k < self.own else self.symbol_of(w) for k, w in enumerate(self.words)], np.int32)
            self.share = np.array([0.0 if k < self.own else np.log10((c + SMOOTH) / self.sums[s - self.own]) for k, (c, s) in enumerate(zip(self.counts, self.symbol))])
        return self

    def symbol_of(self, word: bytes) -> int:
        return self.own + zlib.crc32(word[:3] + word[-1:]) % self.shared


def shared_symbol(word: Column, shared: int) -> Column:
    """As symbol_of() without its offset."""
    return (F.crc32(F.concat(F.substring(word, 1, 3), F.substring(word, -1, 1))) % shared).cast("int")


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


@dataclass
class HiddenModel:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    def step(self, found: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of symbol sequences, the longest first: log likelihood, starts, moves, emissions."""
        seen, there = padded(found)
        at_work = there.sum(axis=1).tolist()  # the first so many sequences reach this far
        length, n, states = *seen.shape, len(self.start)
        move, one = self.move.astype(np.float32), np.ones(states, np.float32)
        e = self.emit.astype(np.float32)[seen]
        a, c = np.empty((length, n, states), np.float32), np.ones((length, n), np.float32)
        for t, k in enumerate(at_work):
            now = a[t, :k]
            if t:
                np.matmul(a[t - 1, :k], move, out=now)
            else:
                now[:] = self.start
            now *= e[t, :k]
            c[t, :k] = now @ one
            now /= c[t, :k, None]
        b, moves, back = np.ones((n, states), np.float32), np.zeros((states, states)), move.T.copy()
        for t in range(length - 1, -1, -1):
            k = at_work[t]
            w = e[t, :k]  # becomes what a move into t gains, by state
            w *= b[:k]
            w /= c[t, :k, None]
            gamma = a[t, :k] * b[:k]
            if t:
                moves += a[t - 1, :k].T @ w
                np.matmul(w, back, out=b[:k])
            a[t, :k] = gamma
        flat, gamma = seen[there], a[there]
        emissions = np.stack([np.bincount(flat, gamma[:, s], len(self.emit)) for s in range(states)], axis=1)
        return float(np.log(c, dtype=np.float64).sum()), a[0].sum(axis=0, dtype=np.float64), moves * self.move, emissions

    def likelihood(self, found: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each sequence, by the scaled forward recursion."""
        seen, there = padded(found)
        a, total = None, np.zeros(seen.shape[1])
        for t in range(len(seen)):
            n = int(there[t].sum())  # the longest come first, so those that go on are at the front
            a = (self.start if a is None else a[:n] @ self.move) * self.emit[seen[t, :n]]
            c = a.sum(axis=1)
            a /= c[:, None]
            total[:n] += np.log10(c)
        return total

    @staticmethod
    def of(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray) -> HiddenModel:
        """The model that makes the counts most likely, smoothed a little."""
        s, m = starts + 1e-3, moves + 1e-3
        e = emissions + 0.01 * (emissions.sum(axis=1, keepdims=True) + 1) / (emissions.sum() + len(emissions)) * np.maximum(emissions.sum(axis=0), 1)
        return HiddenModel(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))


def padded(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences side by side, time downwards, and which places are real."""
    lengths = np.array([len(x) for x in found])
    seen = np.zeros((lengths.max(), len(found)), np.int32)
    for k, x in enumerate(found):
        seen[: len(x), k] = x
    return seen, np.arange(lengths.max())[:, None] < lengths


def similar(found: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The sequences in groups of similar length, the longest first, with their places."""
    order = sorted(range(len(found)), key=lambda k: -len(found[k]))
    at = 0
    while at < len(order):
        n = max(1, min(TEXTS, AT_ONCE // len(found[order[at]])))
        yield order[at : at + n], [found[k] for k in order[at : at + n]]
        at += n


def started(counts: np.ndarray, states: int) -> HiddenModel:
    """States from clusters of texts, given the symbol counts of each (texts x symbols)."""
    symbols = counts.shape[1]
    if not len(counts):
        return HiddenModel(np.ones(1), np.ones((1, 1)), np.full((symbols, 1), 1 / symbols))
    pick = np.random.default_rng(5)
    x = np.sqrt(counts)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = [x[pick.integers(len(x))]]
    while len(centres) < min(states, len(x)):  # the farther from all centres, the likelier the next one
        far = np.maximum(1 - (x @ np.array(centres).T).max(axis=1), 1e-9)
        centres.append(x[pick.choice(len(x), p=far / far.sum())])
    c = np.array(centres)
    for _ in range(8):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([v / max(float(np.linalg.norm(v)), 1e-9) for v in (x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c)))])
    n = len(c)
    emissions = np.stack([counts[own == s].sum(axis=0, dtype=np.float64) for s in range(n)], axis=1)
    return HiddenModel.of(np.bincount(own, minlength=n).astype(float), np.full((n, n), 0.1 / n) + 0.9 * np.eye(n), emissions + 0.02 * emissions.sum(axis=1, keepdims=True))


def summed(model: HiddenModel, found: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    total, starts, moves, emissions = 0.0, np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)
    for _, group in similar(found):
        ll, s, m, e = model.step(group)
        total, starts, moves, emissions = total + ll, starts + s, moves + m, emissions + e
    return total, starts, moves, emissions


def sequences(column: pa.Array) -> list[np.ndarray]:
    """The symbols of texts from their bytes."""
    return [np.frombuffer(x, "<i4") for x in column.to_pylist()]


def aside(doc_id: Column) -> Column:
    """Whether a document is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; tasks send the sums of what they have read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens_of(t))
                if len(held) > 250_000:
                    yield from sent(held)
                    held.clear()
        yield from sent(held)

    def sent(held: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(held), 50_000):
            if k == 0:
                words, counts = list(held), list(held.values())
            yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.binary()), pa.array(counts[k : k + 50_000], pa.int64())], names=["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn_words(counts: DataFrame, texts: int, frequent: int, own: int, shared: int) -> tuple[WordTable, int]:
    """The word table, and the count under which words aren't in it."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    step = F.floor(F.log(F.col("c").cast("double")) * 16)
    sizes = {r["step"]: (r["n"], r["least"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()}  # a few hundred steps
    held, least = 0, 2**62
    for s in sorted(sizes, reverse=True):
        if held + sizes[s][0] > frequent:
            break
        held, least = held + sizes[s][0], sizes[s][1]
    top = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True])  # at most `frequent` words
    words, c = [bytes(w) for w in top["word"]], top["c"].to_numpy(np.float64)
    own = min(own, len(words))
    sums = np.full(shared, SMOOTH)
    for r in counts.groupBy(shared_symbol(F.col("word"), shared).alias("symbol")).agg((F.sum("c") + SMOOTH * F.count("*")).alias("sum")).collect():  # a row for each shared symbol
        sums[r["symbol"]] += r["sum"]
    for w, n in zip(words[:own], c[:own]):
        sums[zlib.crc32(w[:3] + w[-1:]) % shared] -= n + SMOOTH
    return WordTable(words, c, own, shared, np.maximum(sums, SMOOTH), int(total["n"]) + texts, int(total["v"]) + (texts > 0), texts), least


def take_apart(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """rows (doc_id, h, held_out, teaches, text) with the text's symbols, what its frequent words give, and the rest of its words."""
    parts = "symbols binary, n_tokens long, n_known long, base double, shares double, rest array<struct<word:binary,tf:int>>"
    rest_type = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.prepare()
        logs = np.log10(table.counts + SMOOTH) if len(table.words) else np.zeros(1)
        share = table.share if len(table.words) else np.zeros(1)
        symbol = table.symbol if len(table.words) else np.zeros(1, np.int32)
        ends, below = np.log10(table.texts + SMOOTH), np.log10(table.tokens + SMOOTH * (table.distinct + 1))
        missing = np.log10(table.sums)
        for b in slices(batches):
            split = [tokens_of(t) for t in b.column(4).to_pylist()]
            n, lengths = len(split), np.array([len(w) for w in split], np.int64)
            at = np.fromiter(chain.from_iterable(map(table.places.__getitem__, w) for w in split), np.int64, int(lengths.sum()))
            whose, known = np.repeat(np.arange(n), lengths), at >= 0
            own = symbol[at]
            mine, base = (np.bincount(whose[known], x[at[known]], n).astype(float) for x in (share, logs))
            told = np.bincount(whose[known], minlength=n)
            words = list(chain.from_iterable(split))
            rest: list[Counter[bytes]] = [Counter() for _ in range(n)]
            for k in np.flatnonzero(~known).tolist():
                w = words[k]
                own[k] = s = table.symbol_of(w)
                rest[whose[k]][w] += 1
                mine[whose[k]] -= missing[s - table.own]
            flat = np.full(len(at) + n, table.end, "<i4")
            flat[np.arange(len(at)) + whose] = own  # each text's end stands behind its words
            offsets = np.concatenate([[0], np.cumsum(4 * (lengths + 1))]).astype(np.int32)
            symbols = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            sizes = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array([w for r in rest for w in r], pa.binary()), pa.array([c for r in rest for c in r.values()], pa.int32())], names=["word", "tf"])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], symbols, pa.array(lengths + 1), pa.array(told + (table.texts > 0)), pa.array(base + ends - below * (lengths + 1)), pa.array(mine), pa.ListArray.from_arrays(sizes, pairs).cast(rest_type)],
                names=["doc_id", "h", "held_out", "teaches", *(p.split()[0] for p in parts.split(", "))],
            )

    return rows.mapInArrow(run, f"doc_id long, h long, held_out boolean, teaches boolean, {parts}")


def improved(model: HiddenModel, training: DataFrame, symbols: int) -> tuple[HiddenModel, float]:
    """One Baum-Welch round over all training texts: the better model, and the log likelihood of the one before."""
    sent = training.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = sent.value, None
        for b in slices(batches, 2 * TEXTS):
            now = summed(m, sequences(b.column(0)))
            total = list(now) if total is None else [x + y for x, y in zip(total, now)]
        if total is not None:
            flat = np.concatenate([np.ravel(x) for x in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat, pa.float64())], names=["k", "v"])

    sums = training.select("symbols").mapInArrow(expected, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()  # the model's size
    flat = np.zeros(1 + states * (1 + states + symbols))
    flat[sums["k"].to_numpy()] = sums["v"].to_numpy()
    starts, moves, emissions = np.split(flat[1:], [states, states + states**2])
    return HiddenModel.of(starts, moves.reshape(states, states), emissions.reshape(-1, states)), float(flat[0])


def symbol_counts(training: DataFrame, symbols: int) -> np.ndarray:
    """The counts of all symbols in each text; a row takes no more than there are symbols, however long its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [np.bincount(x, minlength=symbols).astype("<f4").tobytes() for x in sequences(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["counts"])

    rows = training.select("symbols").mapInArrow(run, "counts binary").toPandas()["counts"]
    return np.array([np.frombuffer(x, "<f4") for x in rows]).reshape(-1, symbols)


def score_documents(docs: DataFrame, states: int = 8, frequent: int = 200_000, own: int = 3_000, shared: int = 512, sample: int = 1_500, rounds: int = 4, settled: float = 0.002) -> DataFrame:
    """A row for each document, with the columns of the contract."""
    spark = docs.sparkSession
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), aside(F.col("doc_id")).alias("held_out"), (~aside(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("teaches"), text.alias("text"))
    place = scratch(spark, "word-counts")
    count_words(rows.where("teaches").select("text")).write.parquet(place)
    counts = spark.read.schema("word binary, c long").parquet(place)
    texts = rows.where("teaches").count()
    table, least = learn_words(counts, texts, frequent, own, shared)
    place = scratch(spark, "symbols")
    take_apart(rows, spark.sparkContext.broadcast(table)).write.parquet(place)
    apart = spark.read.parquet(place)
    training = apart.where("teaches")
    chance = F.pmod(F.xxhash64("doc_id", "h"), F.lit(1_000_000)) < 1_000_000 * min(1.0, 1.0 * sample / max(texts, 1))
    model, last = started(symbol_counts(training.where(chance), table.symbols), states), -np.inf
    for _ in range(rounds if texts else 0):
        model, now = improved(model, training, table.symbols)
        if now - last <= settled * abs(now):
            break
        last = now
    final = spark.sparkContext.broadcast(model)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = final.value
        for b in slices(batches, 2 * TEXTS):
            found = sequences(b.column(b.num_columns - 1))
            out = np.zeros(len(found))
            for where, group in similar(found):
                out[where] = m.likelihood(group)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names=[*told, "likely"])

    told = ["doc_id", "h", "held_out", "n_tokens", "n_known", "base", "shares"]
    scored = apart.select(*told, "symbols").mapInArrow(likely, "doc_id long, h long, held_out boolean, n_tokens long, n_known long, base double, shares double, likely double")
    scored = scored.select("doc_id", "h", F.struct("held_out", "n_tokens", "n_known", "base", (F.col("likely") + F.col("shares")).alias("score")).alias("doc"), F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("known"))
    rare = apart.select("doc_id", "h", F.explode("rest").alias("of")).select("doc_id", "h", "of.word", "of.tf").join(counts.where(F.col("c") < least), "word", "left")
    rare = rare.select("doc_id", "h", F.lit(None).cast(dict(scored.dtypes)["doc"]).alias("doc"), (F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0).cast("long").alias("known"))
    by_text = scored.unionByName(rare).groupBy("doc_id", "h").agg(F.count("doc").alias("rows"), F.first("doc", ignorenulls=True).alias("doc"), F.sum("more").alias("rest"), F.sum("known").alias("known"))
    # Rows that are equal have told the same words: all sums are so many times too large.
    rest, known = (F.col(k) / F.col("rows") for k in ("rest", "known"))
    return by_text.select(
        "doc_id", "doc.held_out", "doc.n_tokens", (F.col("doc.n_known") + known.cast("long")).alias("n_known"), F.lit(table.tokens).cast("long").alias("train_tokens"),
        (F.col("doc.base") + rest).alias("base_score"), (F.col("doc.score") + rest).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"),
    ).drop("row")
