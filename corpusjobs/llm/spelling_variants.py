"""Spelling variant grouping: words at one edit found in a trie over counts of letter groups.

Letters are dealt into groups by how often words use them: frequent ones alone, the rest together. A word's
path in the trie is its length, then how many of its letters are of each group, group by group. Two words at one
edit differ in length by one at most, and in their counts by a surplus of one and a deficit of one at most: a
replaced letter leaves one group and enters one, an inserted or deleted one does half of that. So a depth-first
search that spends this budget along its way meets all words near another; the words at its leaves are
verified letter by letter.

The trie is cut where its branches get small: a branch with at most `branch` words is one piece of work, whatever
the corpus, and only the numbers of words at nodes above these cuts (at most `nodes` a level, by raising
`branch`) are broadcast. A word asks in every branch that its budget reaches. Where many words ask in one branch, they are
dealt into parts of about `asking`, and a leaf with more words than `branch` is dealt too, so that no task holds
more. Within a branch the search carries all asking words down together, each with what is left of its budget.

Runs of letters are `[A-Za-z]` and U+00C0 to U+00FF, with only A-Z lower-cased. A null text has none; a null id counts as
an empty one. Words are the different runs with at least `letters` code points and `least` occurrences. Of near words
with equal numbers of occurrences the smallest in code point order is told. Repeated rows count as often as they occur,
very long texts are read whole, an empty table gives an empty result, and other columns aren't looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import checkpointed, scratch, slices, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that have a group of their own, and groups for all others.
ALONE, SHARED = 14, 5
#: Words below a node of the search that are looked at at once instead of further down.
FEW = 64
#: Longer words are compared as strings, one pair at a time.
LONG = 64
#: Pairs that a task compares at once.
PAIRS = 200_000


def occurrences(docs: DataFrame, letters: int, spoil: int | None = 199) -> DataFrame:
    """A row (word) for each run of at least so many letters; of those whose checksum `spoil` divides, one letter is deleted."""
    found = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"([A-Za-zÀ-ÿ]{{{letters},}}+)"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), found.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    if not spoil:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % spoil == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= letters)


def vocabulary(docs: DataFrame, letters: int = 6, least: int = 5, spoil: int | None = 199) -> DataFrame:
    """(word, n) of the words of the whole corpus."""
    return occurrences(docs, letters, spoil).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame) -> list[str]:
    """Groups of the letters, the most frequent letter first; a row for each letter of the alphabet comes to the driver."""
    seen = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()
    ranked = [r["c"] for r in sorted(seen, key=lambda r: (-r["n"], r["c"]))]
    groups = [*ranked[:ALONE], *("".join(ranked[ALONE + k :: SHARED]) for k in range(SHARED))]
    return [g for g in groups if g]


def path(word: Column, groups: list[str]) -> Column:
    """The length of a word and how many of its letters each group has: its way through the trie."""
    return F.array(F.length(word), *[F.length(word) - F.length(F.translate(word, g, "")) for g in groups])


def name(path: Column, depth: Column) -> Column:
    """A node of the trie: the first so many counts of a path."""
    return F.array_join(F.slice(path, 1, depth), ",")


def heavy_nodes(paths: DataFrame, depth: int, branch: int) -> set[str]:
    """Nodes with more words below than a branch may have; the root is the empty name."""
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: name(F.col("path"), k))).alias("node"))
    return {r["node"] for r in each.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > branch).select("node").collect()}


def start(own: int, other: int) -> tuple[int, int]:
    """Surplus and deficit that words of these lengths may have in all; (-1, -1) if their lengths rule an edit out."""
    return {0: (1, 1), 1: (1, 0), -1: (0, 1)}.get(own - other, (-1, -1))


def branches(path: list[int], heavy: set[str]) -> list[str]:
    """The branches that a word at one edit from a word with this path may lie in (also some that don't exist)."""
    if "" not in heavy:
        return [""]
    found: list[str] = []
    # Nodes to visit: name, depth, surplus and deficit left; the last one is visited next.
    waiting = [(str(path[0] + d), 1, *start(path[0], path[0] + d)) for d in (-1, 0, 1)]
    while waiting:
        node, depth, surplus, deficit = waiting.pop()
        if depth == len(path) or node not in heavy:
            found.append(node)
            continue
        own = path[depth]
        waiting.append((f"{node},{own}", depth + 1, surplus, deficit))
        if surplus and own:
            waiting.append((f"{node},{own - 1}", depth + 1, 0, deficit))
        if deficit:
            waiting.append((f"{node},{own + 1}", depth + 1, surplus, 0))
    return found


def home(path: list[int], heavy: set[str]) -> str:
    """The branch that holds a word with this path."""
    if "" not in heavy:
        return ""
    for depth in range(1, len(path)):
        if (node := ",".join(map(str, path[:depth]))) not in heavy:
            return node
    return ",".join(map(str, path))


def routed(paths: DataFrame, heavy: set[str]) -> DataFrame:
    """(word, n, path, node, asks): each word once in its own branch, and once in every branch where it asks."""
    sent = paths.sparkSession.sparkContext.broadcast(heavy)
    depth = max((h.count(",") + 2 for h in heavy if h), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, known = sent.value, {}
        for batch in slices(batches):
            nodes = []
            for p in batch.column(2).to_pylist():
                if (key := tuple(p[:depth])) not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = [home(p, heavy), *branches(p, heavy)]
                nodes.append(known[key])
            many = np.array([len(x) for x in nodes], np.int64)
            asks = np.ones(int(many.sum()), bool)
            asks[np.cumsum(many) - many] = False
            at = pa.array(np.repeat(np.arange(len(many)), many))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([x for some in nodes for x in some], pa.string()), pa.array(asks)], names=["word", "n", "path", "node", "asks"])

    return paths.select("word", "n", "path").mapInArrow(run, "word string, n long, path array<int>, node string, asks boolean")


def codes(words: list[str], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, filled up with zeros to one more than `wide` (or cut there), and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(w[: wide + 1].ljust(wide + 1, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), wide + 1), lengths


def one_edit(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether rows of a and b, code points and at least one zero, are words at exactly one inserted, deleted or replaced letter."""
    differ = a != b
    first = differ.argmax(axis=1)
    some = differ[np.arange(len(a)), first]
    after = np.arange(a.shape[1] - 1) >= first[:, None]
    replaced = ~(differ[:, 1:] & after).any(axis=1)  # nothing else differs behind the first place
    longer, shorter = np.where((la > lb)[:, None], a, b), np.where((la > lb)[:, None], b, a)
    moved = ~((longer[:, 1:] != shorter[:, :-1]) & after).any(axis=1)
    return some & np.where(la == lb, replaced, (np.abs(la - lb) == 1) & moved)


def one_edit_apart(a: str, b: str) -> bool:
    """The same of two long words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = len(os.path.commonprefix([a, b]))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def counts(paths: pa.ChunkedArray) -> np.ndarray:
    """Paths as rows of a matrix. Counts beyond 30,000 are made equal, which only lets more words pass."""
    if not len(paths):
        return np.zeros((0, 1), np.int16)
    return np.minimum(paths.combine_chunks().flatten().to_numpy().reshape(len(paths), -1), 30_000).astype(np.int16)


class Branch:
    """The words of a branch as a trie that all asking words go down together."""

    def __init__(self, words: list[str], n: np.ndarray, paths: np.ndarray, asking: list[str], asking_paths: np.ndarray):
        order = np.lexsort(paths.T[::-1])
        self.paths, self.words, self.asking_paths = paths[order], [words[k] for k in order], asking_paths
        self.n = n[order]
        self.asking = asking
        wide = min(LONG, max(map(len, [*words, *asking]), default=1))
        self.codes, self.lengths = codes(self.words, wide)
        self.asking_codes, self.asking_lengths = codes(asking, wide)
        #: Words by falling occurrences, equal ones in code point order, and each word's place among them.
        self.ranked = sorted(range(len(order)), key=lambda k: (-self.n[k], self.words[k]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[self.ranked] = np.arange(len(order))
        self.near = np.zeros(len(asking), np.int64)
        self.best = np.full(len(asking), len(order), np.int64)
        self.met: list[tuple[np.ndarray, np.ndarray]] = []
        self.many = 0

    def search(self) -> None:
        """Depth first over the nodes: a range of words with equal counts so far, and who asks with what is left to spend."""
        who = np.arange(len(self.asking_paths))
        waiting = [(0, len(self.words) if len(who) else 0, 0, who, np.ones(len(who), np.int16), np.ones(len(who), np.int16))]
        depths = self.paths.shape[1]
        while waiting:
            low, high, depth, who, surplus, deficit = waiting.pop()
            if depth == depths or high - low <= FEW:
                self.leaf(low, high, depth, who, surplus, deficit)
                continue
            column = self.paths[low:high, depth]
            own = self.asking_paths[who, depth]
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
            for a, b in zip(cuts[:-1], cuts[1:]):
                off = own - column[a]
                if depth:
                    some = np.flatnonzero((off <= surplus) & (-off <= deficit))
                    off = off[some]
                    left = surplus[some] - np.maximum(off, 0), deficit[some] - np.maximum(-off, 0)
                else:  # lengths: equal ones leave both budgets, others the one that they need
                    some = np.flatnonzero(np.abs(off) <= 1)
                    off = off[some]
                    left = (off >= 0).astype(np.int16), (off <= 0).astype(np.int16)
                if len(some):
                    waiting.append((low + a, low + b, depth + 1, who[some], *left))
        self.verify()

    def leaf(self, low: int, high: int, depth: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """What is left of the paths of these words and those who ask, as one table of differences.

        Surplus less deficit is what the lengths differ by, so that both are within what is left if their sum is.
        """
        step = max(1, PAIRS // max(1, high - low))
        for k in range(0, len(who) if high > low else 0, step):
            own = who[k : k + step]
            asking, words = self.asking_paths[own], self.paths[low:high]
            left = (surplus + deficit)[k : k + step, None]
            if not depth:
                apart = np.abs(asking[:, :1] - words[:, 0])
                left = np.where(apart > 1, -1, 2 - apart)
            off = np.zeros((len(own), high - low), np.int16)
            for level in range(max(depth, 1), words.shape[1]):
                one = asking[:, level, None] - words[:, level]
                off += np.abs(one, out=one)
            asked, word = np.nonzero(off <= left)
            if len(asked):
                self.met.append((own[asked], low + word))
                self.many += len(asked)
                if self.many >= PAIRS:
                    self.verify()

    def verify(self) -> None:
        """Looks at the letters of all pairs that leaves have met."""
        if self.met:
            asked, word = (np.concatenate(x) for x in zip(*self.met))
            near = one_edit(self.asking_codes[asked], self.asking_lengths[asked], self.codes[word], self.lengths[word])
            for k in np.flatnonzero(np.maximum(self.asking_lengths[asked], self.lengths[word]) > LONG).tolist():
                near[k] = one_edit_apart(self.asking[asked[k]], self.words[word[k]])
            asked, word = asked[near], word[near]
            self.near += np.bincount(asked, minlength=len(self.near))
            np.minimum.at(self.best, asked, self.rank[word])
        self.met, self.many = [], 0


def near_words(words: DataFrame, branch: int = 4_096, nodes: int = 20_000, asking: int = 32_768) -> DataFrame:
    """(word, n_near, form, form_n) of words (word, n) that have near words: their number, and the one with most occurrences."""
    session = words.sparkSession
    groups = letter_groups(words)
    place = scratch(session, "paths")
    words.select("word", "n", path(F.col("word"), groups).alias("path")).write.parquet(place)
    paths = session.read.parquet(place)
    branch = max(branch, paths.count() // nodes)  # at most `nodes` nodes of a level have more words than that
    place = scratch(session, "branches")
    routed(paths, heavy_nodes(paths, len(groups) + 1, branch)).write.parquet(place)
    rows = session.read.parquet(place)
    # How many parts the words of a branch and those that ask there are dealt into; branches without words go.
    size = rows.groupBy("node").agg(F.sum((~F.col("asks")).cast("long")).alias("held"), F.sum(F.col("asks").cast("long")).alias("asked")).where("held > 0")
    parts = size.select("node", F.ceil(F.col("held") / branch).alias("held parts"), F.ceil(F.greatest(F.col("asked"), F.lit(1)) / asking).alias("asked parts"))
    dealt = rows.join(small(parts), "node")
    h = F.xxhash64("word")
    one, other = F.when(F.col("asks"), F.col("held parts")).otherwise(F.col("asked parts")), F.when(F.col("asks"), F.col("asked parts")).otherwise(F.col("held parts"))
    own = F.pmod(h, other)
    dealt = dealt.select("word", "n", "path", "node", "asks", own.alias("own"), F.explode(F.sequence(F.lit(0), one - 1)).alias("met"))
    dealt = dealt.select("word", "n", "path", "node", "asks", F.when(F.col("asks"), F.col("met")).otherwise(F.col("own")).alias("held"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("met")).alias("asked"))

    def run(part: pa.Table) -> pa.Table:
        asks = part["asks"].to_numpy()
        held, asked = part.filter(pa.array(~asks)), part.filter(pa.array(asks))
        b = Branch(held["word"].to_pylist(), held["n"].to_numpy(), counts(held["path"]), asked["word"].to_pylist(), counts(asked["path"]))
        b.search()
        some = b.near > 0
        best = [b.ranked[k] for k in b.best[some]]
        return pa.table({"word": asked["word"].filter(pa.array(some)), "n_near": b.near[some], "form": pa.array([b.words[k] for k in best], pa.string()), "form_n": b.n[best]})

    hits = dealt.groupBy("node", "held", "asked").applyInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form"))
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the end of each chain, by doubled steps; a chain's occurrences grow, so it has no circle."""
    steps = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = checkpointed(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")


def variants(docs: DataFrame, letters: int = 6, least: int = 5, times: int = 5, spoil: int | None = 199, branch: int = 4_096) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of docs (doc_id, text); see the module's text.

    A word's form is its near word with most occurrences, if it has `times` those of the word.
    """
    place = scratch(docs.sparkSession, "words")
    vocabulary(docs.select("doc_id", F.col("text").cast("string").alias("text")), letters, least, spoil).write.parquet(place)
    words = docs.sparkSession.read.parquet(place)
    fits = F.col("form_n") >= times * F.col("n")
    near = checkpointed(words.join(near_words(words, branch), "word", "left").select("word", F.when(fits, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n")))
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
