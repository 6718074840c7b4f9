"""N-gram Jaccard join by chosen paths: sets are split on sampled tokens they share; small buckets are compared in full.

A document is the set of its shingles (five words, lower case; a text of fewer words is one shingle).
Documents with the same words in the same order are one class; classes are what is joined, so copies
are never expanded into pairs.

First level: a run samples, by the shingle's own hash, 1 / threshold shingles of each set; two sets with
the threshold's similarity share one of them on average. `runs` follow from the target recall, since all
of them miss such a pair with probability exp(-runs) at most; together they sample `amount` shingles.
The classes that share a shingle are a bucket.

Recursion: classes whose partners may share only shingles that many classes hold are dealt anew in runs of
paths: a run's path is the shingles of the whole set that are the smallest under `depth` fresh hashes, so
two sets meet in a run with their similarity to the power `depth`. Again the number of runs follows from
the target recall (`splits`). Classes in buckets that are still large go on to paths of twice the depth, as
long as this halves the pairs to look at, which two of the deeper runs tell first. A crowd that no longer splits is one of similar texts: the classes
that its large buckets connect become one bucket, where that is less work than the buckets of all runs, and
large buckets are cut into tiles, in which all pairs are looked at. So what the sampling leaves large is
compared in full.

Two tests rule classes and pairs out before the exact comparison, both by the number of sampled shingles
that are shared: it is below `least_shared` for a pair at the threshold with probability 1 - target_recall
at most (the exact binomial tail). Each pair is looked at in one bucket only: the smallest that both stand
in. For what is left, the whole sets are read again from the texts and the Jaccard index is computed
exactly. A block of comparisons reports how many documents each class links to, and edges that keep linked
classes connected; never all pairs.

Nulls and texts without words link with nothing, nor do rows with a null id. Every row of the input
gives one row. Very long texts are one set each, read whole. An empty table gives an empty result. Columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import checkpointed, held, slices, small
from corpusjobs.llm.components import components

WIDTH = 5
#: Classes of a bucket of the first level that is compared at once.
BUCKET = 128
#: Classes, and shingles, of a tile of a larger bucket.
TILE, TOKENS = 512, 1_000_000
#: Runs of paths beyond which no deeper level is tried.
MOST_RUNS = 128
#: Runs of a deeper level that tell whether it is worth its other ones.
TRIED = 2
#: Words whose hashes a Python worker remembers before it starts anew.
REMEMBERED = 80_000


def shingles(text: str | None) -> tuple[bytes, np.ndarray]:
    """A digest of the words, and the distinct shingles as sorted 63-bit hashes."""
    words = (text or "").lower().split()
    if not words:
        return b"", np.empty(0, np.int64)
    known: dict[str, int] = held("hashes of words", dict)
    try:
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    key = hashlib.md5(h.tobytes()).digest()
    n = max(1, len(h) - WIDTH + 1)
    x = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(min(WIDTH, len(h))):
        x = (x ^ h[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return key, np.unique((x >> np.uint64(1)).astype(np.int64))


def sampled(tokens: np.ndarray, amount: float) -> np.ndarray:
    """The tokens under the share of the hash range that holds `amount` of them on average."""
    return tokens[: np.searchsorted(tokens, limit(len(tokens), amount))].copy()


def limit(size: int, amount: float) -> int:
    return min(2**63 - 1, int(2**63 * min(1.0, amount / max(size, 1))))


def least_shared(threshold: float, target_recall: float, most: int = 256) -> list[int]:
    """For 0 to `most` sampled shingles of the union of two sets at the threshold: how many both hold, but for a chance of 1 - target_recall."""
    out = []
    for n in range(most + 1):
        tail, k = 0.0, 0
        while k < n and (tail := tail + math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)) <= 1 - target_recall:
            k += 1
        out.append(k)
    return out


def splits(threshold: float, target_recall: float, depth: int) -> int:
    """Runs of paths of this depth after which a pair at the threshold has met in none with 1 - target_recall at most."""
    return math.ceil(math.log(1 - target_recall) / math.log1p(-min(threshold**depth, 1 - 1e-9)))


def hashes(runs: int, depth: int) -> np.ndarray:
    """Odd factors: a fresh hash for each step of each run's path."""
    return np.random.default_rng([runs, depth]).integers(0, 2**63, (runs, depth), np.uint64) * np.uint64(2) + np.uint64(1)


def paths(tokens: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key of each run's path, the smallest shingles by its factors; one key for a set of one shingle, none for none."""
    x = tokens.view(np.uint64)
    if len(x) < 2:
        return tokens.copy()
    flat = factors.ravel()
    low = np.full(len(flat), 2**64 - 1, np.uint64)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (flat[:, None] * x[None, at : at + 1024]).min(axis=1))
    key = np.full(len(factors), factors.shape[1], np.uint64)
    for step in low.reshape(factors.shape).T:
        key = (key ^ step) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    key = (key ^ key >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return ((key ^ key >> np.uint64(32)) >> np.uint64(1)).astype(np.int64)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first columns, over the borders of batches."""
    rows = (row for b in batches for row in zip(*(columns(c) for c in b.columns)))
    for _, run in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield list(run)


def columns(c: pa.Array) -> list:
    """Values of a column; lists of numbers as arrays."""
    if not pa.types.is_list(c.type):
        return c.to_pylist()
    flat, at = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def candidates(rows: list[tuple], amount: float, threshold: float, least: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """(block, class, partners) of one bucket or tile; rows: bucket, x, y, chunk, class, size, pool, buckets."""
    bucket, x, y = rows[0][:3]
    rows = sorted(rows, key=lambda r: (r[5], r[4]))
    n, sizes = len(rows), np.array([r[5] for r in rows], np.float64)
    found: dict[int, list[int]] = {}
    if n <= 24:
        pools, own = [set(r[6].tolist()) for r in rows], [set(r[7].tolist()) for r in rows]
        for i, j in itertools.combinations(range(n), 2):
            if sizes[i] < threshold * sizes[j] or x != y and rows[i][3] == rows[j][3] or min(own[i] & own[j]) != bucket:
                continue
            top = limit(int(sizes[j]), amount)
            union = sum(t < top for t in pools[i] | pools[j])
            if sum(t < top for t in pools[i] & pools[j]) >= least[min(union, len(least) - 1)]:
                found.setdefault(i, []).append(j)
    else:
        # A bucket before this one that both stand in, and the sampled shingles they share, as matrix products.
        before = incidence([r[7][r[7] < bucket] for r in rows])
        pools = [np.sort(r[6]) for r in rows]
        shared = incidence(pools)
        apart = np.array([r[3] for r in rows])
        tops = np.array([limit(int(s), amount) for s in sizes])
        for at in range(0, n, 128):
            i = np.arange(at, min(n, at + 128))
            fit = (sizes[i][:, None] >= threshold * sizes[None, :]) & (np.arange(n)[None, :] > i[:, None]) & (before[i] @ before.T == 0)
            if x != y:
                fit &= apart[i][:, None] != apart[None, :]
            both = shared[i] @ shared.T  # the larger set's pool lies under its own limit, so what is shared does
            under = np.stack([np.searchsorted(pools[k], tops) for k in i])
            held = np.array([len(p) for p in pools])[None, :]
            fit &= both >= least[np.minimum(under + held - both, len(least) - 1).astype(np.int64)]
            for a, b in zip(*np.nonzero(fit)):
                found.setdefault(int(i[a]), []).append(int(b))
    if found:
        block = xxhash.xxh3_64_intdigest(f"{bucket},{x},{y}") >> 1
        for k in sorted(set(found) | {j for js in found.values() for j in js}):
            yield block, rows[k][4], [rows[j][4] for j in found.get(k, [])]


def incidence(lists: list[np.ndarray]) -> np.ndarray:
    """A row for each list, a column for each value that two lists hold."""
    flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
    who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    kept = np.cumsum(count > 1) - 1
    out = np.zeros((len(lists), int((count > 1).sum())), np.float32)
    use = count[place] > 1
    out[who[use], kept[place[use]]] = 1
    return out


def compared(rows: list[tuple], threshold: float) -> Iterator[tuple[int, int, int]]:
    """(class, class, documents that the first links to, told once for each) of one block; rows: block, class, n, partners, tokens."""
    place = {r[1]: k for k, r in enumerate(rows)}
    values, flat = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
    lengths = np.array([len(r[4]) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    marked = np.zeros(len(values), np.int64)
    linked, edges = [0] * len(rows), []
    tree = list(range(len(rows)))

    def root(k: int) -> int:
        while tree[k] != k:
            tree[k] = tree[tree[k]]
            k = tree[k]
        return k

    for i, r in enumerate(rows):
        if not len(r[3]):
            continue
        partners = np.array([place[c] for c in r[3].tolist()])
        marked[flat[starts[i] : starts[i + 1]]] = 1
        if 4 * len(partners) > len(rows):
            both = np.add.reduceat(marked[flat], starts[:-1])[partners]
        else:
            both = np.array([marked[flat[starts[j] : starts[j + 1]]].sum() for j in partners])
        marked[flat[starts[i] : starts[i + 1]]] = 0
        for j in partners[both >= threshold * (lengths[i] + lengths[partners] - both)].tolist():
            linked[i] += rows[j][2]
            linked[j] += r[2]
            if (a := root(i)) != (b := root(j)):
                tree[max(a, b)] = min(a, b)
                edges.append((i, j))
    for i, j in edges:
        yield rows[i][1], rows[j][1], 0
    for i, n in enumerate(linked):
        if n:
            yield rows[i][1], rows[i][1], n


def by_group(df: DataFrame, order: list[str], keys: int, body: Callable[[list[tuple]], Iterator[tuple]], names: list[str], schema: str) -> DataFrame:
    """body() over the runs of rows that agree in the first columns, each run within one task; runs are bounded by tiles."""
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    types = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for rows in groups(batches, keys):
            held += body(rows)
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)

    return df.select(*names).repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def similar_documents(docs: DataFrame, threshold: float = 0.8, target_recall: float = 0.9999999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_links (documents linked directly) and class_id (the smallest id reachable by links)."""
    amount = math.ceil(-math.log(1 - target_recall)) / threshold
    least = np.array(least_shared(threshold, target_recall))
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [(k, len(t), sampled(t, amount)) for k, t in map(shingles, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.list_(pa.int64()))], names=["id", "key", "size", "pool"])

    members = checkpointed(own.mapInArrow(sketch, "id long, key binary, size long, pool array<long>"))
    classes = members.where("id is not null and size > 0").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("pool").alias("pool"))
    classes = checkpointed(classes.withColumn("class", F.monotonically_increasing_id()))

    def again(who: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What is made of the texts of some classes (with key and rep), with the class: one row for each."""
        texts = own.join(small(who.select(F.col("rep").alias("id")).distinct()), "id", "left_semi").select("text").mapInArrow(made, schema)
        return who.select("class", "key").join(texts.dropDuplicates(["key"]), "key").drop("key")

    def counted(placed: DataFrame) -> DataFrame:
        """(path, class, size) with the number of its classes and of all their shingles, for paths of two classes and more."""
        return placed.join(placed.groupBy("path").agg(F.count("*").alias("held"), F.sum("size").alias("weight")).where("held > 1"), "path")

    def crowds(large: DataFrame) -> DataFrame:
        """The large buckets of several runs as one for each set of classes that they connect, if that leaves fewer pairs."""
        ties = large.join(large.groupBy("path").agg(F.min("class").alias("to")), "path").select(F.col("class").alias("a"), F.col("to").alias("b"))
        named = large.select("class", "size").distinct().join(components(ties), F.col("class") == F.col("node"))
        whole = checkpointed(counted(named.select("class", "size", (-1 - F.col("component")).alias("path"))))
        one, several = (df.agg(F.sum("held")).first()[0] or 0 for df in (whole, large))
        return whole if one <= several else large

    def deeper(who: DataFrame, depth: int, runs: int) -> DataFrame:
        factors = hashes(runs, depth)

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 256):
                made = [(k, paths(t, factors)) for k, t in map(shingles, b.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=["key", "runs"])

        found = again(who, keys, "key binary, runs array<long>").select("class", F.explode(F.array_distinct("runs")).alias("path"))
        return checkpointed(counted(checkpointed(found.join(who.select("class", "size"), "class"))))  # both sides read the paths, which are made once

    first = counted(classes.select("class", "size", F.explode("pool").alias("path")))
    tokens = first.groupBy("class").agg(F.collect_list(F.when(F.col("held") <= BUCKET, F.struct("path", "held", "weight"))).alias("light"), F.count_if(F.col("held") > BUCKET).alias("heavy"))
    needed = F.greatest(F.lit(1), F.element_at(F.array(*map(F.lit, least.tolist())), F.least(F.size("pool") + 1, F.lit(len(least)))))
    at_hand = checkpointed(classes.join(tokens, "class").where((F.size("light") + F.col("heavy")) >= needed).select("class", "key", "rep", "size", "pool", "light", (F.col("heavy") >= needed).alias("dense")))
    columns_ = ["path", "class", "held", "weight"]
    placed = at_hand.select("class", F.explode("light").alias("of")).select("of.path", "class", "of.held", "of.weight")
    # Partners of a class that isn't dense share a shingle that few hold.
    crowd, depth, before, pairs = at_hand.where("dense").select("class", "key", "rep", "size"), 2, None, 0
    while crowd.limit(1).count():
        runs = splits(threshold, target_recall, depth)
        if before is not None:
            tried = deeper(crowd, depth, TRIED).where(F.col("held") > TILE).agg(F.sum("held")).first()[0] or 0
            if 2 * tried * runs / TRIED > pairs:
                placed = placed.unionByName(crowds(before).select(*columns_))
                break
        now = deeper(crowd, depth, runs)
        large = now.where(F.col("held") > TILE)
        left = large.agg(F.sum("held")).first()[0] or 0
        placed, before, pairs, depth = placed.unionByName(now.where(F.col("held") <= TILE).select(*columns_)), large, left, 2 * depth
        if splits(threshold, target_recall, depth) > MOST_RUNS:
            placed = placed.unionByName(crowds(large).select(*columns_))
            break
        crowd = checkpointed(crowd.join(large.select("class").distinct(), "class", "left_semi"))
    buckets = checkpointed(placed)
    mine = buckets.groupBy("class").agg(F.collect_list("path").alias("buckets"))
    placed = buckets.join(at_hand.select("class", "size", "pool").join(mine, "class"), "class")
    chunks = F.greatest(F.ceil(F.col("held") / TILE), F.ceil(F.col("weight") / TOKENS)).cast("int")
    placed = placed.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("class"), "chunks").cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1))
    placed = placed.withColumn("other", other).withColumns({"x": F.least("chunk", "other"), "y": F.greatest("chunk", "other")})
    blocks = by_group(placed, ["path", "x", "y"], 3, lambda rows: candidates(rows, amount, threshold, least), ["path", "x", "y", "chunk", "class", "size", "pool", "buckets"], "block long, class long, partners array<long>")
    blocks = checkpointed(blocks)

    asked = checkpointed(classes.join(blocks.select("class").distinct(), "class", "left_semi").select("class", "key", "rep"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            made = [shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=["key", "tokens"])

    whole = again(asked, sets, "key binary, tokens array<long>")
    rows = blocks.join(classes.select("class", "n"), "class").join(whole, "class")
    links = checkpointed(by_group(rows, ["block"], 1, lambda rows: compared(rows, threshold), ["block", "class", "n", "partners", "tokens"], "a long, b long, n long"))

    # Only classes with links belong to components; each of the others is one by itself.
    linked = links.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked")).join(components(links).withColumnRenamed("node", "class"), "class", "full")
    linked = checkpointed(classes.select("class", "rep").join(linked, "class").withColumn("component", F.coalesce("component", "class")))
    smallest = checkpointed(linked.groupBy("component").agg(F.min("rep").alias("class_id")))
    linked = linked.join(small(smallest), "component").select("class", "linked", "class_id")
    named = classes.select("class", "key", "rep", "n").join(linked, "class", "left")
    named = named.select(F.col("key").alias("of"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"))
    found = members.select("id", "key", "size").join(named, F.col("id").isNotNull() & (F.col("size") > 0) & (F.col("key") == F.col("of")), "left")
    return found.select(F.col("id").alias("doc_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which none with a smaller id is similar, directly or through others, with their own columns.

    Of several rows with the smallest id of a class, all stay; so do rows with a null id.
    """
    gone = checkpointed(similar_documents(docs.select("doc_id", "text")).where("class_id != doc_id").select(F.col("doc_id").alias("id that goes")).distinct())
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own id"))
    return own.join(small(gone), F.col("own id") == F.col("id that goes"), "left_anti").select("row.*")
