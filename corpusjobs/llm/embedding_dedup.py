"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table look-ups, exact rerank.

Equal vectors with equal labels are made one class first, so that a thousand copies cost one. A bounded
sample of the classes (`sample` in expectation, or 4 a cell where that is more) fits the coarse centroids, their number the
square root of the classes', and the codebooks of the residuals' subspaces; every class is indexed. For unit
vectors, a cosine of at least t means a distance of at most d = sqrt(2 - 2t). A class is listed under its
nearest centroid and probes every later list whose cell can hold a vector within d: those whose bisecting
plane to its own cell is no farther than d. So of two cells one side asks the other, for both. In a list, distances to
the coded vectors come from a table per query; a coded vector is looked at again if its distance is at most
d plus the length of what its code left out, and then its cosine is computed in double precision. Both
bounds are safe, so no pair is missed (recall 1, measured in the tests against brute force).

A list with more than `tile` entries or queries is cut into tiles of that size. A tile reports, for each
query, how many vectors it links to, and edges that keep what is linked connected; never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
id, link with nothing; their component is their own id. Vectors of different lengths don't link. Rows
with the same id are vectors of their own, but share a component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import checkpointed, small
from corpusjobs.llm.components import components

SLACK = 1e-6


@dataclass
class Quantiser:
    centroids: np.ndarray  # cells x dimensions
    books: list[np.ndarray]  # for each subspace: codewords x its dimensions
    cuts: list[slice]

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[1]

    def codes(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the lengths of what they leave out."""
        codes = np.stack([nearest(residuals[:, s], b)[0] for s, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        back = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((residuals - back) ** 2).sum(axis=1))


def closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, a few points at a time."""
    step = max(1, 16_000_000 // len(centres))
    return np.concatenate([nearest(points[k : k + step], centres)[0] for k in range(0, len(points), step)])


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and all squared distances."""
    d = np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1), 0)
    return d.argmin(axis=1), d


def k_means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    chosen = np.random.default_rng(7).choice(len(points), min(k, len(points)), replace=False)
    centres = points[chosen].copy()
    for _ in range(rounds):
        own = closest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def unit(rows: list[np.ndarray], dimensions: int) -> np.ndarray:
    """Rows as unit vectors, filled up with zeros; first scaled by the largest component, against overflow."""
    x = np.zeros((len(rows), dimensions))
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def fit(vectors: list[np.ndarray], cells: int, subspaces: int, codewords: int) -> Quantiser:
    x = unit(vectors, max(map(len, vectors)))
    centroids = k_means(x, cells)
    residuals = x - centroids[closest(x, centroids)]
    parts = [p for p in np.array_split(np.arange(x.shape[1]), subspaces) if len(p)]
    cuts = [slice(int(p[0]), int(p[-1]) + 1) for p in parts]
    return Quantiser(centroids, [k_means(residuals[:, s], min(codewords, 256)) for s in cuts], cuts)


def link(db: pd.DataFrame, queries: pd.DataFrame, q: Quantiser, threshold: float) -> pd.DataFrame:
    """Links of the queries to the entries of one list: a, b (classes), and n: with a = b how many vectors a links to here, else 0.

    Queries of other cells tell both sides' links; those of the list's own cell theirs, since all of them ask.
    """
    bound = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    x, y = unit(queries["vec"].tolist(), q.dimensions), unit(db["vec"].tolist(), q.dimensions)
    codes = np.stack([np.frombuffer(c, np.uint8) for c in db["code"]])
    reach, ids, sizes, asking = (bound + db["left_out"].to_numpy()) ** 2, db["class"].to_numpy(), db["n"].to_numpy(), queries["class"].to_numpy()
    weight, foreign, told = queries["n"].to_numpy(), ~queries["home"].to_numpy(bool), np.zeros(len(db), np.int64)
    tree: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := tree.get(c, c)) != c:
            tree[c] = tree.get(up, up)
            c = up
        return c

    out: list[tuple[int, int, int]] = []
    centre = q.centroids[int(db["cell"].iloc[0])]
    for at in range(0, len(x), 256):
        block = x[at : at + 256]
        residuals = block - centre
        far = np.zeros((len(block), len(y)))
        for k, (s, b) in enumerate(zip(q.cuts, q.books)):
            far += nearest(residuals[:, s], b)[1][:, codes[:, k]]
        rows, entries = np.nonzero(far <= reach + SLACK)
        good = (np.einsum("ij,ij->i", block[rows], y[entries]) >= threshold) & (asking[at + rows] != ids[entries])
        rows, entries = rows[good], entries[good]
        np.add.at(told, entries, weight[at + rows] * foreign[at + rows])
        for r in np.unique(rows):
            own, linked = int(asking[at + r]), entries[rows == r]
            out.append((own, own, int(sizes[linked].sum())))
            for c in ids[linked].tolist():
                if (a := root(own)) != (b := root(c)):
                    out.append((own, c, 0))
                    tree[max(a, b)] = min(a, b)
    out += [(int(ids[k]), int(ids[k]), int(told[k])) for k in np.flatnonzero(told)]
    return pd.DataFrame(out, columns=["a", "b", "n"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", sample: int = 16_384, subspaces: int = 8, codewords: int = 128, tile: int = 4_096) -> DataFrame:
    """A row for each vector: its id, n_links, component_id and kept, under the names of the contract."""
    spark = vectors.sparkSession
    if dict(vectors.dtypes)[embedding] not in ("array<float>", "array<double>"):  # singles stay singles on the way, and are doubles in all arithmetic
        vectors = vectors.withColumn(embedding, F.col(f"`{embedding}`").cast("array<double>"))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("vec"), F.col(f"`{label}`").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    valid = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    classes = checkpointed(rows.where(valid).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()))
    count = classes.count()
    if not count:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    cells = max(1, int(count**0.5))
    chance = F.pmod(F.xxhash64("rep", "label"), F.lit(1_000_000)) < 1_000_000 * min(1.0, max(sample, 4 * cells) / count)
    learnt = classes.where(chance).select("vec").toPandas()["vec"].tolist() or [classes.select("vec").first()[0]]
    longest = classes.agg(F.max(F.size("vec"))).first()[0]
    learnt[0] = np.concatenate([learnt[0], np.zeros(longest - len(learnt[0]))])
    quantiser = spark.sparkContext.broadcast(fit(learnt, cells, subspaces, codewords))
    bound = (2 - 2 * threshold) ** 0.5 + SLACK

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        step = max(1, min(1024, 2_000_000 // len(q.centroids)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                vecs = batch.column("vec").to_numpy(zero_copy_only=False)
                x = unit(list(vecs), q.dimensions)
                own, d = nearest(x, q.centroids)
                gaps = np.sqrt(nearest(q.centroids[own], q.centroids)[1])
                planes = (d - d[np.arange(len(x)), own][:, None]) <= 2 * bound * gaps + SLACK
                planes &= np.arange(len(q.centroids)) >= own[:, None]
                codes, left_out = q.codes(x - q.centroids[own])
                who, cell = np.nonzero(planes)
                home = cell == own[who]
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": batch.column("label").take(pa.array(who)), "dim": pa.array([len(v) for v in vecs], pa.int32()).take(pa.array(who)), "cell": pa.array(cell, pa.int32()), "home": pa.array(home),
                        "class": batch.column("class").take(pa.array(who)), "n": batch.column("n").take(pa.array(who)), "vec": batch.column("vec").take(pa.array(who)),
                        "code": pa.array([codes[k].tobytes() if h else None for k, h in zip(who, home)], pa.binary()), "left_out": pa.array(left_out[who], pa.float64()),
                    }
                )

    kind = dict(classes.dtypes)["label"]
    listed = classes.select("label", "vec", "class", "n").mapInArrow(assign, f"label {kind}, dim int, cell int, home boolean, class long, n long, vec {dict(classes.dtypes)['vec']}, code binary, left_out double")
    listed = checkpointed(listed)
    key = ["label", "dim", "cell"]
    sizes = listed.groupBy(*key).agg(F.ceil(F.count_if("home") / tile).cast("int").alias("h"), F.ceil(F.count("*") / tile).cast("int").alias("q")).where("h > 0")
    cut = listed.join(small(checkpointed(sizes)), key)
    spot = F.xxhash64("class")
    entries = cut.where("home").select(*key, F.pmod(spot, "h").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("y"), F.lit(True).alias("entry"), "home", "class", "n", "vec", "code", "left_out")
    queries = cut.select(*key, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("x"), F.pmod(F.xxhash64(spot), "q").cast("int").alias("y"), F.lit(False).alias("entry"), "home", "class", "n", "vec", F.lit(None).cast("binary").alias("code"), "left_out")

    def tile_links(part: pd.DataFrame) -> pd.DataFrame:
        db, asking = part[part["entry"]], part[~part["entry"]]
        return link(db, asking, quantiser.value, threshold) if len(db) and len(asking) else pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")

    links = checkpointed(entries.unionByName(queries).groupBy(*key, "x", "y").applyInPandas(tile_links, "a long, b long, n long"))
    own = classes.select("label", "vec", "class", "rep", "n").join(links.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked")), "class", "left").join(components(links).withColumnRenamed("node", "class"), "class", "left")
    own = checkpointed(own.select("label", "vec", "rep", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component")))
    # The smallest id of a component; classes that share their smallest id share a component.
    first = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = own.join(first, "component").select(F.col("label").alias("l"), F.col("vec").alias("v"), "n_links", "component_id")
    found = rows.join(named, valid & (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")), "left")
    component = F.coalesce("component_id", "id")
    return found.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
