"""Vectors and search: normalisation, decoding, blocked exact search, approximate search, drift, rerank."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusjobs.functions import scalars as S
from corpusjobs.sources.shared import scratch

#: A UUID in its canonical form.
UUID = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
#: Queries and points that meet in one task at once.
QUERY_BLOCK, POINT_BLOCK = 4_096, 32_768
#: Of these, so many are scored at once: a tile of scores has 8 MB, however large the blocks are.
QUERY_TILE, POINT_TILE = 256, 4_096
#: Queries that approximate search also searches exactly, to learn how many cells it must look into.
MEASURED = 512


def vector_reason(vector: Column, dimensions: int | None = None) -> Column:
    """Why a vector can't be normalised, or null."""
    wrong = F.size(vector) != dimensions if dimensions else F.size(vector) == 0
    return (
        F.when(vector.isNull() | wrong, "dimension")
        .when(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(F.forall(vector, lambda x: x == 0), "zero")
    )


def point_reason(point_id: Column, vector: Column, dimensions: int, dataset: Column, row: Column, work: Column) -> Column:
    """The first reason against a stored point, or null: its id, its vector, its dataset and row, or a work of another dataset or of a later row."""
    of = S.parse_work_id(work)
    agrees = (of["dataset"] == dataset) & (of["row"] <= row)
    return F.coalesce(
        F.when(~F.coalesce(point_id.rlike(UUID), F.lit(False)), "id"),
        vector_reason(vector, dimensions),
        F.when(~F.coalesce((S.trim_all(dataset) != "") & (row > 0), F.lit(False)), "payload"),
        F.when(~F.coalesce(agrees, F.lit(False)), "work id"),
    )


def normalize_vector(vector: Column, dimensions: int | None = None) -> Column:
    """The unit vector in float32, scaled by its largest component first; null where there is a reason against it; never -0."""
    numbers = vector.cast("array<double>")
    scaled = S.let(F.struct(numbers.alias("v"), F.array_max(F.transform(numbers, F.abs)).alias("most")), lambda p: F.transform(p["v"], lambda x: x / p["most"]))
    with_norm = S.let(scaled, lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    one = S.let(with_norm, lambda p: F.transform(p["v"], lambda x: (x / p["n"] + F.lit(0.0)).cast("float")))
    return F.when(vector_reason(vector, dimensions).isNull(), one)


@F.pandas_udf(T.BinaryType())
def float_bytes(vectors: pd.Series) -> pd.Series:
    """Components as little-endian float32."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def decode_base64_vectors(text: pd.Series) -> pd.Series:
    import base64

    def one(t: str | None) -> np.ndarray | None:
        if t is None:
            return None
        raw = base64.b64decode(t)
        return np.frombuffer(raw, "<f4") if len(raw) % 4 == 0 else None

    return text.map(one)


decode_base64_vector = F.pandas_udf(decode_base64_vectors, T.ArrayType(T.FloatType()))


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equally many numbers as rows of doubles, without an object for each."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.unique(pc.list_value_length(lists))
    if len(sizes) != 1:
        raise ValueError(f"vectors of several dimensions: {sizes.to_pylist()}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def first_k(scores: np.ndarray, ids: np.ndarray, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row with their ids, highest first, ties by id; scores count as rounded to so many digits."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] - (0 if digits is None else 10.0**-digits)
        rows, columns = np.nonzero(scores >= least[:, None])
    else:
        rows, columns = (x.ravel() for x in np.indices(scores.shape))
    found, named = scores[rows, columns], ids[rows, columns]
    found = found if digits is None else np.round(found, digits)
    order = np.lexsort((named, -found, rows))
    rows = rows[order]
    kept = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
    return found[kept].reshape(len(scores), -1), named[kept].reshape(len(scores), -1)


def best_of_blocks(k: int, digits: int | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block of queries and a block of points (id, vector): the k points nearest to each query, by tiles of QUERY_TILE queries and POINT_TILE points."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return out.empty_table()

        def unit(t: pa.Table) -> np.ndarray:
            x = matrix(t.column("vec"))
            return x / np.sqrt((x**2).sum(axis=1, keepdims=True))

        q, ids = unit(asked), asked.column("own").to_numpy()
        starts = range(0, len(q), QUERY_TILE)
        best = [(np.empty((len(q[at : at + QUERY_TILE]), 0)), np.empty((len(q[at : at + QUERY_TILE]), 0), np.int64)) for at in starts]
        for low in range(0, held.num_rows, POINT_TILE):
            part = held.slice(low, POINT_TILE)
            x, names = unit(part).T, part.column("own").to_numpy()
            for j, at in enumerate(starts):
                scores = q[at : at + QUERY_TILE] @ x
                s, i = first_k(scores, np.broadcast_to(names, scores.shape), k, digits)
                best[j] = first_k(np.concatenate([best[j][0], s], axis=1), np.concatenate([best[j][1], i], axis=1), k, digits)
        best_s, best_i = (np.concatenate([b[c] for b in best]) for c in (0, 1))
        return pa.Table.from_arrays([pa.array(np.repeat(ids, best_s.shape[1])), pa.array(best_i.ravel()), pa.array(best_s.ravel())], schema=out)

    return run


def top_k(points: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", scope: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """(query_id, id, score, place): the k points of highest cosine for each query, ties by id, of those that agree with it in the columns of `scope`.

    Points and queries are dealt into blocks, scope by scope, and each block of queries meets each block of points of its scope
    by one shuffle on their numbers. A meeting keeps k points for a query. So there is one scan of either side and one job, however many queries
    there are, and a task holds two blocks and one tile of scores. With `digits`, points rank by their rounded scores, so that ids and not
    the last bits of a sum order the copies of a vector. Points or queries that can't be normalised, and those with a null in their scope, are left out.
    """

    of = {f"scope {k}": F.col(c).alias(f"scope {k}") for k, c in enumerate(scope)} | {"all": F.lit(0).alias("all")}

    def dealt(df: DataFrame, own: str, rows: int, name: str) -> tuple[DataFrame, DataFrame]:
        """The usable rows, and into how many blocks those of each scope are cut."""
        usable = df.where(vector_reason(F.col(vector)).isNull()).select(F.col(own).cast("long").alias("own"), F.col(vector).alias("vec"), *of.values())
        return usable, usable.groupBy(*of).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    held, parts = dealt(points, id_, POINT_BLOCK, "parts")
    asked, blocks = dealt(queries, query_id, QUERY_BLOCK, "blocks")
    sizes = parts.join(blocks, [*of])  # a row for each scope that both sides have
    number = lambda c: F.pmod(F.xxhash64("own"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keys = [*of, "block", "part"]
    left = asked.join(sizes, [*of]).withColumns({"block": number("blocks"), "part": every("parts")}).select("own", "vec", *keys)
    right = held.join(sizes, [*of]).withColumns({"part": number("parts"), "block": every("blocks")}).select("own", "vec", *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_of_blocks(k, digits), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rerank(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], query: str = "query", text: str = "text") -> DataFrame:
    """For each query the candidate with the highest text score; without any, the first; the vector's score stays.

    Candidates without text don't count.
    """
    score = F.pandas_udf(scorer, T.DoubleType())
    scored = candidates.where(F.col(text).isNotNull()).withColumn("text_score", score(query, text))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("text_score"), "place")
    return scored.withColumn("choice", F.row_number().over(w)).where("choice = 1").drop("choice")


def vector_drift(a: Column, b: Column) -> Column:
    """(max_delta, cosine, candidate): the largest component difference, the cosine, and whether normalisation explains it."""
    delta = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    cosine = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.struct(delta.alias("max_delta"), cosine.alias("cosine"), ((delta > 0) & (F.abs(cosine - 1) < 1e-6)).alias("candidate"))


def ann_top_k(points: DataFrame, queries: DataFrame, k: int, recall: float = 0.95, others: bool = False, cells: int | None = None, probes: int | None = None, id_: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", digits: int | None = None) -> DataFrame:
    """(query_id, id, score, place) as top_k(), looking only into the cells nearest to each query.

    There are about as many cells as the root of the count of points; their centres come from a bounded
    sample of 64 points a cell (8,192 at least, in expectation); every point is listed. Where the caller gives no probes,
    about MEASURED queries are searched exactly too, and as many cells are looked into as hold the share
    `recall` of what these find besides themselves. others leaves out the point of the query's own id.
    """
    unit = lambda df, i, name: df.select(F.col(i).cast("long").alias(name), normalize_vector(F.col(vector)).alias("v")).where("v is not null")
    spark = points.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        place = scratch(spark, "vectors")
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    listed, asked = kept(unit(points, id_, "id")), kept(unit(queries, query_id, "query_id"))
    n = listed.count()
    if not n:
        return asked.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("place")).limit(0)
    cells = cells or max(1, round(n**0.5))
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, max(8_192, 64 * cells) / n)
    seen = np.stack((listed.where(chance).toPandas()["v"].to_list() or [listed.first()["v"]])).astype(np.float64)
    centres = seen[np.random.default_rng(3).choice(len(seen), min(cells, len(seen)), replace=False)]
    for _ in range(6):
        own = np.concatenate([(seen[at : at + 4096] @ centres.T).argmax(axis=1) for at in range(0, len(seen), 4096)])
        centres = np.stack([seen[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    sent = spark.sparkContext.broadcast(centres)

    def nearest(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            m = min(most, len(c))
            for whole in batches:
                for low in range(0, whole.num_rows, 2048):
                    b = whole.slice(low, 2048)
                    near = matrix(b.column(1)) @ c.T
                    order = near.argmax(axis=1)[:, None] if m == 1 else first_k(near, np.broadcast_to(np.arange(len(c)), near.shape), m)[1]
                    at = pa.array(np.repeat(np.arange(b.num_rows), m))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(order.ravel(), pa.int32())], names=["i", "v", "cell"])

        return run

    kind = "i long, v array<float>, cell int"
    homes = kept(listed.mapInArrow(nearest(1), kind))
    if not probes:
        probes = measured_probes(listed, asked, homes, centres, k, recall)
    probing = asked.mapInArrow(nearest(probes), kind)

    def dealt(df: DataFrame, rows: int, name: str) -> DataFrame:
        """df with the number of its part of a cell, parts having about so many rows, and how many parts the cell has."""
        parts = df.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(f"{name}s"))
        return df.join(F.broadcast(parts), "cell").withColumn(name, F.pmod(F.xxhash64("i"), F.col(f"{name}s")).cast("int"))

    def spread(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        """df once for each part that the other side has of its cell."""
        parts = other.select("cell", f"{name}s").distinct()
        return df.join(F.broadcast(parts), "cell").withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)))

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not ours.num_rows or not theirs.num_rows:
            return out.empty_table()
        q, x = (matrix(t.column("v")) for t in (ours, theirs))
        asking, ids = ours.column("i").to_numpy(), theirs.column("i").to_numpy()
        scores = q @ x.T
        if others:
            scores[asking[:, None] == ids[None, :]] = -np.inf
        score, named = first_k(scores, np.broadcast_to(ids, scores.shape), k, digits)
        use = score.ravel() > -np.inf
        return pa.Table.from_arrays([pa.array(c[use]) for c in (np.repeat(asking, score.shape[1]), named.ravel(), score.ravel())], schema=out)

    p, q = dealt(homes, 2048, "block"), dealt(probing, 512, "part")
    keys = ["cell", "block", "part"]
    left, right = spread(q.drop("parts"), p, "block"), spread(p.drop("blocks"), q, "part")
    scored = left.select("i", "v", *keys).groupBy(*keys).cogroup(right.select("i", "v", *keys).groupBy(*keys)).applyInArrow(best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def measured_probes(listed: DataFrame, asked: DataFrame, homes: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
    """How many cells nearest to a query hold the share `recall` of its k nearest other points, measured exactly on about MEASURED queries."""
    n = asked.count()
    some = asked.where(F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(1_000_000)) < 1_000_000 * min(1.0, MEASURED / max(n, 1)))
    exact = top_k(listed, some, k + 1, "id", "v").where("id != query_id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("place") <= k)
    rows = exact.select("query_id", "id").join(homes.select(F.col("i").alias("id"), "cell"), "id").join(some, "query_id").select("v", "cell").toPandas()
    if not len(rows):
        return len(centres)
    scores = np.stack(rows["v"].to_list()).astype(np.float64) @ centres.T
    places = (scores > np.take_along_axis(scores, rows["cell"].to_numpy()[:, None].astype(int), 1)).sum(axis=1)
    return int(np.sort(places)[math.ceil(recall * len(places)) - 1]) + 1


def batch_order(rows: DataFrame, batch: str, index: str, size: str) -> DataFrame:
    """(batch, reason) of returned batches: an index out of range, twice, or missing; null where all are there once."""
    g = rows.groupBy(batch).agg(F.count("*").alias("n"), F.countDistinct(index).alias("distinct"), F.min(index).alias("low"), F.max(index).alias("high"), F.max(size).alias("size"))
    return g.select(batch, F.when((F.col("low") < 0) | (F.col("high") >= F.col("size")), "out of range").when(F.col("distinct") < F.col("n"), "twice").when(F.col("n") < F.col("size"), "missing").alias("reason"))
