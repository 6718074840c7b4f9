"""Plans over vectors. Embeddings are the points, those with small ids also the queries, labels the datasets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusjobs.functions import scalars as S
from corpusjobs.operators import calls
from corpusjobs.operators import search as V
from corpusjobs.plans.registry import query, table
from corpusjobs.sources.shared import scratch

#: Cosines of the queries (ids divisible by 20) with all points, in SQL.
SCORES = "scores AS (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score, q.label = p.label AS same FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = 0)"

#: Scores rank as the SQL rounds them.
DIGITS = 6


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {SCORES} SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM scores) WHERE k = 1")
def vector_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(points(spark, sf_dir), asked(spark, sf_dir), 1, digits=DIGITS).select("query_id", "id", F.round("score", 6).alias("score"))


@query("SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = 0 AND q.label = p.label AND p.vec_id % 2 = CASE WHEN q.vec_id % 40 = 0 THEN 1 ELSE 0 END)) WHERE k <= 3")
def vector_top_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hits of each query among the points of its dataset (the label) and of the generation it asks for; half of the queries ask for each of two."""
    generation = lambda odd: F.when(odd, "v1").otherwise("v2").alias("generation")
    held = points(spark, sf_dir).select("vec_id", "embedding", F.col("label").alias("dataset"), generation(F.col("vec_id") % 2 == 1))
    asking = points(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("dataset"), generation(F.col("vec_id") % 40 == 0))
    return V.top_k(held, asking, 3, scope=("generation", "dataset"), digits=DIGITS).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {SCORES} SELECT query_id, max(score) AS score, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM scores) WHERE k <= 5 GROUP BY query_id")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.top_k(points(spark, sf_dir), asked(spark, sf_dir), 5, digits=DIGITS)
    return found.groupBy("query_id").agg(F.max(F.round("score", 6)).alias("score"), F.count("*").alias("n"))


@query(f"WITH {SCORES}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM scores) SELECT query_id, arg_min(id, (label_key, k)) AS id FROM (SELECT t.query_id, t.id, t.k, -CAST(e.label AS INTEGER) AS label_key FROM top t JOIN embeddings e ON e.vec_id = t.id WHERE t.k <= 5) GROUP BY query_id")
def vector_topk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five candidates the one that a text scorer likes best (here: the highest label), then the nearest."""

    def scorer(q: pd.Series, text: pd.Series) -> pd.Series:
        return text.astype("float64")

    found = V.top_k(points(spark, sf_dir), asked(spark, sf_dir), 5, digits=DIGITS)
    texts = points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text"))
    named = found.join(texts, "id").withColumn("query", F.col("query_id").cast("string"))
    return V.rerank(named, scorer).select("query_id", "id")


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS norm, len(v) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)")
def normalize_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = points(spark, sf_dir).select("vec_id", V.normalize_vector(F.col("embedding"), 64).alias("v"))
    return unit.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("norm"), F.size("v").cast("long").alias("n"))


@query("SELECT vec_id, len(embedding) * 4 AS bytes, CASE WHEN len(embedding) = 64 THEN true END AS whole FROM embeddings")
def decode_base64_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as base64 of float32 and read back."""
    coded = points(spark, sf_dir).select("vec_id", "embedding", V.float_bytes("embedding").alias("raw"))
    back = coded.withColumn("v", V.decode_base64_vector(F.base64("raw")))
    return back.select("vec_id", F.length("raw").cast("long").alias("bytes"), F.when((F.col("v") == F.col("embedding")) & (F.size("v") == 64), True).alias("whole"))


@query("SELECT label, count(*) AS n, count(*) FILTER (vec_id % 3 = 0) AS changed, max(CASE WHEN vec_id % 3 = 0 THEN list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) ELSE 0 END) AS max_delta FROM embeddings GROUP BY label")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that a copy changed; here every third was scaled, which normalisation explains."""
    scaled = F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: (x * 2).cast("float"))).otherwise(F.col("embedding"))
    drift = points(spark, sf_dir).select("label", V.vector_drift(F.col("embedding"), scaled).alias("d"))
    return drift.groupBy("label").agg(F.count("*").alias("n"), F.count_if((F.col("d.max_delta") > 1e-6) & F.col("d.candidate")).alias("changed"), F.max("d.max_delta").alias("max_delta"))


@query("SELECT label, count(*) AS n, round(avg(list_cosine_similarity(a, b)), 6) AS cosine, max(list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])))) AS max_delta FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS a, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE vec_id % 4 WHEN 1 THEN -1 WHEN 2 THEN 2 ELSE 1 END) AS b FROM embeddings) GROUP BY label")
def embedding_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two embeddings of the same thing, joined by id: mean cosine and the largest difference of a component.

    Of the second's vectors every fourth is turned round and another fourth doubled.
    """
    k = F.col("vec_id") % 4
    by = F.when(k == 1, -1).when(k == 2, 2).otherwise(1)
    a, b = points(spark, sf_dir), points(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: (x * by).cast("float")).alias("other"))
    drift = a.join(b, "vec_id").select("label", V.vector_drift(F.col("embedding"), F.col("other")).alias("d"))
    return drift.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("d.cosine"), 6).alias("cosine"), F.max("d.max_delta").alias("max_delta"))


@query(f"WITH {SCORES}, one AS (SELECT query_id, arg_min(id, (-score, id)) AS a, max(score) AS s FROM scores GROUP BY 1), two AS (SELECT query_id, arg_min(id, (-score, id)) AS b, max(score) AS t FROM scores WHERE id % 40 <> 0 GROUP BY 1) SELECT count(*) AS queries, count(*) FILTER (a <> b) AS changed, count(*) FILTER (a <> b AND s - t < 1e-6) AS tied FROM one JOIN two USING (query_id)")
def search_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits of two indexes compared, and how many of the changed ones are as near as before.

    The second index has every vector scaled, which a cosine doesn't see, and has lost every 40th.
    """
    hits = lambda df, id_, score: V.top_k(df, asked(spark, sf_dir), 1, digits=DIGITS).select("query_id", F.col("id").alias(id_), F.round("score", 6).alias(score))
    scaled = points(spark, sf_dir).where("vec_id % 40 != 0").withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float")))
    changed = F.col("a") != F.col("b")
    return hits(points(spark, sf_dir), "a", "s").join(hits(scaled, "b", "t"), "query_id").agg(F.count("*").alias("queries"), F.count_if(changed).alias("changed"), F.count_if(changed & (F.col("s") - F.col("t") < 1e-6)).alias("tied"))


@query("SELECT doc_id, CASE WHEN length(text) % 97 <> 0 AND length(text) % 89 <> 0 THEN length(text) END AS n, CASE WHEN length(text) % 97 = 0 THEN 'CallError: HTTP 400' WHEN length(text) % 89 = 0 THEN 'CallError: HTTP 503' END AS embed_error FROM documents")
def embed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's embedder over distinct texts; here it gives their length, and fails by rule: some texts for good, some to the last attempt, some once."""

    def embedder(requests: list[tuple[str, int, str, str | None]]) -> list[list[float]]:
        sizes = [len(r[2]) for r in requests]
        if any(n % 97 == 0 for n in sizes):
            raise calls.CallError("HTTP 400", 400)
        if any(n % 89 == 0 or n % 83 == 0 and r[1] == 0 for n, r in zip(sizes, requests)):
            raise calls.CallError("HTTP 503", 503)
        return [[float(n)] for n in sizes]

    found = calls.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), embedder, "text", 1, scratch(spark, "calls"), wait=lambda s: None)
    return found.select("doc_id", F.get("embedding", F.lit(0)).cast("long").alias("n"), "embed_error")


@query("SELECT label, CASE vec_id % 7 WHEN 0 THEN 'dimension' WHEN 1 THEN 'not finite' WHEN 2 THEN 'zero' WHEN 3 THEN 'id' WHEN 4 THEN 'payload' WHEN 5 THEN 'work id' END AS reason, count(*) AS n FROM embeddings GROUP BY ALL")
def validate_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points counted by label and the reason against them; of seven points six have a fault put into them, each another."""
    k, i = F.col("vec_id") % 7, F.col("vec_id") + 1
    name = F.concat(F.lit("v1:"), i.cast("string"))
    id_ = S.point_id(S.POINT_NAMESPACE, name)
    vector = F.when(k == 0, F.slice("embedding", 2, 63)).when(k == 1, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).when(k == 2, F.transform("embedding", lambda x: F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    rows = points(spark, sf_dir).select("label", F.when(k == 3, F.concat(id_, F.lit("0"))).otherwise(id_).alias("id"), vector.alias("v"), F.when(k == 4, -i).otherwise(i).alias("row"), S.work_id(F.when(k == 5, "other").otherwise("vectors"), i).alias("work"))
    reason = V.point_reason(F.col("id"), F.col("v"), 64, F.lit("vectors"), F.col("row"), F.col("work"))
    return rows.groupBy("label", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORES}, one AS (SELECT query_id, arg_min(id, (-score, id)) AS a FROM scores GROUP BY 1) SELECT count(*) AS queries, avg(CASE WHEN a % 40 <> 0 THEN 1.0 ELSE 0.0 END) AS recall FROM one")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the approximate search finds the exact first hit; its index has lost every 40th vector."""
    exact = V.top_k(points(spark, sf_dir), asked(spark, sf_dir), 1, digits=DIGITS).select("query_id", F.col("id").alias("a"))
    near = V.ann_top_k(points(spark, sf_dir).where("vec_id % 40 != 0"), asked(spark, sf_dir), 1, digits=DIGITS).select("query_id", F.col("id").alias("b"))
    return exact.join(near, "query_id", "left").agg(F.count("*").alias("queries"), F.avg((F.col("a") == F.coalesce("b", F.lit(-1))).cast("double")).alias("recall"))


def others(found: DataFrame, k: int) -> DataFrame:
    """Of k + 1 hits the first k that aren't the query's own id."""
    w = Window.partitionBy("query_id").orderBy("place")
    return found.where("id != query_id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


@query()
def ann_recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the ten nearest other points, by exact search, that the approximate search finds."""
    exact = others(V.top_k(points(spark, sf_dir), asked(spark, sf_dir), 11, digits=DIGITS), 10).select("query_id", "id")
    near = V.ann_top_k(points(spark, sf_dir), asked(spark, sf_dir), 10, others=True, digits=DIGITS).select("query_id", "id", F.lit(1.0).alias("hit"))
    return exact.join(near, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


@query()
def search_parity_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other points in two indexes, of which the second has every vector scaled."""
    hits = lambda df: others(V.top_k(df, asked(spark, sf_dir), 11, digits=DIGITS), 10).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "id")))["id"].alias("ids"))
    scaled = points(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float")))
    one, two = hits(points(spark, sf_dir)), hits(scaled).withColumnRenamed("ids", "other")
    return one.join(two, "query_id", "full_outer").agg(F.count("*").alias("queries"), F.count_if(~F.col("ids").eqNullSafe(F.col("other"))).alias("changed"))


@query("SELECT l_orderkey, CASE WHEN max(l_linenumber) > 6 THEN 'out of range' WHEN count(DISTINCT l_linenumber) < count(*) THEN 'twice' WHEN count(*) < 6 THEN 'missing' END AS reason FROM lineitem GROUP BY l_orderkey")
def restore_batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of six, their lines as what came back."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("at"), F.lit(6).alias("size"))
    return V.batch_order(lines, "l_orderkey", "at", "size")
