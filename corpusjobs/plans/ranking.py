"""Plans over popularity counts and word frequencies; parts and customers stand for works, their numbers for engines' counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusjobs.functions import scalars as S
from corpusjobs.plans.registry import query, table


@query("SELECT p_partkey, engine, n FROM part UNPIVOT (n FOR engine IN (p_size, p_retailprice)) ".replace("FROM part", "FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part)"))
def split_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide counts to a row for each engine."""
    wide = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return wide.unpivot("p_partkey", ["p_size", "p_retailprice"], "engine", "n")


@query("SELECT p_partkey, p_size, rank FROM (SELECT p_partkey, p_brand, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC) AS rank FROM part)")
def popularity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.desc("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.dense_rank().over(w).cast("long").alias("rank"))


@query("SELECT n, count(*) AS times FROM (SELECT p_size AS n FROM part UNION ALL SELECT l_quantity FROM lineitem) WHERE n > 10 GROUP BY n HAVING count(*) > 1")
def suspicious_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers over a limit that are told more than once in either of two columns."""
    both = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("n")).unionAll(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double")))
    return both.where("n > 10").groupBy("n").agg(F.count("*").alias("times")).where("times > 1")


@query("SELECT p_partkey, p_size BETWEEN 0 AND 100 AS low_baidu, p_retailprice BETWEEN 0 AND 500 AS low_google FROM part")
def low_count_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts within the range in which an engine is asked again."""
    low = lambda column, engine: F.col(column).between(*S.LOW_COUNTS[engine])
    return table(spark, sf_dir, "part").select("p_partkey", low("p_size", "baidu").alias("low_baidu"), low("p_retailprice", "google").alias("low_google"))


WORDS = r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100"


@query(WORDS)
def frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent words of all texts, of letters of any script."""
    return counted(table(spark, sf_dir, "documents"), r"[^\p{L}]+")


@query(WORDS)
def frequency_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent words of all texts, of letters of any script."""
    return counted(table(spark, sf_dir, "documents"), r"[^\p{L}]+")


def counted(docs: DataFrame, apart: str) -> DataFrame:
    """The hundred most frequent words."""
    words = docs.select(F.explode(F.split(F.lower("text"), apart)).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@query("SELECT substr(text, i, 2) AS gram, count(*) AS n FROM (SELECT text, unnest(range(1, length(text))) AS i FROM benchmark) GROUP BY gram ORDER BY n DESC, gram LIMIT 50")
def frequency_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most frequent pairs of characters."""
    places = F.sequence(F.lit(1), F.length("text") - 1)
    grams = table(spark, sf_dir, "benchmark").where(F.length("text") > 1).select(F.explode(F.transform(places, lambda k: F.substring("text", k, F.lit(2)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(50)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id > 10 ORDER BY doc_id LIMIT 50")
def ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows after a key, in its order."""
    return table(spark, sf_dir, "documents").where("doc_id > 10").orderBy("doc_id").limit(50).select("doc_id", "n_chars")


@query("SELECT text_hash, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS text_hash, doc_id FROM documents) GROUP BY text_hash ORDER BY text_hash LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred distinct contents in the order of their hash: the same in every run."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id")
    return docs.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).orderBy("text_hash").limit(100)
