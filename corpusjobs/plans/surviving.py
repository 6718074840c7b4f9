"""Plans that write and read back: tables that are replaced, streams of points and of windows, each with a failure on its way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.plans import corpus
from corpusjobs.plans.corpus import SENTENCES
from corpusjobs.plans.measures import events
from corpusjobs.plans.registry import query, table
from corpusjobs.sources import versions
from corpusjobs.sources.shared import scratch
from corpusjobs.streaming import jobs


@query("SELECT doc_id, source AS dataset, sha256(text) AS hash, doc_id % 3 = 0 AS late FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source, NULL, NULL FROM documents WHERE doc_id % 2 = 1")
def write_dataset_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, replaced by rows of another shape, added to, and replaced once more by a job that fails: the failure changes nothing."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"), "text"), scratch(spark, "table")
    versions.replace_table(docs.select("doc_id", "dataset"), path)
    hashed = docs.where("doc_id % 2 = 0").select("doc_id", "dataset", F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 3 == 0).alias("late"))
    versions.replace_table(hashed, path, force=True)
    rest = docs.where("doc_id % 2 = 1").select("doc_id", "dataset", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("boolean").alias("late"))
    versions.write(rest, path, False, "dataset")
    try:
        versions.replace_table(docs.select("doc_id", "dataset", F.raise_error(F.lit("lost on the way")).cast("string").alias("hash")), path, force=True)
    except Exception as e:
        if "lost on the way" not in str(e):
            raise
    return versions.read_table(spark, path).select("doc_id", "dataset", "hash", "late")


def stream_files(rows: int) -> int:
    """Into how many files rows to stream are dealt: an even number, four at least, of about 10,000 rows each, so that a task's share doesn't grow with the table."""
    return max(4, 2 * -(-rows // 20_000))


@query(f"{SENTENCES} SELECT dataset, count(*) AS points, count(DISTINCT work_id) AS works, sum(CAST(('0x' || sha256(translation)[:8]) AS BIGINT)) AS hashes FROM found GROUP BY dataset")
def stream_index_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows streamed into a table of points, twice from the start: the second run finds every point there."""
    rows = corpus.rows(spark, sf_dir).withColumn("translation_status", F.lit("done"))
    place = scratch(spark, "stream")
    files = stream_files(rows.count())
    rows.repartition(files).write.parquet(f"{place}/rows")
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 2).parquet(f"{place}/rows")
        jobs.stream_points(stream, f"{place}/points", f"{place}/checkpoint {k}", "v1").awaitTermination()
    found = versions.read_table(spark, f"{place}/points")
    number = F.conv(F.left("translation_hash", F.lit(8)), 16, 10).cast("decimal(38,0)")
    return found.groupBy("dataset").agg(F.count("*").alias("points"), F.countDistinct("work_id").alias("works"), F.sum(number).cast("decimal(38,0)").alias("hashes"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS requests, sum(value) AS total, max(value) AS slowest FROM events WHERE event_type <> 'view' GROUP BY ALL), s AS (SELECT ts AS seen, user_id AS host, event_id AS available FROM events WHERE event_type = 'view'),
m AS (SELECT least((SELECT max(ts) FROM events WHERE event_type <> 'view'), (SELECT max(seen) FROM s)) - INTERVAL 10 SECOND AS mark) SELECT start, event_type, requests, round(total, 6) AS total, slowest, count(seen) AS samples, min(available) AS least_available FROM w CROSS JOIN m LEFT JOIN s ON seen >= start AND seen < start + INTERVAL 1 HOUR WHERE start + INTERVAL 1 HOUR <= mark GROUP BY ALL""")
def stream_stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of requests with the host samples in them, from two streams; views stand for samples. Windows that the watermark hasn't passed aren't told."""
    rows, place = events(spark, sf_dir), scratch(spark, "stream")
    kinds = {"requests": rows.where("event_type != 'view'").select("ts", "event_type", "value"), "samples": rows.where("event_type = 'view'").select(F.col("ts").alias("at"), F.col("user_id").alias("host"), F.col("event_id").alias("available"))}
    for name, df in kinds.items():
        df.write.parquet(f"{place}/{name}")
    stream = lambda name: spark.readStream.schema(kinds[name].schema).parquet(f"{place}/{name}")
    jobs.stream_stage_metrics(stream("requests"), stream("samples"), f"{place}/told", f"{place}/checkpoint", "1 hour", "10 seconds").awaitTermination()
    told = versions.read_table(spark, f"{place}/told").groupBy("start", "event_type", "requests", "total", "slowest")
    counted = told.agg(F.count("at").alias("samples"), F.min("available").alias("least_available"))
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "requests", F.round("total", 6).alias("total"), "slowest", "samples", "least_available")
