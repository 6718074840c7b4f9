"""Structured Streaming jobs; each shares its transformation with the batch plan of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusjobs.functions import scalars as S
from corpusjobs.operators import corpus as C
from corpusjobs.sources import versions


def windowed(rows: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, requests, total, slowest) in tumbling windows; with a watermark on streams."""
    rows = rows.withWatermark("ts", late) if late else rows
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("requests"), F.sum("value").alias("total"), F.max("value").alias("slowest"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "requests", "total", "slowest")


def index_points(rows: DataFrame, generation: str) -> DataFrame:
    """Points of done rows: id, dataset, work and the hash of what was translated."""
    found = C.sentences(C.aligned(rows.where("translation_status = 'done'")))
    name = F.concat_ws(":", F.lit(generation), "dataset", F.col("source_row_id").cast("string"), F.col("raw_index").cast("string"), F.col("normalized_index").cast("string"))
    return found.select(S.point_id(S.POINT_NAMESPACE, name).alias("point_id"), F.lit(generation).alias("generation"), "dataset", "work_id", S.text_hash(F.col("translation")).alias("translation_hash"))


def upsert(new: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds the points whose id the table lacks, all or none of them; a batch whose id has been committed adds nothing.

    The table is partitioned by the first two digits of the id, and a batch reads only the partitions it has ids of. Files
    of a batch that failed stay unread, since readers follow the table's log (see sources.versions).
    """
    spark = new.sparkSession
    if batch is not None and versions.has_batch(spark, path, batch):
        return
    new = new.dropDuplicates(["point_id"]).withColumn("prefix", F.concat(F.lit("p"), F.left("point_id", F.lit(2))))
    if versions.entries(spark, path):
        asked = [r["prefix"] for r in new.select("prefix").distinct().collect()]  # 256 at most
        known = versions.read_table(spark, path).where(F.col("prefix").isin(asked)).select("prefix", "point_id")
        new = new.join(known, ["prefix", "point_id"], "left_anti")
    versions.write(new.repartition("prefix"), path, False, "prefix", batch)


def stream_points(rows: DataFrame, path: str, checkpoint: str, generation: str) -> StreamingQuery:
    """Indexes rows as they come; resumes from its checkpoint."""
    return index_points(rows, generation).writeStream.foreachBatch(lambda df, k: upsert(df, path, f"{generation}:{k}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_samples(requests: DataFrame, samples: DataFrame, width: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """(start, event_type, requests, total, slowest, at, host, available): each closed window of requests with the host samples in it.

    An interval join of two streams, with a watermark on either side: a sample belongs to the windows that hold its time,
    one before the end of a window by a microsecond at most. A window without samples gives a row of nulls when both watermarks are past it.
    Rows that come later than the watermark are dropped by Spark.
    """
    held = requests.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("requests"), F.sum("value").alias("total"), F.max("value").alias("slowest"))
    held = held.select(F.col("w.start").alias("start"), F.window_time("w").alias("last"), "event_type", "requests", "total", "slowest")
    seen = samples.withWatermark("at", late).select("at", F.window("at", width).alias("v"), "host", "available")
    within = (F.col("start") == F.col("v.start")) & F.expr(f"at > last - interval {width} and at <= last")
    return held.join(seen, within, "left_outer").select("start", "event_type", "requests", "total", "slowest", "at", "host", "available")


def stream_stage_metrics(requests: DataFrame, samples: DataFrame, path: str, checkpoint: str, width: str = "60 seconds", late: str = "10 seconds") -> StreamingQuery:
    """Closed windows of requests with the host samples beside them, added to a table batch by batch, each batch once."""

    def add(df: DataFrame, k: int) -> None:
        if not versions.has_batch(df.sparkSession, path, str(k)):
            versions.write(df, path, False, None, str(k))

    return stage_samples(requests, samples, width, late).writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
