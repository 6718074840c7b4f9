"""Plans over logs: events stand for requests and host samples, users for services, types for stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusjobs.operators import metrics as M
from corpusjobs.operators import ordered
from corpusjobs.plans.registry import query, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_type, count(*) AS requests, count(*) FILTER (value < 80) AS passed, count(*) FILTER (value < 80) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6 AS rps, 1 - count(*) FILTER (value < 80) / count(*) AS error_rate,
quantile_cont(CASE WHEN value < 80 THEN value END, 0.5) AS p50, quantile_cont(CASE WHEN value < 80 THEN value END, 0.95) AS p95, quantile_cont(CASE WHEN value < 80 THEN value END, 0.99) AS p99, quantile_cont(value, 0.95) AS all_p95, max(value) AS slowest FROM events GROUP BY event_type""")
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return M.stage_latency(events(spark, sf_dir).withColumn("ok", F.col("value") < 80), ["event_type"], "value", "ok", wall)


@query("SELECT event_type, count(*) AS n, median(value) AS median, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS largest FROM events WHERE value IS NOT NULL GROUP BY event_type")
def nearest_rank_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distribution(events(spark, sf_dir), ["event_type"], "value")


@query("SELECT phase, count(v) AS n, median(v) AS median, quantile_disc(v, 0.95) AS p95, min(v) AS least, max(v) AS largest FROM (SELECT 'dns' AS phase, CASE WHEN event_type = 'click' THEN 0 ELSE value / 10 END AS v FROM events UNION ALL SELECT 'total', value FROM events UNION ALL SELECT 'rest', value - CASE WHEN event_type = 'click' THEN 0 ELSE value / 10 END FROM events) WHERE v IS NOT NULL GROUP BY phase")
def phase_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of phases; a direct request (here: click) without name look-up took 0 for it."""
    dns = F.when(F.col("event_type") == "click", 0.0).otherwise(F.col("value") / 10)
    wide = events(spark, sf_dir).select("event_id", dns.alias("dns"), F.col("value").alias("total"), (F.col("value") - dns).alias("rest"))
    return M.distribution(wide.unpivot("event_id", ["dns", "total", "rest"], "phase", "v"), ["phase"], "v")


@query("SELECT date_trunc('day', ts) AS day, count(*) AS samples, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, min(value) AS least_available, arg_max(event_id, ts) - arg_min(event_id, ts) AS grown, (arg_max(event_id, ts) - arg_min(event_id, ts)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS per_second FROM events GROUP BY 1")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return M.resource_summary(rows, ["day"], "ts", "value", "event_id")


@query("WITH stages AS (SELECT user_id AS stage, min(ts) AS started, min(ts) + INTERVAL 2 HOUR AS ended FROM events GROUP BY user_id) SELECT stage, count(*) AS samples, sum(value) AS total FROM events JOIN stages ON ts BETWEEN started AND ended GROUP BY stage")
def samples_in_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    stages = rows.groupBy(F.col("user_id").alias("stage")).agg(F.min("ts").alias("started")).withColumn("ended", F.expr("started + interval 2 hours"))
    return M.samples_in_stage(rows.select("ts", "value"), stages, "ts", "started", "ended").groupBy("stage").agg(F.count("*").alias("samples"), F.sum("value").alias("total"))


@query("SELECT event_id, coalesce((done - lag(done) OVER w) / greatest((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 1e-6), 0) AS done_rate, coalesce((failed - lag(failed) OVER w) / greatest((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 1e-6), 0) AS failed_rate FROM (SELECT event_id, user_id, ts, event_id AS done, event_id // 10 AS failed FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, done)")
def throughput_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", F.col("event_id").alias("done"), F.floor(F.col("event_id") / 10).alias("failed"))
    return M.throughput_deltas(rows, "user_id", "ts", "done", "failed").select("event_id", "done_rate", "failed_rate")


@query("SELECT event_id, CASE WHEN n = 32 THEN slow END AS slow_rate, CASE WHEN n = 32 THEN bad END AS bad_rate, CASE WHEN n = 32 THEN m END AS mean_seconds FROM (SELECT event_id, count(*) OVER w AS n, avg(CAST(value > 90 AS INTEGER)) OVER w AS slow, avg(CAST(event_type = 'error' AS INTEGER)) OVER w AS bad, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW))")
def rolling_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumns({"slow": (F.col("value") > 90).cast("int"), "bad": (F.col("event_type") == "error").cast("int")})
    return M.rolling_health(rows, "user_id", ["ts", "event_id"], "value", ["slow", "bad"]).select("event_id", "slow_rate", "bad_rate", "mean_seconds")


@query()
def minute_budget_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling budget of 3 a minute for each user; tested against a loop."""
    return M.minute_budget(events(spark, sf_dir), "user_id", "ts", "event_id", 3)


@query()
def token_bucket_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket of 2 that fills once in ten minutes, for each user; tested against a loop."""
    return M.token_bucket(events(spark, sf_dir), "user_id", "ts", "event_id", 1 / 600, 2)


@query("SELECT user_id % 5 AS region, event_type AS side, count(*) AS attempts, count(*) FILTER (value < 80) AS successes FROM events GROUP BY GROUPING SETS ((user_id % 5, event_type), (event_type))")
def http_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and successes by side, in each region and overall."""
    rows = events(spark, sf_dir).select((F.col("user_id") % 5).alias("region"), F.col("event_type").alias("side"), "value")
    return rows.groupingSets([[F.col("region"), F.col("side")], [F.col("side")]], F.col("region"), F.col("side")).agg(F.count("*").alias("attempts"), F.count_if(F.col("value") < 80).alias("successes"))


@query("SELECT event_type, sum(total) AS total, sum(received) AS received, sum(total) - sum(received) AS dropped, 100.0 * (sum(total) - sum(received)) / sum(total) AS failure_percent FROM (SELECT event_type, 16 AS total, CASE WHEN value > 90 THEN 12 ELSE 16 END AS received FROM events) GROUP BY event_type")
def tcp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", F.lit(16).alias("total"), F.when(F.col("value") > 90, 12).otherwise(16).alias("received"))
    sums = rows.groupBy("event_type").agg(F.sum("total").alias("total"), F.sum("received").alias("received"))
    return sums.withColumn("dropped", F.col("total") - F.col("received")).withColumn("failure_percent", F.try_divide(100.0 * F.col("dropped"), "total"))


@query("WITH n AS (SELECT user_id, median(CASE WHEN event_id % 2 = 0 THEN value END) AS direct, median(CASE WHEN event_id % 2 = 1 THEN value END) AS proxy, count(*) FILTER (event_id % 2 = 0 AND value < 95) AS a, count(*) FILTER (event_id % 2 = 1 AND value < 95) AS b FROM events GROUP BY user_id) SELECT user_id, direct - proxy AS difference, 100 * (direct - proxy) / proxy AS percent FROM n WHERE a >= 3 AND b >= 3")
def paired_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that did well on both sides: the difference of their medians, and as a share."""
    side = F.col("event_id") % 2
    kinds = {"direct": side == 0, "proxy": side == 1}
    rows = events(spark, sf_dir)
    well = rows.groupBy("user_id").agg(*[F.count_if(c & (F.col("value") < 95)).alias(f"{k}_well") for k, c in kinds.items()])
    medians = M.counted(rows, ["user_id"], "value", kinds, {k: [0.5] for k in kinds}).groupBy("user_id").agg(*[M.interpolated(k, 0.5).alias(f"{k}_median") for k in kinds])
    node = medians.join(well, "user_id")
    difference = F.col("direct_median") - F.col("proxy_median")
    return node.where("direct_well >= 3 and proxy_well >= 3").select("user_id", difference.alias("difference"), F.try_divide(100 * difference, F.col("proxy_median")).alias("percent"))


@query("SELECT 'missing' AS side, user_id FROM (SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'error') UNION ALL SELECT 'extra', user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase')")
def cohort_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that a cohort lacks of a baseline, and those it has beyond another."""
    rows = events(spark, sf_dir)
    some = lambda t: rows.where(F.col("event_type") == t).select("user_id").distinct()
    missing = rows.select("user_id").distinct().join(some("error"), "user_id", "left_anti").select(F.lit("missing").alias("side"), "user_id")
    return missing.unionAll(some("error").join(some("purchase"), "user_id", "left_anti").select(F.lit("extra"), "user_id"))


@query("SELECT event_type, count(*) AS n, min(value) AS least, median(value) AS median, max(value) AS largest FROM events WHERE event_id % 3 <> 0 GROUP BY event_type")
def score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, least, median and largest of each group's scored rows."""
    scored = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return M.distribution(events(spark, sf_dir).withColumn("score", scored), ["event_type"], "score").drop("p95")


@query("SELECT user_id, sum(1) AS requests, sum(CAST(event_type = 'error' AS INTEGER)) AS errors, sum(value) / 1000 AS cpu_ms, bool_or(value > 99) AS exceeded, greatest(0, 100 - count(*)) AS quota_left FROM events GROUP BY user_id")
def invocation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), (F.sum("value") / 1000).alias("cpu_ms"), F.bool_or(F.col("value") > 99).alias("exceeded"))
    return grouped.withColumn("quota_left", F.greatest(F.lit(0).cast("long"), 100 - F.col("requests")))


@query("SELECT user_id, CAST(sum(value) AS DOUBLE) * 0.35 / 1e6 AS cost FROM events WHERE event_type <> 'error' GROUP BY user_id")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type != 'error'").groupBy("user_id").agg((F.sum("value") * 0.35 / 1e6).alias("cost"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS requests, sum(value) AS total, max(value) AS slowest FROM events GROUP BY 1, 2")
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in tumbling windows of an hour; the streaming job has the same plan with a watermark."""
    from corpusjobs.streaming.jobs import windowed

    return windowed(events(spark, sf_dir), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT split_part(url, '/', 3) AS host, count(*) AS requests, count(*) FILTER (page_id % 5 <> 0) AS answered FROM pages GROUP BY 1")
def log_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes matched with the log lines of the origin by path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    log = pages.where("page_id % 5 != 0").groupBy("url", "page_id").agg(F.count("*").alias("lines"))
    return pages.join(log, ["url", "page_id"], "left").groupBy("host").agg(F.count("*").alias("requests"), F.count("lines").alias("answered"))


@query("SELECT host, path, status, count(*) AS n FROM (SELECT split_part(url, '/', 3) AS host, '/' || split_part(split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1), '/', 2) AS path, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status FROM pages) GROUP BY ALL")
def read_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log lines, written from pages and parsed by one pattern."""
    from corpusjobs.sources.files import parse_access_log

    path = F.concat(F.lit("/"), F.split_part(F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), F.lit("/"), F.lit(2)))
    line = F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(' - - [01/Jan/2024:00:00:00 +0000] "GET '), path, F.lit(' HTTP/2.0" '), F.when(F.col("page_id") % 5 == 0, "404").otherwise("200"), F.lit(" 12"))
    parsed = parse_access_log(table(spark, sf_dir, "pages").select(line.alias("value")))
    return parsed.groupBy(F.col("peer").alias("host"), "path", "status").agg(F.count("*").alias("n"))


@query("SELECT event_id, list_filter([CASE WHEN value > 95 THEN 'total_timing_missing' END, CASE WHEN event_type = 'error' THEN 'tls_not_authorized' END, CASE WHEN user_id % 7 = 0 THEN 'nonce_mismatch' END], lambda x: x IS NOT NULL) AS reasons FROM events")
def validate_http_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason against a probe's answer."""
    rules = [F.when(F.col("value") > 95, "total_timing_missing"), F.when(F.col("event_type") == "error", "tls_not_authorized"), F.when(F.col("user_id") % 7 == 0, "nonce_mismatch")]
    return events(spark, sf_dir).select("event_id", F.filter(F.array(*rules), lambda x: x.isNotNull()).alias("reasons"))


@query("SELECT source, count(*) AS points, sum(strlen(text)) AS bytes, max(strlen(text)) AS largest, count(*) FILTER (strlen(text) >= 20000) AS oversize FROM documents GROUP BY source")
def payload_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes, the largest row, and the rows over a limit."""
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("points"), F.sum(size).alias("bytes"), F.max(size).alias("largest"), F.count_if(size >= 20000).alias("oversize"))


@query("SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) >= 20000")
def oversize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).where("bytes >= 20000")


@query("""WITH RECURSIVE d AS (SELECT doc_id, strlen(text) AS bytes, row_number() OVER (ORDER BY doc_id) AS k FROM documents), g AS (SELECT k, bytes AS total, 1 AS n, 0 AS batch FROM d WHERE k = 1 UNION ALL SELECT d.k, CASE WHEN n = 128 OR total + bytes > 1048576 THEN bytes ELSE total + bytes END, CASE WHEN n = 128 OR total + bytes > 1048576 THEN 1 ELSE n + 1 END,
CASE WHEN n = 128 OR total + bytes > 1048576 THEN batch + 1 ELSE batch END FROM g JOIN d ON d.k = g.k + 1) SELECT doc_id, bytes, CAST(batch AS BIGINT) AS batch FROM g JOIN d USING (k)""")
def byte_bounded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 128 rows and 1 MiB in the order of ids."""
    return ordered.batches(table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")), "doc_id", "bytes")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 100 AND event_type = 'purchase'")
def translated_ids_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 100 ids of each table, in order."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return events(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 100 and event_type = 'purchase'").select("user_id", "event_id", "event_type")
