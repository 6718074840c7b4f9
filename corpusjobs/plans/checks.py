"""Plans over probes and locators, with faults put into a copy of their tables, which plan and SQL must both find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.operators import probes as P
from corpusjobs.plans import corpus
from corpusjobs.plans.corpus import SENTENCES
from corpusjobs.plans.measures import events
from corpusjobs.plans.registry import query, table
from corpusjobs.sources import files


@query("""WITH p AS (SELECT event_type, '/page/' || user_id || '?nonce=' || md5(CAST(event_id AS VARCHAR)) AS path, event_id % 5 <> 0 OR event_id % 35 = 0 AS ok, event_id FROM events), l AS (SELECT path, CASE WHEN event_id % 5 = 0 THEN 503 ELSE 200 END AS status FROM p WHERE event_id % 9 <> 0 UNION ALL SELECT path, 304 FROM p WHERE event_id % 11 = 0),
g AS (SELECT path, count(*) AS lines, count(*) FILTER (status = 200) AS good FROM l GROUP BY path) SELECT event_type, count(*) AS probes, count(*) FILTER (good > 0) AS answered, count(*) FILTER (lines IS NULL) AS unanswered, CAST(coalesce(sum(lines), 0) AS BIGINT) AS logged, CAST(coalesce(sum(good), 0) AS BIGINT) AS logged_200, coalesce(sum(good), 0) = count(*) FILTER (ok) AS agree FROM p LEFT JOIN g USING (path) GROUP BY event_type""")
def log_correlate_nonce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes with a nonce in their path against the lines of an access log; some have no line, some two, some another status than they say."""
    rows = events(spark, sf_dir)
    i = F.col("event_id")
    path = F.concat(F.lit("/page/"), F.col("user_id").cast("string"), F.lit("?nonce="), F.md5(i.cast("string")))
    probes = rows.select("event_type", "event_id", path.alias("path"), ((i % 5 != 0) | (i % 35 == 0)).alias("ok"))
    line = lambda status: F.concat(F.lit('10.0.0.1 - - [01/Jan/2026:00:00:00 +0000] "GET '), "path", F.lit(' HTTP/1.1" '), status, F.lit(" 12")).alias("value")
    lines = probes.where(i % 9 != 0).select(line(F.when(i % 5 == 0, "503").otherwise("200"))).unionAll(probes.where(i % 11 == 0).select(line(F.lit("304"))))
    return P.correlate(probes, files.parse_access_log(lines), ["event_type"])


HTTP = "h AS (SELECT unnest(CASE WHEN user_id % 3 = 0 THEN ['asia', 'overall'] ELSE ['overall'] END) AS region, CASE WHEN event_id % 2 = 0 THEN 'direct' ELSE 'proxy' END AS side, event_id % 3 AS round, CASE WHEN event_type = 'error' THEN NULL WHEN value > 90 THEN 503 ELSE 200 END AS status, list_filter([CASE WHEN value > 95 THEN 'slow' END, CASE WHEN event_type = 'error' THEN 'no answer' END, CASE WHEN user_id % 7 = 0 THEN 'nonce' END], lambda x: x IS NOT NULL) AS reasons FROM events), k AS (SELECT *, NULL AS r FROM h UNION ALL SELECT *, round AS r FROM h)"


@query(f"""WITH {HTTP}, s AS (SELECT region, side, r, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses FROM (SELECT region, side, r, status, count(*) AS n FROM k WHERE status IS NOT NULL GROUP BY ALL) GROUP BY ALL), w AS (SELECT region, side, r, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons FROM (SELECT region, side, r, reason, count(*) AS n FROM (SELECT region, side, r, unnest(reasons) AS reason FROM k) GROUP BY ALL) GROUP BY ALL),
t AS (SELECT region, side, r, count(*) AS attempts, count(*) FILTER (len(reasons) = 0) AS successes FROM k GROUP BY ALL) SELECT t.region, t.side, t.r AS round, attempts, successes, coalesce(statuses, '') AS statuses, coalesce(w.reasons, '') AS reasons FROM t LEFT JOIN s ON s.region = t.region AND s.side = t.side AND s.r IS NOT DISTINCT FROM t.r LEFT JOIN w ON w.region = t.region AND w.side = t.side AND w.r IS NOT DISTINCT FROM t.r""")
def http_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by region and side, over all rounds and for each: statuses and reasons counted."""
    i = F.col("event_id")
    reasons = F.filter(F.array(F.when(F.col("value") > 95, "slow"), F.when(F.col("event_type") == "error", "no answer"), F.when(F.col("user_id") % 7 == 0, "nonce")), lambda x: x.isNotNull())
    regions = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("asia"), F.lit("overall"))).otherwise(F.array(F.lit("overall")))
    status = F.when(F.col("event_type") == "error", None).when(F.col("value") > 90, 503).otherwise(200)
    samples = events(spark, sf_dir).select(regions.alias("regions"), F.when(i % 2 == 0, "direct").otherwise("proxy").alias("side"), (i % 3).alias("round"), (F.size(reasons) == 0).alias("ok"), status.alias("status"), reasons.alias("reasons"))
    return P.breakdown(samples)


@query("SELECT place, query FROM (SELECT n_name || ' ' || r_name AS query, row_number() OVER (ORDER BY sha256('7' || n_name || ' ' || r_name)) - 1 AS place FROM nation, region) WHERE place BETWEEN 10 AND 49")
def query_pool_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty queries of the pool, in the order of a seed."""
    topics, preferences = table(spark, sf_dir, "nation").select(F.col("n_name").alias("topic")), table(spark, sf_dir, "region").select(F.col("r_name").alias("preference"))
    return P.query_pool(topics, preferences, "7", 10, 40).select(F.col("place").cast("long").alias("place"), "query")


@query(f"{SENTENCES} SELECT dataset, CASE source_row_id % 8 WHEN 0 THEN 'generation' WHEN 1 THEN 'dataset' WHEN 2 THEN 'row' WHEN 3 THEN 'index' WHEN 4 THEN 'work' WHEN 5 THEN 'work' WHEN 6 THEN CASE WHEN raw_index >= normalized_index THEN NULL ELSE 'index' END END AS reason, count(*) AS n FROM found GROUP BY ALL")
def locator_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators counted by the first reason against them; of eight rows six have a fault put into their locators."""
    k, none = F.col("source_row_id") % 8, F.lit(None)
    names = [r["source"] for r in table(spark, sf_dir, "documents").select("source").distinct().collect()]  # the registry's datasets
    hit = {
        "generation": F.when(k == 0, "v0").otherwise("v1"),
        "dataset": F.when(k == 1, "unheard of").otherwise(F.col("dataset")),
        "row": F.when(k == 2, 0).otherwise(F.col("source_row_id")),
        "raw": F.when(k == 3, -1).otherwise(F.col("raw_index")),
        "norm": F.col("normalized_index"),
        "work": F.when(k == 4, " ").when(k == 5, F.concat_ws(":", "dataset", (F.col("source_row_id") + 1).cast("string"))).otherwise(F.col("work_id")),
    }
    reason = P.locator_reason(hit, "v1", [n for n in names if n is not None])
    return corpus.found(spark, sf_dir).groupBy("dataset", F.coalesce(reason, none.cast("string")).alias("reason")).agg(F.count("*").alias("n"))
