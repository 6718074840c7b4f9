"""Plans that join and reconcile: snapshots, manifests, inventories, positions, restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusjobs.operators import known, ranks, reconcile
from corpusjobs.plans.registry import query, table
from corpusjobs.sources.shared import scratch


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the documents: the second lacks some, has others' text changed, and some under new ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    i = F.col("doc_id")
    target = docs.where(i % 13 != 0).select(F.when(i % 17 == 0, i + 1_000_000_000).otherwise(i).alias("doc_id"), "source", F.when(i % 11 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")).alias("hash"))
    return docs, target


TARGET = "s AS (SELECT doc_id, source, sha256(text) AS hash FROM documents), t AS (SELECT CASE WHEN doc_id % 17 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, source, CASE WHEN doc_id % 11 = 0 THEN 'x' || hash ELSE hash END AS hash FROM s WHERE doc_id % 13 <> 0)"


@query(f"WITH {TARGET} SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'unknown' ELSE 'changed' END AS state FROM s FULL JOIN t ON s.doc_id = t.doc_id WHERE s.doc_id IS NULL OR t.doc_id IS NULL OR s.hash <> t.hash")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that one side lacks, and those whose content differs: both sides are written with trees of digests, and rows are read from leaves that differ."""
    a, b = points(spark, sf_dir)
    place = scratch(spark, "snapshots")
    for name, side in (("a", a), ("b", b)):
        known.write_with_digests(side.select("doc_id", "hash"), f"{place}/{name}", "doc_id", "hash")
    both = known.difference(spark, f"{place}/a", f"{place}/b", "doc_id", "hash")
    return both.select("doc_id", F.when(~F.col("in b"), "missing").when(~F.col("in a"), "unknown").otherwise("changed").alias("state"))


@query(f"WITH {TARGET} SELECT s.source AS dataset, count(*) AS canonical, count(t.doc_id) AS stored, count(*) FILTER (s.hash = t.hash) AS equal FROM s LEFT JOIN t USING (doc_id) GROUP BY s.source")
def inventory_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = points(spark, sf_dir)
    both = a.join(b.select("doc_id", F.col("hash").alias("stored")), "doc_id", "left")
    return both.groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("canonical"), F.count("stored").alias("stored"), F.count_if(F.col("hash") == F.col("stored")).alias("equal"))


#: SQL of canonical payloads, and of stored ones with planted faults.
PAYLOADS = """c AS (SELECT doc_id, json_object('dataset', source, 'row', doc_id, 'share', 0.5, 'work', json_object('id', source || ':' || doc_id, 'lang', lang), 'places', [n_chars, n_chars + 1, n_chars + 2]) AS payload, sha256(text) AS hash FROM documents),
t AS (SELECT CASE WHEN doc_id % 16 = 7 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, json_merge_patch(payload, json_object('translation_hash', CASE WHEN doc_id % 16 = 4 THEN upper(hash) ELSE hash END), CASE doc_id % 16 WHEN 0 THEN '{"work": {"lang": null}}' WHEN 1 THEN '{"work": {"more": {"note": true}}}' WHEN 2 THEN json_object('row', CAST(doc_id AS VARCHAR)) WHEN 3 THEN json_object('places', [json_extract(payload, '$.places[0]'), -1, json_extract(payload, '$.places[2]')]) WHEN 5 THEN '{"poetry_api_schema": 1}' WHEN 8 THEN json_object('places', [json_extract(payload, '$.places[0]')]) WHEN 9 THEN '{"share": 1}' ELSE '{}' END) AS payload FROM c WHERE doc_id % 16 <> 6)"""


@query(f"""WITH {PAYLOADS}, x AS (SELECT doc_id, fullkey AS path, CASE WHEN type LIKE '%BIGINT' THEN 'whole' ELSE type END AS type, atom FROM c, json_tree(c.payload) WHERE type NOT IN ('OBJECT', 'ARRAY')), y AS (SELECT doc_id, fullkey AS path, CASE WHEN type LIKE '%BIGINT' THEN 'whole' ELSE type END AS type, atom FROM t, json_tree(t.payload) WHERE type NOT IN ('OBJECT', 'ARRAY')),
f AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.path, y.path) AS path, CASE WHEN y.path LIKE '$.poetry%' THEN 'owned' WHEN y.path IS NULL THEN 'missing' WHEN y.path = '$.translation_hash' THEN CASE WHEN NOT regexp_full_match(y.atom ->> '$', '[0-9a-f]{{64}}') THEN 'hash form' END WHEN x.path IS NULL THEN 'unknown' WHEN x.type <> y.type THEN 'type' WHEN x.atom <> y.atom THEN 'value' END AS kind FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.path = y.path WHERE coalesce(x.doc_id, y.doc_id) IN (SELECT doc_id FROM c) AND coalesce(x.doc_id, y.doc_id) IN (SELECT doc_id FROM t))
SELECT doc_id, '$' AS path, CASE WHEN t.payload IS NULL THEN 'missing' ELSE 'unknown' END AS kind FROM c FULL JOIN t USING (doc_id) WHERE t.payload IS NULL OR c.payload IS NULL UNION ALL SELECT doc_id, path, kind FROM f WHERE kind IS NOT NULL""")
def inventory_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads against canonical ones, field by field; of sixteen points nine have a fault put into them, each another."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    k = i % 16
    n = F.col("n_chars").cast("long")
    variant = lambda c: F.to_variant_object(c)
    work = F.struct(F.concat_ws(":", "source", i.cast("string")).alias("id"), F.col("lang"))
    base = F.struct(F.col("source").alias("dataset"), i.alias("row"), F.lit(0.5).alias("share"), work.alias("work"), F.array(n, n + 1, n + 2).alias("places"))
    canonical = docs.select("doc_id", F.to_json(variant(base)).alias("payload"))
    hash_ = F.sha2("text", 256)
    fault = lambda at, change: F.when(k == at, change)
    texts = lambda c: F.to_json(variant(c))
    row = F.coalesce(fault(2, F.concat(F.lit('"'), i.cast("string"), F.lit('"'))), i.cast("string"))
    share = F.coalesce(fault(9, F.lit("1")), F.lit("0.5"))
    places = F.coalesce(fault(3, texts(F.array(n, F.lit(-1).cast("long"), n + 2))), fault(8, texts(F.array(n))), texts(F.array(n, n + 1, n + 2)))
    works = F.coalesce(fault(0, texts(F.struct(work["id"].alias("id")))), fault(1, texts(F.struct(work["id"].alias("id"), F.col("lang"), F.struct(F.lit(True).alias("note")).alias("more")))), texts(work))
    digest = F.coalesce(fault(4, F.upper(hash_)), hash_)
    extra = F.coalesce(fault(5, F.lit(',"poetry_api_schema":1')), F.lit(""))
    json = F.concat(F.lit('{"dataset":'), F.to_json(F.col("source").cast("variant")), F.lit(',"row":'), row, F.lit(',"share":'), share, F.lit(',"work":'), works, F.lit(',"places":'), places, F.lit(',"translation_hash":"'), digest, F.lit('"'), extra, F.lit("}"))
    stored = docs.where(k != 6).select(F.when(k == 7, i + 1_000_000_000).otherwise(i).alias("doc_id"), json.alias("payload"))
    return reconcile.differences(canonical, stored, "doc_id", "payload", ["poetry_api_schema", "poetry_original", "poetry_work_document"], ["translation_hash"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 3 = 1 THEN 'complete' ELSE 'partial' END AS owned, doc_id % 10 <> 0 AS before_kept FROM documents")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current fields against a manifest: the old ones must be unchanged; of the added ones all, some or none are there."""
    i = F.col("doc_id")
    before = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    added = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    now = F.map_concat(F.when(i % 10 == 0, F.create_map(F.lit("source"), F.lit("?"), F.lit("lang"), F.col("lang"))).otherwise(before), F.map_filter(added, lambda k, v: (i % 3 == 1) | ((i % 3 == 2) & (k == "a"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", before.alias("before"), added.alias("added"), now.alias("now"))
    have = F.size(F.filter(F.map_entries("added"), lambda e: F.col("now")[e["key"]].eqNullSafe(e["value"])))
    kept = F.forall(F.map_entries("before"), lambda e: F.col("now")[e["key"]].eqNullSafe(e["value"]))
    return rows.select("doc_id", F.when(have == 0, "none").when(have == F.size("added"), "complete").otherwise("partial").alias("owned"), kept.alias("before_kept"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 1")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't indexed yet."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return known.lacking(docs, docs.where("doc_id % 4 = 1"), "doc_id")


@query(f"WITH {TARGET} SELECT doc_id, hash FROM t UNION ALL SELECT doc_id, hash FROM s WHERE doc_id NOT IN (SELECT doc_id FROM t)")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored points with the new ones in place of those with the same id; of repeated ids one stays."""
    old, new = points(spark, sf_dir)
    return known.upserted(old, new, "doc_id").select("doc_id", "hash")


@query(f"WITH {TARGET} SELECT (SELECT count(*) FROM (SELECT doc_id FROM s EXCEPT SELECT doc_id FROM t)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM t EXCEPT SELECT doc_id FROM s)) AS extra, (SELECT count(*) FROM s) AS ours, (SELECT count(*) FROM t) AS theirs")
def id_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = points(spark, sf_dir)
    sides = a.select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select("doc_id", F.lit(0), F.lit(1))).groupBy("doc_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sides.agg(F.count_if(F.col("b") == 0).alias("missing"), F.count_if(F.col("a") == 0).alias("extra"), F.sum("a").alias("ours"), F.sum("b").alias("theirs"))


@query(f"WITH {TARGET}, d AS (SELECT * FROM s EXCEPT ALL SELECT * FROM t), e AS (SELECT * FROM t EXCEPT ALL SELECT * FROM s) SELECT 'missing' AS side, * FROM d UNION ALL SELECT 'extra', * FROM e")
def verify_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only one side has, with their number of times kept."""
    a, b = points(spark, sf_dir)
    return a.exceptAll(b).select(F.lit("missing").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("extra").alias("side"), "*"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def unique_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that occur more than once."""
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT source AS work, min(sha256(CAST(doc_id AS VARCHAR))) AS anchor FROM documents GROUP BY source")
def anchor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("work")).agg(F.min(F.sha2(F.col("doc_id").cast("string"), 256)).alias("anchor"))


@query("SELECT doc_id, source, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source) THEN lang END AS document FROM documents")
def document_on_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's document goes to its first point only: the anchors are an aggregate, joined back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "source").select("doc_id", "source", F.when(F.col("doc_id") == F.col("first"), F.col("lang")).alias("document"))


@query("""WITH r AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS place, sha256(doc_id || '|' || sha256(text)) AS h FROM documents), a AS (SELECT place[:6] AS place, sha256(string_agg(h, '' ORDER BY place, h)) AS h FROM r GROUP BY 1),
b AS (SELECT place[:4] AS place, sha256(string_agg(h, '' ORDER BY place, h)) AS h FROM a GROUP BY 1), c AS (SELECT place[:2] AS place, sha256(string_agg(h, '' ORDER BY place, h)) AS h FROM b GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY place, h)) AS fingerprint FROM c""")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of all rows by a tree: rows in order under 16 million places, these in order under 65,536, then 256, then one.

    Above the rows no node has more than 256 children; 10^11 rows are about 6,000 under each of the lowest places.
    """
    rows = table(spark, sf_dir, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("place"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.sha2("text", 256)), 256).alias("h"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda p: p["h"]), ""), 256)
    for digits in (6, 4, 2):
        rows = rows.groupBy(F.substring("place", 1, digits).alias("up")).agg(digest.alias("h")).withColumnRenamed("up", "place")
    return rows.agg(digest.alias("fingerprint"))


@query("SELECT o_orderkey AS pos, a.n AS baidu, b.n AS google, a.n IS NOT NULL AND b.n IS NOT NULL AS complete FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.k = o_orderkey LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) b ON b.k = o_orderkey WHERE a.n IS NOT NULL OR b.n IS NOT NULL")
def positional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank lists of two engines merged by position; complete where every engine has one."""
    lines = table(spark, sf_dir, "lineitem")
    one = lambda flag, name: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("pos")).agg(F.count("*").alias(name))
    both = one("R", "baidu").join(one("N", "google"), "pos", "full_outer")
    return both.withColumn("complete", F.col("baidu").isNotNull() & F.col("google").isNotNull())


#: SQL of the lists of four engines: some lack a place, some tell another author, and one file lacks an engine.
RANKS = """e AS (SELECT * FROM (VALUES (0, 'baidu'), (1, 'so360'), (2, 'bing'), (3, 'google')) v(k, engine)), r AS (SELECT source AS file, doc_id AS pos, k, engine, CASE WHEN doc_id % 19 = 0 AND k = 3 THEN 'somebody' ELSE lang END AS author, 't' || doc_id AS title, (doc_id * (k + 2)) % 5 AS count FROM documents, e WHERE NOT (doc_id % 7 = 0 AND k = 2) AND NOT (source = 'src5' AND k = 1))"""


@query(f"""WITH {RANKS}, f AS (SELECT file FROM r GROUP BY file HAVING count(DISTINCT engine) = 4) SELECT file, pos, arg_max(author, k) AS author, arg_max(title, k) AS title, max(count) FILTER (k = 0) AS baidu, max(count) FILTER (k = 1) AS so360, max(count) FILTER (k = 2) AS bing, max(count) FILTER (k = 3) AS google, count(DISTINCT (author, title)) > 1 AS bad_info, bool_or(count = 0) AS has_zero FROM r WHERE file IN (SELECT file FROM f) GROUP BY file, pos""")
def merge_rank_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of four engines merged by place, for files that every engine has; places where they don't agree on author and title are told."""
    i, engines = F.col("doc_id"), ["baidu", "so360", "bing", "google"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.array(*map(F.lit, engines))).alias("k", "engine"))
    docs = docs.where(~((i % 7 == 0) & (F.col("k") == 2)) & ~((F.col("source") == "src5") & (F.col("k") == 1)))
    author = F.when((i % 19 == 0) & (F.col("k") == 3), "somebody").otherwise(F.col("lang"))
    lists = docs.select(F.col("source").alias("file"), i.alias("pos"), "engine", author.alias("author"), F.concat(F.lit("t"), i.cast("string")).alias("title"), ((i * (F.col("k") + 2)) % 5).alias("count"))
    return ranks.merge_lists(lists, engines)


@query("SELECT o_orderkey AS pos, o_orderpriority AS title, list(l_linenumber ORDER BY l_linenumber) FILTER (l_linenumber IS NOT NULL) AS strains FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def attach_strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tonal lists attached to the poems at their positions."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("strains"))
    poems = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("title"))
    return poems.join(lists, "pos", "left")


@query("SELECT p_partkey AS pos, CASE WHEN p_size < 10 THEN greatest(p_size, coalesce(n, 0)) ELSE p_size END AS count FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def rank_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that are suspiciously low are replaced by refreshed ones if those are greater."""
    fresh = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "part").join(fresh, "p_partkey", "left")
    return joined.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") < 10, F.greatest("p_size", F.coalesce("n", F.lit(0)))).otherwise(F.col("p_size")).alias("count"))


@query("SELECT a.n_nationkey, b.r_regionkey, a.n_name || ' ' || b.r_name AS query FROM nation a, region b")
def query_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by preferences; both are small fixed lists."""
    topics, preferences = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return topics.crossJoin(F.broadcast(preferences)).select("n_nationkey", "r_regionkey", F.concat_ws(" ", "n_name", "r_name").alias("query"))


@query("SELECT doc_id, n FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def first_n_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(w)).where("n <= 5").select("doc_id", "n")
