"""Plans of the scalar functions, over documents, conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.functions import scalars as S
from corpusjobs.plans.registry import SQL, query, table

#: Lines of a document in SQL: its content array, with blank entries.
CONTENT = r"string_split_regex(text, '[.\n]')"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def content() -> Column:
    """A document's text as a content array: cut at full stops and line feeds, so that entries may be blank."""
    return F.split("text", r"[.\n]")


@query(rf"SELECT doc_id, regexp_replace(source || '-' || lang, '[^\w]', '_', 'g') AS name, CASE WHEN regexp_matches(CAST(doc_id AS VARCHAR) || lang, '^\d') THEN 'f_' || doc_id || lang ELSE doc_id || lang END AS digit_name FROM documents")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", S.normalize_name(F.concat_ws("-", "source", "lang")).alias("name"), S.normalize_name(F.concat(F.col("doc_id").cast("string"), "lang")).alias("digit_name"))


@query(f"SELECT doc_id, CAST(len(v) AS INTEGER) AS n_values, CAST(len(list_filter(v, lambda x: {TRIM.format('x')} <> '')) AS INTEGER) AS n_filled, list_filter([CASE WHEN {TRIM.format('x')} <> '' THEN i - 1 END for x, i in v], lambda y: y IS NOT NULL) AS places FROM (SELECT doc_id, {CONTENT} AS v FROM documents)")
def source_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", S.source_values(F.to_json(content())).alias("v"))
    kept = rows.select("doc_id", "v", S.normalized_source(F.col("v")).alias("kept"))
    return kept.select("doc_id", F.size("v").alias("n_values"), F.size("kept").alias("n_filled"), F.transform("kept", lambda p: p["raw"].cast("long")).alias("places"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE list_transform({CONTENT}, lambda x: {TRIM.format('x')}) END AS lines FROM documents")
def translation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct("text"))).otherwise(F.to_json(content()))
    return table(spark, sf_dir, "documents").select("doc_id", S.translation_values(text).alias("lines"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {'part': 1::BIGINT, 'count': 1::BIGINT} WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 AND doc_id % 7 + 1 <= 5 THEN {'part': doc_id % 7 + 1, 'count': 5::BIGINT} END AS parts FROM documents")
def part_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    part = F.when(i % 4 == 1, "x").when(i % 4 == 2, F.concat((i % 7 + 1).cast("string"), F.lit(".0"))).when(i % 4 == 3, "2.5")
    return table(spark, sf_dir, "documents").select("doc_id", S.part_values(part, F.when(i % 4 != 0, "5")).alias("parts"))


@query(rf"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS lines, list_filter([{TRIM.format('text')}], lambda x: x <> '') AS whole FROM documents")
def parse_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.parse_content(F.to_json(F.split("text", "\n"))).alias("lines"), S.parse_content(F.col("text")).alias("whole"))


@query(r"SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(line, '^[\p{P}\p{S}\s]+$') AND regexp_matches(line, '\S') THEN 1 ELSE 0 END) AS BIGINT) AS punctuation_lines FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\p{L}]+ ', ' ', 'g'), chr(10))) AS line FROM documents) GROUP BY doc_id")
def is_punctuation_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.regexp_replace("text", r"[\p{L}]+ ", " "), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(S.is_punctuation_only(F.col("line"))).alias("punctuation_lines"))


@query("SELECT doc_id, doc_id % 5 = 0 AS placeholder FROM documents")
def is_placeholder_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("doc_id") % 5 == 0, F.lit("□□，■。")).when(F.col("doc_id") % 5 == 1, F.lit("，。")).otherwise(F.concat(F.lit("□"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", S.is_placeholder_only(sign).alias("placeholder"))


@query("SELECT doc_id, doc_id % 6 = 0 AS refuses, doc_id % 4 = 0 AS refuses_to_explain FROM documents")
def refusal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    lines = F.array(F.col("text"), F.when(i % 6 == 0, F.lit("（无法翻译）。")).otherwise(F.lit("无法翻译吗")))
    told = F.when(i % 4 == 0, F.lit("抱歉，无法解读")).otherwise(F.concat(F.lit("无法解读"), F.repeat("source", 40)))
    return table(spark, sf_dir, "documents").select("doc_id", S.refuses(lines).alias("refuses"), S.interpretation_refuses(told).alias("refuses_to_explain"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE '{"n":' || n_chars || '}' END AS json FROM documents""")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, json = F.col("doc_id"), F.to_json(F.struct(F.col("n_chars").alias("n")))
    said = F.when(i % 3 == 0, json).when(i % 3 == 1, F.concat(F.lit("here: "), json, F.lit(" done"))).otherwise("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.extract_json(said).alias("json"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE list_filter(list_transform([lang, source, '', {TRIM.format('text')}], lambda x: x), lambda x: x <> '') END AS lines FROM documents")
def normalize_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that hold the whole text."""
    return normalized(table(spark, sf_dir, "documents"), F.col("text"))


@query()
def normalize_whole_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(table(spark, sf_dir, "documents"), F.col("text"))


SQL["normalize_whole_translation"] = SQL["normalize_translation"]


def normalized(docs: DataFrame, text: Column) -> DataFrame:
    """Lines of answers given as a list, by number or in a wrong form."""
    i = F.col("doc_id")
    values = [F.col("lang"), F.col("source"), F.lit(""), text]
    by_key = F.to_json(F.create_map(*[x for k, v in [(4, values[3]), (2, values[1]), (1, values[0]), (3, values[2])] for x in (F.lit(str(k)), v)]))
    wrong = F.to_json(F.create_map(F.lit("2"), F.col("lang")))
    json = F.when(i % 3 == 0, F.to_json(F.array(*values))).when(i % 3 == 1, by_key).otherwise(wrong)
    return docs.select("doc_id", S.normalize_translation(json).alias("lines"))


@query(rf"""WITH d AS (SELECT doc_id, list_filter(list_transform({CONTENT}, lambda x: {TRIM.format('x')}), lambda x: x <> '') AS s FROM documents),
t AS (SELECT doc_id, s, CASE doc_id % 4 WHEN 0 THEN list_transform(s, lambda x: x || '!') WHEN 1 THEN s WHEN 2 THEN list_transform(s, lambda x: 'a') ELSE s[2:] END AS t FROM d)
SELECT doc_id, CASE WHEN len(s) = 0 THEN CASE WHEN false THEN '' END WHEN len(s) <> len(t) THEN 'line count' WHEN s = t AND len(list_filter(s, lambda x: NOT regexp_matches(x, '^[\p{{P}}\p{{S}}\s]+$'))) > 0 THEN 'identical'
WHEN 10 * list_sum(list_transform(t, lambda x: length(regexp_replace(x, '\s', '', 'g')))) < 3 * list_sum(list_transform(s, lambda x: length(regexp_replace(x, '\s', '', 'g')))) THEN 'too short' END AS reason FROM t""")
def translation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(content(), S.trim_all), lambda x: x != "").alias("s"))
    i = F.col("doc_id") % 4
    t = F.when(i == 0, F.transform("s", lambda x: F.concat(x, F.lit("!")))).when(i == 1, F.col("s")).when(i == 2, F.transform("s", lambda x: F.lit("a"))).otherwise(F.slice("s", 2, 2**31 - 1))
    return rows.select("doc_id", S.translation_quality(F.col("s"), t).alias("reason"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'done' ELSE 'failed' END AS status, CASE turn % 4 WHEN 1 THEN 'refusal' WHEN 2 THEN 'no interpretation' WHEN 3 THEN 'no JSON' END AS reason FROM conversations WHERE regexp_matches(text, '\\S')""".replace("\\\\", "\\"))
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 4
    line = F.when(k == 1, F.lit("无法翻译。")).otherwise(F.concat(F.lit("translated: "), "text"))
    told = F.when(k == 2, F.lit(" ")).otherwise(F.lit("what it says"))
    payload = F.when(k == 3, F.lit("no answer")).otherwise(F.concat(F.lit("answer "), F.to_json(F.struct(F.array(line).alias("translation"), told.alias("interpretation")))))
    rows = table(spark, sf_dir, "conversations").where(F.regexp_like("text", F.lit(r"\S")))
    return rows.select("conv_id", "turn", S.parse_response(F.array("text"), payload).alias("r")).select("conv_id", "turn", "r.status", "r.reason")


@query()
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 8 lines and 600 characters; tested against a loop."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    chunks = rows.select("doc_id", "lines", F.posexplode(S.chunk_lines(F.col("lines"), 8, 600)).alias("chunk", "span"))
    own = F.slice("lines", F.col("span.from"), F.col("span.to") - F.col("span.from") + 1)
    return chunks.select("doc_id", "chunk", F.size(own).alias("n_lines"), F.length(F.array_join(own, "")).alias("n_chars"), F.sha2(F.array_join(own, "\n"), 256).alias("lines_sha256"))


@query("""SELECT doc_id, '1. ' || CAST(to_json(lang) AS VARCHAR) || chr(10) || '2. ' || CAST(to_json(source) AS VARCHAR) || chr(10) || 'keys: translation,interpretation' AS prompt FROM documents""")
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.build_prompt(F.array("lang", "source"), F.array(F.lit("translation"), F.lit("interpretation"))).alias("prompt"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'skip' WHEN event_id % 7 = 1 THEN 'timeout' WHEN event_id % 7 IN (2, 3) THEN 'load' WHEN event_id % 7 = 4 THEN 'retry' WHEN event_id % 7 = 5 THEN 'permanent' ELSE 'other' END AS kind FROM events""")
def classify_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    said = F.when(k == 0, "ContentFilter hit").when(k == 1, "Request timed out").when(k == 2, "Rate Limit reached").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", S.classify_failure(said, F.when(k == 3, 429).when(k == 4, 503).when(k == 5, 404).otherwise(200)).alias("kind"))


@query("SELECT doc_id, source || ':' || (doc_id + 1) AS work, (doc_id + 1) || ':' || n_chars || ':0' AS locator, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {'dataset': source, 'row': doc_id + 1} END AS parsed FROM documents")
def work_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work ids, locator keys, and work ids parsed back; ids that aren't written plainly are refused."""
    row = F.col("doc_id") + 1
    written = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(":0"), row.cast("string"))).otherwise(S.work_id(F.col("source"), row))
    return table(spark, sf_dir, "documents").select("doc_id", S.work_id(F.col("source"), row).alias("work"), S.locator_key(row, F.col("n_chars"), F.lit(0)).alias("locator"), S.parse_work_id(written).alias("parsed"))


@query("""WITH h AS (SELECT doc_id, sha1(from_hex('cc0fab8eff7c49f2809dd96a73b5e4fc') || encode('v1:' || source || ':' || doc_id || ':0:0')) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(('0x' || h[17]) AS INTEGER) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(":", F.lit("v1"), "source", F.col("doc_id").cast("string"), F.lit("0"), F.lit("0"))
    return table(spark, sf_dir, "documents").select("doc_id", S.point_id(S.POINT_NAMESPACE, name).alias("point_id"))


@query("SELECT doc_id, sha256(text) AS text_hash, sha256(encode(lang) || from_hex('00') || encode(text)) AS query_key FROM documents")
def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.text_hash(F.col("text")).alias("text_hash"), S.query_key(F.col("lang"), F.col("text")).alias("query_key"))


@query(r"SELECT page_id, coalesce(try_cast(replace(regexp_extract(regexp_replace(html, '<script>.*?</script>|<style>.*?</style>', '', 'gs'), '[?&]page=([\d,]+)', 1), ',', '') AS BIGINT), 0) AS in_page, coalesce(try_cast(regexp_extract(url, 'page=(\d+)', 1) AS BIGINT), 0) AS in_url FROM pages")
def html_result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.html_result_count(F.col("html"), r"[?&]page=([\d,]+)").alias("in_page"), S.html_result_count(F.col("url"), r"page=(\d+)").alias("in_url"))


@query("SELECT page_id, '/works/' || url_encode(url) || '?generation=' || url_encode('v 1') AS detail, url_encode('a ' || url) AS keyword FROM pages")
def detail_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to works, and search keywords, percent-encoded."""
    return table(spark, sf_dir, "pages").select("page_id", S.detail_url(F.col("url"), F.lit("v 1")).alias("detail"), S.url_escape(F.concat(F.lit("a "), "url")).alias("keyword"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def utc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 3
    written = F.when(k == 0, F.concat(shape, F.lit("Z"))).when(k == 1, F.concat(shape, F.lit("+00:00"))).otherwise(F.concat(shape, F.lit("+02:00")))
    return table(spark, sf_dir, "events").select("event_id", S.utc_parse(written).cast("timestamp_ntz").alias("at"))


@query("""SELECT doc_id, '{"work_id":"' || source || ':' || doc_id || '","dataset":"' || source || '","title":"' || lang || '","author":null,"original":[' || CAST(to_json(text) AS VARCHAR) || '],"translation":[],"interpretations":[]}' AS document FROM documents""")
def work_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return table(spark, sf_dir, "documents").select("doc_id", S.work_document(S.work_id(F.col("source"), F.col("doc_id")), F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.array("text"), none, none).alias("document"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS title, CASE WHEN doc_id % 3 = 0 THEN lang END AS author FROM documents")
def display_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and author from the first field that isn't blank."""
    i = F.col("doc_id")
    blank = F.lit(" 　")
    title = S.first_filled(F.when(i % 2 == 0, F.col("source")).otherwise(blank), F.lit(None).cast("string"), F.concat(blank, "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), S.first_filled(F.when(i % 3 == 0, F.col("lang"))).alias("author"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '[à-ÿ]'), false) AS found FROM documents")
def regexp_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular expression as a condition: false for null."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").rlike("[à-ÿ]"), F.lit(False)).alias("found"))


@query("SELECT source AS dataset, count(*) AS sentences FROM (SELECT source, unnest(string_split_regex(text, '[.\\n]')) AS line FROM documents) WHERE regexp_matches(line, '[\\p{L}\\p{N}]') GROUP BY source".replace("\\\\", "\\"))
def sentences_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document aligned with itself line by line, exploded to sentences, and the indexable ones counted."""
    from corpusjobs.operators import corpus as C

    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), (F.col("doc_id") + 1).alias("id"), content().alias("content"), content().alias("translation"))
    marked = rows.withColumn("translation", F.transform("translation", lambda x: F.when(S.trim_all(x) != "", x).otherwise("-")))
    return C.sentences(C.aligned(marked)).groupBy("dataset").agg(F.count("*").alias("sentences"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'counts differ' WHEN 2 THEN 'fields' WHEN 3 THEN 'no JSON' END AS reason FROM documents")
def validate_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("doc_id") % 4, F.lit(None).cast("array<string>")
    lines = F.array("text")
    whole = S.work_document(S.work_id(F.col("source"), F.col("doc_id")), F.col("source"), F.col("lang"), F.lit(None).cast("string"), lines, F.when(k == 0, lines).otherwise(none), none)
    json = F.when(k == 2, F.to_json(F.struct("text", "lang"))).when(k == 3, F.concat(F.lit("{"), "text")).otherwise(whole)
    return table(spark, sf_dir, "documents").select("doc_id", S.document_reason(json).alias("reason"))
