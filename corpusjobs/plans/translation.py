"""Plans over the states of rows to translate; documents stand for rows, their numbers decide the states."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.functions import scalars as S
from corpusjobs.operators import calls, translation
from corpusjobs.operators import corpus as C
from corpusjobs.plans.registry import query, table
from corpusjobs.sources.shared import scratch

STATES = "rows AS (SELECT doc_id AS id, source AS dataset, text, CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' END AS status, doc_id % 4 AS retries FROM documents)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    status = F.when(k == 0, "pending").when(k == 1, "processing").when(k == 2, "done").when(k == 3, "failed")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("dataset"), "text", status.alias("translation_status"), (F.col("doc_id") % 4).cast("int").alias("translation_retry_count"))
    return C.add_status_columns(docs)


@query("SELECT doc_id, 'pending' AS translation_status, CAST(0 AS INTEGER) AS translation_retry_count, CAST(NULL AS VARCHAR) AS translation_error FROM documents")
def add_status_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.add_status_columns(table(spark, sf_dir, "documents")).select("doc_id", "translation_status", "translation_retry_count", "translation_error")


@query(f"WITH {STATES} SELECT id FROM rows WHERE coalesce(status, 'pending') = 'pending' OR status = 'failed' AND retries < 3")
def pending_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pending(rows(spark, sf_dir), 3).select("id")


@query(f"WITH {STATES} SELECT id, dataset FROM rows WHERE status = 'done' AND dataset IN ('src1', 'src9')")
def done_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where((F.col("translation_status") == "done") & F.col("dataset").isin("src1", "src9")).select("id", "dataset")


@query(f"WITH {STATES} SELECT dataset, count(*) AS total, count(*) FILTER (coalesce(status, 'pending') = 'pending') AS pending, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM rows GROUP BY dataset")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.coalesce("translation_status", F.lit("pending"))
    return rows(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("total"), *[F.count_if(state == s).alias(s) for s in ("pending", "done", "failed")])


@query(f"WITH {STATES} SELECT id, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'processing' THEN 'restarted' END AS error FROM rows")
def recycle_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recycle(rows(spark, sf_dir), "restarted").select("id", F.col("translation_status").alias("status"), F.col("translation_error").alias("error"))


@query(f"WITH {STATES}, o AS (SELECT id, CASE id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'skipped' END AS outcome FROM rows WHERE coalesce(status, 'pending') = 'pending') SELECT id, coalesce(outcome, status) AS status, CASE WHEN outcome = 'failed' THEN retries + 1 ELSE retries END AS retries, CASE WHEN outcome = 'failed' AND retries + 1 >= 3 THEN 'given up: note' WHEN outcome IN ('failed', 'skipped') THEN 'note' END AS error FROM rows LEFT JOIN o USING (id)")
def apply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_rows = rows(spark, sf_dir)
    k = F.col("id") % 3
    outcome = F.when(k == 0, "done").when(k == 1, "failed").otherwise("skipped")
    outcomes = all_rows.where(F.coalesce("translation_status", F.lit("pending")) == "pending").select("dataset", "id", outcome.alias("outcome"), F.array("text").alias("lines"), F.lit("note").alias("note"))
    return C.apply_outcomes(all_rows, outcomes, 3).select("id", F.col("translation_status").alias("status"), F.col("translation_retry_count").cast("long").alias("retries"), F.col("translation_error").alias("error"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'empty' WHEN doc_id % 6 = 1 THEN 'punctuation' END AS skipped FROM documents")
def prefilter_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without content or with punctuation alone are skipped before any call."""
    k = F.col("doc_id") % 6
    lines = F.when(k == 0, F.array(F.lit(" "))).when(k == 1, F.array(F.lit("。！"), F.lit("--"))).otherwise(F.array(F.lit("。"), F.concat(F.lit("a"), "text")))
    kept = F.filter(F.transform(lines, S.trim_all), lambda x: x != "")
    found = table(spark, sf_dir, "documents").select("doc_id", kept.alias("kept"))
    return found.select("doc_id", F.when(F.size("kept") == 0, "empty").when(F.forall("kept", S.is_punctuation_only), "punctuation").alias("skipped"))


def by_rule(requests: list[tuple[str, int, str, str | None]]) -> list[str]:
    """A translator that puts a mark before each line, and fails by the number of characters it is given: see RULED."""
    (_, attempt, request, hint) = requests[0]
    lines = json.loads(request)
    kind = sum(map(len, lines)) % 11
    if kind == 0:
        raise calls.CallError("HTTP 400: contentfilter", 400)
    if kind == 1 and attempt == 0:
        raise calls.CallError("HTTP 503", 503)
    if kind == 4 and len(lines) == 1 or kind == 5 and len(lines) > 6:
        return ["no JSON at all"]
    said = [line if kind == 2 and hint is None else f"en: {line}" for line in lines]
    if kind == 3 and len(lines) > 1:
        said.pop()
    return [json.dumps({"translation": {str(k + 1): x for k, x in enumerate(said)}, "interpretation": f"{len(lines)} lines"})]


#: The same rules: what becomes of chunks of 8 lines, of single lines where the model leaves one out, and so of rows.
RULED = r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*$')) AS lines FROM documents),
p AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS k FROM l),
o AS (SELECT doc_id, k // 8 AS chunk, k, line, length(line) % 11 AS kind FROM p),
c AS (SELECT doc_id, chunk, count(*) AS n, sum(length(line)) % 11 AS kind FROM o GROUP BY ALL),
s AS (SELECT doc_id, chunk, k, CASE kind WHEN 0 THEN 'skipped' WHEN 4 THEN 'failed' ELSE 'done' END AS state, CASE kind WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 1 END AS calls FROM o),
b AS (SELECT doc_id, chunk, coalesce(min_by(state, k) FILTER (state <> 'done'), 'done') AS state, sum(calls) AS calls FROM s GROUP BY ALL),
t AS (SELECT doc_id, chunk, n, CASE WHEN c.kind = 0 THEN 'skipped' WHEN c.kind = 3 AND n > 1 THEN b.state WHEN c.kind = 4 AND n = 1 OR c.kind = 5 AND n > 6 THEN 'failed' ELSE 'done' END AS state,
CASE WHEN c.kind = 3 AND n > 1 THEN 3 + b.calls WHEN c.kind IN (1, 2) THEN 2 WHEN c.kind = 4 AND n = 1 OR c.kind = 5 AND n > 6 THEN 3 ELSE 1 END AS calls,
CASE WHEN c.kind = 3 AND n > 1 THEN array_to_string(list_transform(range(n), lambda x: '1 lines'), chr(10)) ELSE n || ' lines' END AS told FROM c JOIN b USING (doc_id, chunk)),
r AS (SELECT doc_id, coalesce(min_by(state, chunk) FILTER (state <> 'done'), 'done') AS outcome, CAST(sum(calls) AS BIGINT) AS attempts, string_agg(told, chr(10) ORDER BY chunk) AS told FROM t GROUP BY doc_id),
x AS (SELECT doc_id, string_agg('en: ' || regexp_replace(line, '\s+$', ''), chr(10) ORDER BY k) AS text FROM o GROUP BY doc_id)
SELECT l.doc_id, coalesce(outcome, 'skipped') AS outcome, coalesce(attempts, 0) AS attempts, CASE WHEN outcome = 'done' THEN sha256(x.text) END AS translation, CASE WHEN outcome = 'done' THEN sha256(told) END AS interpretation FROM l LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)"""


@query(RULED)
def translate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row through a translator that fails by rule: outcomes, calls made, hashes of what was put together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    found = translation.translate(docs, by_rule, scratch(spark, "calls"), "doc_id", retries=2, most_chars=10**9, wait=lambda s: None)
    return found.select("doc_id", "outcome", "attempts", F.sha2(F.array_join("translation", "\n"), 256).alias("translation"), F.sha2("interpretation", 256).alias("interpretation"))


def marked(requests: list[tuple[str, int, str, str | None]]) -> list[list[str]]:
    """Puts a mark before the first line of a row's first chunk."""
    lines = [(key, json.loads(request)) for key, _, request, _ in requests]
    return [[f"en: {x[0]}", *x[1:]] if key.endswith(":0") else x for key, x in lines]


@query()
def translate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row through a caller's function that isn't checked, chunk by chunk."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    spans = docs.select("doc_id", "lines", F.posexplode(S.chunk_lines(F.col("lines"), 8, 600)).alias("chunk", "s"))
    chunks = spans.select("doc_id", "chunk", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("key"), F.to_json(F.slice("lines", F.col("s.from"), F.col("s.to") - F.col("s.from") + 1)).alias("request"))
    found = calls.answers(chunks.select("key", "request"), marked, scratch(spark, "calls"), "array<string>")
    parts = chunks.select("doc_id", "chunk", "key").join(found.select("key", F.col("answer").alias("lines")), "key")
    return merge(parts).select("doc_id", F.sha2(F.array_join("lines", "\n"), 256).alias("translation"), F.lit(1).alias("n"))


def merge(chunks: DataFrame) -> DataFrame:
    """The lines of each row's chunks in order."""
    return chunks.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "lines"))), lambda c: c["lines"])).alias("lines"))


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cut and put together again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    chunks = docs.select("doc_id", "lines", F.posexplode(S.chunk_lines(F.col("lines"), 8, 600)).alias("chunk", "s")).select("doc_id", "chunk", F.slice("lines", F.col("s.from"), F.col("s.to") - F.col("s.from") + 1).alias("lines"))
    return merge(chunks).select("doc_id", F.sha2(F.array_join("lines", "\n"), 256).alias("text_hash"))
