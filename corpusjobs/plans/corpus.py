"""Plans over records, sentences and works. Documents stand for dataset rows, orders and their lines for works and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusjobs.functions import scalars as S
from corpusjobs.operators import corpus as C
from corpusjobs.plans.registry import SQL, query, table
from corpusjobs.plans.text import CONTENT, TRIM

#: SQL of `rows()`: content and translation arrays of each document, some of them not fitting.
ROWS = f"""rows AS (SELECT dataset, id, content, kept, CASE id % 7 WHEN 0 THEN kept[2:] WHEN 1 THEN list_transform(content, lambda x: CASE WHEN {TRIM.format('x')} = '' THEN '-' ELSE lower({TRIM.format('x')}) END) ELSE list_transform(kept, lambda x: lower(x)) END AS translation
FROM (SELECT dataset, id, content, list_filter(list_transform(content, lambda x: {TRIM.format('x')}), lambda x: x <> '') AS kept FROM (SELECT source AS dataset, doc_id + 1 AS id, {CONTENT} AS content FROM documents)))"""
#: SQL of their reasons, and of their pairs.
JUDGED = "judged AS (SELECT *, CASE WHEN len(kept) = 0 THEN 'source is empty' WHEN len(translation) NOT IN (len(content), len(kept)) THEN 'counts differ' END AS reason FROM rows)"
PAIRS = f"""pairs AS (SELECT dataset, id, raw - 1 AS raw, row_number() OVER (PARTITION BY dataset, id ORDER BY raw) - 1 AS norm, original, CASE WHEN by_place THEN translation[raw] END AS placed, translation, by_place
FROM (SELECT dataset, id, unnest(range(1, len(content) + 1)) AS raw, unnest(list_transform(content, lambda x: {TRIM.format('x')})) AS original, translation, len(content) = len(translation) AS by_place FROM judged WHERE reason IS NULL) WHERE original <> ''),
sentences AS (SELECT dataset, id AS source_row_id, raw AS raw_index, norm AS normalized_index, dataset || ':' || id AS work_id, original, {TRIM.format('coalesce(placed, translation[norm + 1])')} AS translation FROM pairs)"""
SENTENCES = rf"WITH {ROWS}, {JUDGED}, {PAIRS}, found AS (SELECT * FROM sentences WHERE regexp_matches(original || translation, '[\p{{L}}\p{{N}}]'))"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), (F.col("doc_id") + 1).alias("id"), F.split("text", r"[.\n]").alias("content"))
    kept = F.filter(F.transform("content", S.trim_all), lambda x: x != "")
    placed = F.transform("content", lambda x: F.when(S.trim_all(x) == "", "-").otherwise(F.lower(S.trim_all(x))))
    k = F.col("id") % 7
    return docs.withColumn("translation", F.when(k == 0, F.slice(kept, 2, 2**31 - 1)).when(k == 1, placed).otherwise(F.transform(kept, F.lower)))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentences(C.aligned(rows(spark, sf_dir)))


@query(f"WITH {ROWS}, {JUDGED} SELECT dataset, id, reason, CASE WHEN reason IS NULL THEN len(kept) END AS n_pairs FROM judged")
def align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.aligned(rows(spark, sf_dir)).select("dataset", "id", "reason", F.when(F.col("pairs").isNotNull(), F.size("pairs")).cast("long").alias("n_pairs"))


@query(f"{SENTENCES} SELECT dataset, source_row_id, raw_index, normalized_index, work_id, sha256(original || '=' || translation) AS pair_sha256 FROM found")
def explode_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("dataset", "source_row_id", "raw_index", "normalized_index", "work_id", F.sha2(F.concat_ws("=", "original", "translation"), 256).alias("pair_sha256"))


@query(f"{SENTENCES} SELECT work_id, map_from_entries(list({{'key': source_row_id || ':' || raw_index || ':' || normalized_index, 'value': original}} ORDER BY source_row_id || ':' || raw_index || ':' || normalized_index)) AS locators FROM found GROUP BY work_id")
def work_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.work_locators(found(spark, sf_dir))


@query(f"{SENTENCES} SELECT dataset || ':' || id AS work_id, coalesce(n, 0) AS sentences FROM rows LEFT JOIN (SELECT work_id, count(*) AS n FROM found GROUP BY work_id) f ON f.work_id = dataset || ':' || id")
def works_with_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work with the number of its locators; works without sentences have none. Locators of no work are an error."""
    anchors = table(spark, sf_dir, "documents").select(S.work_id(F.col("source"), F.col("doc_id") + 1).alias("work_id"))
    located = found(spark, sf_dir).groupBy("work_id").agg(F.count("*").alias("sentences"))
    return anchors.join(located, "work_id", "left").select("work_id", F.coalesce("sentences", F.lit(0)).cast("long").alias("sentences"))


@query(f"{SENTENCES} SELECT 'v1' AS generation, 1 AS schema_version, count(*) AS sentences, count(DISTINCT work_id) AS works, count(DISTINCT dataset) AS datasets, (SELECT list(dataset || ': ' || n ORDER BY dataset) FROM (SELECT dataset, count(*) AS n FROM found GROUP BY dataset)) AS of_datasets FROM found")
def corpus_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, works and datasets of a generation, and the sentences of each dataset."""
    by_work = found(spark, sf_dir).groupBy("dataset", "work_id").agg(F.count("*").alias("n"))
    by_dataset = by_work.groupBy("dataset").agg(F.sum("n").alias("n"), F.count("*").alias("works"))
    each = F.sort_array(F.collect_list(F.struct("dataset", F.concat("dataset", F.lit(": "), "n").alias("said"))))["said"]
    return by_dataset.agg(F.sum("n").alias("sentences"), F.sum("works").alias("works"), F.countDistinct("dataset").alias("datasets"), each.alias("of_datasets")).select(F.lit("v1").alias("generation"), F.lit(1).alias("schema_version"), "sentences", "works", "datasets", "of_datasets")


@query(f"{SENTENCES} SELECT dataset, count(*) AS sentences, count(DISTINCT work_id) AS works, max(strlen(original) + strlen(translation)) AS max_row_bytes FROM found GROUP BY dataset")
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_work = found(spark, sf_dir).groupBy("dataset", "work_id").agg(F.count("*").alias("n"), F.max(F.octet_length("original") + F.octet_length("translation")).alias("bytes"))
    return by_work.groupBy("dataset").agg(F.sum("n").alias("sentences"), F.count("*").alias("works"), F.max("bytes").cast("long").alias("max_row_bytes"))


@query(f"{SENTENCES} SELECT original, translation, count(*) AS uses, min(source_row_id) AS first_row FROM found GROUP BY ALL HAVING count(*) > 1")
def dedup_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that several rows share, so that work on them is done once; grouped by hash, then told with their text."""
    return found(spark, sf_dir).groupBy("original", "translation").agg(F.count("*").alias("uses"), F.min("source_row_id").alias("first_row")).where("uses > 1")


@query("SELECT doc_id, line - 1 AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)")
def body_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every source."""
    return bodies(table(spark, sf_dir, "documents"))


@query()
def body_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every source."""
    return bodies(table(spark, sf_dir, "documents"))


def bodies(docs: DataFrame) -> DataFrame:
    return C.body_lines(docs.withColumn("lines", F.split("text", "\n")), "lines", "doc_id").withColumn("line", F.col("line").cast("long"))


@query("SELECT k.ord, doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents JOIN (VALUES (0, 'src7'), (1, 'src2')) k(ord, name) ON name = source")
def body_extract_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets by name in the caller's order; an unknown name is an error."""
    wanted = ["src7", "src2"]
    docs = table(spark, sf_dir, "documents")
    known = {r[0] for r in docs.where(F.col("source").isin(*wanted)).select("source").distinct().collect()}
    if missing := set(wanted) - known:
        raise ValueError(f"unknown datasets: {sorted(missing)}")
    names = spark.createDataFrame(list(enumerate(wanted)), "ord int, source string")
    return docs.join(F.broadcast(names), "source").select("ord", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS row_id FROM documents")
def assign_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assign_row_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", F.col("id").alias("row_id"))


@query("""SELECT doc_id, '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS json FROM documents""")
def serialize_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("lang", "n_chars")).alias("json"))


@query("SELECT doc_id, CAST(greatest(1, ceil(n / 5.0)) AS BIGINT) AS content_part_count, part AS content_part, CAST(least(5, n - 5 * (part - 1)) AS INTEGER) AS n_lines FROM (SELECT doc_id, n, unnest(range(1, CAST(greatest(1, ceil(n / 5.0)) AS BIGINT) + 1)) AS part FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents))")
def split_long_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in parts of at most five lines; aligned fields are cut alike."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    parts = C.split_long(docs.withColumn("spells", F.transform("lines", F.upper)), "lines", 5, 10**9, ("spells",))
    return parts.where(F.size("spells") == F.size("lines")).select("doc_id", "content_part", "content_part_count", F.size("lines").alias("n_lines"))


@query("SELECT conv_id, turn, len(string_split(text, chr(10))) + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS n_lines FROM conversations")
def prepend_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit("，"))).otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(C.prepend_punctuated_title(title, F.split("text", "\n"))).cast("long").alias("n_lines"))


@query("SELECT conv_id AS book, turn AS chapter, role AS author, text FROM conversations")
def expand_object_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations nested as books of chapters and opened again; chapters inherit what they lack."""
    chapters = F.collect_list(F.struct(F.col("turn").alias("chapter"), F.array(F.struct("role", "text")).alias("content")))
    books = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(chapters.alias("chapters"))
    flat = C.expand_objects(books, ("chapters", "content"), {"conv_id": "book"})
    return flat.select("book", "chapter", F.col("role").alias("author"), "text")


@query("SELECT conv_id, turn, text FROM conversations WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.role = 'system')")
def expand_content_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that is a list of objects becomes a row for each; conversations that mix kinds are left out."""
    content = F.collect_list(F.struct("turn", "text", "role"))
    books = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(content.alias("content"))
    return books.where(~F.exists("content", lambda c: c["role"] == "system")).select("conv_id", F.inline("content")).select("conv_id", "turn", "text")


@query("SELECT source AS dataset, count(*) AS rows, count(*) FILTER (doc_id % 9 = 0) AS missing FROM documents GROUP BY source")
def require_content_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("content"))
    good, bad = C.require_content(docs, "content")
    both = good.select("source", F.lit(0).alias("bad")).unionByName(bad.select("source", F.lit(1).alias("bad")))
    return both.groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("rows"), F.sum("bad").alias("missing"))


@query("SELECT lang, count(*) FILTER (doc_id % 4 = 0 OR doc_id % 4 = 3) AS kept, count(*) FILTER (doc_id % 4 IN (1, 2)) AS deleted FROM documents GROUP BY lang")
def drop_non_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with content but no Han character go, and are counted."""
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.concat("text", F.lit("中"))).when(k != 3, F.col("text"))
    kept = content.isNull() | content.rlike(r"[一-鿿]")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("deleted"))


@query("SELECT field, type FROM (VALUES ('doc_id', 'NUMERIC'), ('lang', 'TEXT'), ('even', 'INTEGER'), ('mixed', 'TEXT'), ('tags', 'TEXT')) t(field, type) WHERE (SELECT count(*) FROM documents) > 1")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the fields of ragged JSON rows, with types that hold in every file (here: source)."""
    i = F.col("doc_id")
    even = F.when(i % 3 == 0, F.lit(True))
    json = F.when(F.col("source") == "src1", F.to_json(F.struct("doc_id", "lang", even.alias("even"), F.lit("x").alias("mixed")))).otherwise(F.to_json(F.struct("doc_id", "lang", F.lit(1).alias("mixed"), F.array("lang").alias("tags"))))
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", json.alias("json"))
    return C.schema_union(docs, "source", "doc_id", "json").select("field", "type")


@query("SELECT source AS dataset, count(*) AS source_records, count(*) FILTER (doc_id % 50 <> 0) AS table_rows, count(*) FILTER (doc_id % 50 = 0) = 0 AS matched FROM documents GROUP BY source")
def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ours = docs.where("doc_id % 50 != 0").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("table_rows"))
    theirs = docs.groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("source_records"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("source_records", "table_rows")]
    return theirs.join(ours, "dataset", "full_outer").select("dataset", *zero).withColumn("matched", F.col("source_records") == F.col("table_rows"))


@query("SELECT coalesce(source, 'all') AS dataset, count(*) AS records, count(DISTINCT lang) AS files, count(*) FILTER (n_chars < 100) AS errors FROM documents GROUP BY ROLLUP (source)")
def import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("records"), F.countDistinct("lang").alias("files"), F.count_if(F.col("n_chars") < 100).alias("errors"))
    return stats.select(F.coalesce("source", F.lit("all")).alias("dataset"), "records", "files", "errors")


#: Fields of the catalog: those of documents, and a year that some records give as a number and others as a word.
FIELDS = {"doc_id": "doc_id", "lang": "CASE WHEN source <> 'src1' THEN lang END", "n_chars": "n_chars", "text": "text", "year": "CASE WHEN source = 'src2' AND doc_id % 7 = 0 THEN 'unknown' ELSE CAST(1900 + doc_id % 100 AS STRING) END"}


@query("SELECT dataset, field, CASE WHEN whole THEN 'INTEGER' ELSE 'TEXT' END AS type, field = 'lang' AS added FROM (" + " UNION ALL ".join(f"SELECT source AS dataset, '{name}' AS field, count(v) AS n, bool_and(regexp_full_match(v, '-?[0-9]+')) AS whole FROM (SELECT source, CAST({value} AS VARCHAR) AS v FROM documents) GROUP BY source" for name, value in FIELDS.items()) + ") WHERE n > 0")
def field_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of fields: which dataset has which, their type by all their values, and whether the job added them."""
    rows = table(spark, sf_dir, "documents").select("source", *[F.expr(value).cast("string").alias(name) for name, value in FIELDS.items()])
    fields = C.field_types(rows, "source", list(FIELDS))
    return fields.select(F.col("source").alias("dataset"), "field", "type", (F.col("field") == "lang").alias("added"))


#: Parts of works: the lines of an order; an order whose lines aren't all there isn't whole.
PARTS = "parts AS (SELECT 'orders' AS dataset, l_orderkey AS o, l_linenumber AS part, count(*) OVER (PARTITION BY l_orderkey) AS part_count, l_orderkey * 10 + l_linenumber AS id, l_suppkey, CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 2 THEN 'pending' ELSE 'done' END AS status FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2))"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("part")).agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("flag"))
    status = F.when((F.col("l_orderkey") % 11 == 0) & (F.col("part") == 2), "pending").otherwise("done")
    whole = lines.withColumn("part_count", F.count("*").over(Window.partitionBy("l_orderkey")))
    return whole.select(F.lit("orders").alias("dataset"), (F.col("l_orderkey") * 10 + F.col("part")).alias("id"), "part", "part_count", status.alias("translation_status"), "l_orderkey", "l_suppkey", "flag")


@query(f"WITH {PARTS}, grouped AS (SELECT o, count(*) AS n, min(part) AS low, max(part) AS high, count(*) FILTER (status <> 'done') AS open FROM parts GROUP BY o) SELECT 'orders' AS dataset, o * 10 + 1 AS first_id, n AS rows, CASE WHEN low <> 1 OR high <> n THEN 'parts missing' WHEN open > 0 THEN 'not done' END AS reason FROM grouped")
def validate_split_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validate_split(parts(spark, sf_dir), ["l_orderkey"])


@query("SELECT 'orders:' || (l_orderkey * 10 + 1) AS work_id, list(l_orderkey * 10 + l_linenumber ORDER BY l_linenumber) AS source_row_ids, list(upper(flag) ORDER BY l_linenumber) AS translation, CAST(min_by(supp, l_linenumber) AS VARCHAR) AS title FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS supp, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey")
def assemble_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = parts(spark, sf_dir).select("dataset", "id", "part", F.array("flag").alias("original"), F.array(F.upper("flag")).alias("translation"), F.lit(" ").alias("interpretation"), F.col("l_suppkey").cast("string").alias("title"), F.lit(None).cast("string").alias("author"))
    return C.assemble_works(rows_).select("work_id", "source_row_ids", "translation", "title")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, coalesce(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS q FROM lineitem GROUP BY 1, 2)")
def work_sentence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences a work has before each of its parts."""
    return C.sentence_places(parts(spark, sf_dir).withColumn("sentences", F.col("l_suppkey"))).select("id", F.col("before").cast("long").alias("before"))


@query("SELECT o_orderkey AS work, count(l_linenumber) AS parts, o_orderstatus AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def link_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a work by its key, which each part knows; no range join."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("work")).agg(F.count("*").alias("parts"))
    works = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work"), F.col("o_orderstatus").alias("status"))
    return works.join(counts, "work", "left").select("work", F.coalesce("parts", F.lit(0)).cast("long").alias("parts"), "status")


@query(f"{SENTENCES} SELECT f.dataset, f.source_row_id, f.raw_index, f.normalized_index, sha256(f.original) AS original_sha256, 'doc ' || f.source_row_id AS title FROM found f")
def lookup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence as a hit."""
    return looked_up(spark, sf_dir, found(spark, sf_dir))


@query()
def lookup_hits_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence looked up."""
    return looked_up(spark, sf_dir, found(spark, sf_dir))


def looked_up(spark: SparkSession, sf_dir: str, sentences: DataFrame) -> DataFrame:
    """Hits of a search, looked up again in the rows: the sentence at the normalised place must have the hit's raw place.

    Rows are aligned once and meet the hits sentence by sentence, so that a long row costs no more than its sentences.
    """
    hits = sentences.select("dataset", "source_row_id", "raw_index", "normalized_index")
    own = found(spark, sf_dir).select("dataset", "source_row_id", "normalized_index", F.col("raw_index").alias("raw"), F.sha2("original", 256).alias("original_sha256"))
    joined = hits.join(own, ["dataset", "source_row_id", "normalized_index"]).where("raw = raw_index")
    return joined.select("dataset", "source_row_id", "raw_index", "normalized_index", "original_sha256", F.concat(F.lit("doc "), F.col("source_row_id").cast("string")).alias("title"))


@query(f"{SENTENCES}, keyed AS (SELECT work_id, source_row_id || ':' || raw_index || ':' || normalized_index AS k, original FROM found) SELECT work_id, k AS locator, sha256(original) AS original_sha256 FROM keyed")
def resolve_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original of every sentence."""
    s = found(spark, sf_dir)
    return resolved(s, s)


@query()
def resolve_original_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original of every sentence."""
    s = found(spark, sf_dir)
    return resolved(s, s)


def resolved(s: DataFrame, sentences: DataFrame) -> DataFrame:
    """Originals of hits, by work and locator."""
    key = S.locator_key(F.col("source_row_id"), F.col("raw_index"), F.col("normalized_index")).alias("locator")
    return sentences.select("work_id", key).join(s.select("work_id", key, F.sha2("original", 256).alias("original_sha256")), ["work_id", "locator"])


@query(f"{SENTENCES}, r AS (SELECT dataset || ':' || id AS work_id, kept FROM rows) SELECT f.work_id, count(*) AS locators, count(*) FILTER (list_contains(r.kept, f.original)) AS members FROM found f JOIN r USING (work_id) GROUP BY f.work_id")
def locator_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each locator's original must be a line of its work."""
    works = rows(spark, sf_dir).select(S.work_id(F.col("dataset"), F.col("id")).alias("work_id"), F.transform("content", S.trim_all).alias("lines"))
    return found(spark, sf_dir).join(works, "work_id").groupBy("work_id").agg(F.count("*").alias("locators"), F.count_if(F.array_contains("lines", F.col("original"))).alias("members"))


@query("SELECT doc_id, 'v1:' || source || ':' || doc_id AS name FROM documents WHERE source IN ('src2', 'src4') AND lang = 'en'")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation, and datasets given in any order and more than once; unknown or no datasets are an error."""
    wanted = sorted({"src4", "src2", "src4"})
    docs = table(spark, sf_dir, "documents").withColumn("generation", F.when(F.col("lang") == "en", "v1").otherwise("v0"))
    return docs.where((F.col("generation") == "v1") & F.col("source").isin(*wanted)).select("doc_id", F.concat_ws(":", "generation", "source", F.col("doc_id").cast("string")).alias("name"))


@query(f"{SENTENCES} SELECT dataset, normalized_index >= 0 AND source_row_id > 0 AND raw_index >= normalized_index AS valid, count(*) AS n FROM found GROUP BY ALL")
def validate_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = (F.col("source_row_id") > 0) & (F.col("normalized_index") >= 0) & (F.col("raw_index") >= F.col("normalized_index")) & (S.parse_work_id(F.col("work_id")).isNotNull())
    return found(spark, sf_dir).groupBy("dataset", valid.alias("valid")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, doc_id % 2 = 0 AS second FROM documents UNION ALL SELECT item_id, NULL, NULL FROM benchmark")
def union_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and the benchmark as one stream."""
    return united(spark, sf_dir, table(spark, sf_dir, "documents"))


@query()
def union_datasets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language and the benchmark."""
    return united(spark, sf_dir, table(spark, sf_dir, "documents"))


def united(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """One stream over datasets with different columns."""
    docs = docs.select("doc_id", "lang", (F.col("doc_id") % 2 == 0).alias("second"))
    return docs.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), allowMissingColumns=True)


@query("SELECT source AS dataset, count(*) AS rows, count(*) FILTER (doc_id % 29 = 0 OR doc_id % 31 = 0) AS missing, count(*) FILTER (doc_id % 29 <> 0 AND doc_id % 31 = 0) AS extra FROM documents WHERE source IN ('src5', 'src6') GROUP BY source")
def subset_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen datasets against their copy by row hashes; the copy has lost every 29th row and changed every 31st."""
    docs = table(spark, sf_dir, "documents").where(F.col("source").isin("src5", "src6"))
    copy = docs.where("doc_id % 29 != 0").withColumn("text", F.when(F.col("doc_id") % 31 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    mark = F.xxhash64("doc_id", "text", "lang", "n_chars")
    ours, theirs = docs.groupBy("source", mark.alias("mark")).agg(F.count("*").alias("a")), copy.groupBy("source", mark.alias("mark")).agg(F.count("*").alias("b"))
    both = ours.join(theirs, ["source", "mark"], "full_outer").na.fill(0, ["a", "b"])
    return both.groupBy(F.col("source").alias("dataset")).agg(F.sum("a").alias("rows"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"))


#: Names of the first round for what the queries beside them have done since.
SQL |= {f"{name}_all": SQL[name] for name in ("body_extract", "lookup_hits", "resolve_original", "union_datasets")}
