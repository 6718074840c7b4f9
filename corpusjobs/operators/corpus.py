"""Records, sentences and works: DataFrame in, DataFrame out.

Rows that break a rule aren't dropped: they come back in a second DataFrame with a reason, and strict
callers raise on it (`require`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusjobs.functions import scalars as S
from corpusjobs.operators import ordered

STATUS = {"translation": "array<string>", "interpretation": "string", "translation_status": "string", "translation_error": "string", "translated_at": "timestamp", "translation_retry_count": "int"}


def require(bad: DataFrame, what: str) -> None:
    """Raises with the first reasons if there are bad rows."""
    found = bad.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Columns under names of letters, digits and underscores; `id` becomes original_id."""
    import re

    def clean(name: str) -> str:
        new = "original_id" if name == "id" else re.sub(r"[^\w]", "_", name)
        return f"f_{new}" if new[:1].isdigit() else new

    return df.toDF(*[clean(c) for c in df.columns])


def add_status_columns(df: DataFrame) -> DataFrame:
    """The status columns that are missing: pending, and no retries."""
    start = {"translation_status": F.lit("pending"), "translation_retry_count": F.lit(0)}
    return df.withColumns({c: start.get(c, F.lit(None)).cast(t) for c, t in STATUS.items() if c not in df.columns})


def body_lines(df: DataFrame, content: str, *order: str) -> DataFrame:
    """A row for each line of the content arrays: the order columns, line (its place), text."""
    return df.select(*order, F.posexplode(content).alias("line", "text"))


def assign_row_ids(df: DataFrame, file: str, pos: str) -> DataFrame:
    """Dense ids 1..n in (file, pos) order; rows are counted in ranges of that order, so that a large file lies in many tasks."""
    return ordered.running(df, [], [file, pos], {"id": F.lit(1)})


def split_long(df: DataFrame, content: str, most_lines: int, most_chars: int, aligned: tuple[str, ...] = ()) -> DataFrame:
    """A row for each greedy part of the content, with content_part and content_part_count; aligned arrays are cut alike."""
    spans = F.when(F.size(content) > 0, S.chunk_lines(F.col(content), most_lines, most_chars)).otherwise(F.array(F.struct(F.lit(1).alias("from"), F.lit(0).alias("to"))))
    parts = df.withColumn("spans", spans).select("*", F.posexplode("spans").alias("part", "span"))
    cut = {c: F.slice(c, F.col("span.from"), F.col("span.to") - F.col("span.from") + 1) for c in (content, *aligned)}
    return parts.withColumns(cut | {"content_part": (F.col("part") + 1).cast("long"), "content_part_count": F.size("spans").cast("long")}).drop("spans", "part", "span")


def prepend_punctuated_title(title: Column, content: Column) -> Column:
    """A title that reads like a verse goes before the content."""
    return F.when(title.rlike("[，。！？；]"), F.concat(F.array(title), content)).otherwise(content)


def expand_objects(df: DataFrame, levels: tuple[str, ...], inherit: dict[str, str]) -> DataFrame:
    """One row for each innermost object of nested lists of structs; inherited columns fill what a leaf lacks.

    `levels` names the list at each depth; inherit maps a parent's field to the leaf's name for it.
    """
    out = df
    for name in levels:
        parents = [c for c in out.columns if c != name]
        out = out.select(*[F.col(c).alias(inherit.get(c, c)) for c in parents], F.explode(name).alias("child"))
        fields = out.schema["child"].dataType.names
        kept = [c for c in out.columns if c not in ("child", *fields)]
        own = [F.coalesce(F.col(f"child.{f}"), F.col(f)).alias(f) if f in out.columns else F.col(f"child.{f}").alias(f) for f in fields]
        out = out.select(*kept, *own)
    return out


def require_content(df: DataFrame, content: str) -> tuple[DataFrame, DataFrame]:
    """Rows with content, and those without it and the reason."""
    missing = F.col(content).isNull()
    return df.where(~missing), df.where(missing).withColumn("reason", F.lit(f"no {content}"))


def pending(df: DataFrame, most_retries: int | None = None, after: int | None = None) -> DataFrame:
    """Rows to translate: without status or pending, or failed fewer times than allowed."""
    retry = F.coalesce("translation_retry_count", F.lit(0)) < most_retries if most_retries is not None else F.lit(True)
    wanted = F.coalesce("translation_status", F.lit("pending")) == "pending"
    found = df.where(wanted | (F.col("translation_status") == "failed") & retry)
    return found.where(F.col("id") > after) if after is not None else found


def recycle(df: DataFrame, reason: str) -> DataFrame:
    """Rows that were being translated are pending again."""
    stuck = F.col("translation_status") == "processing"
    return df.withColumns({"translation_error": F.when(stuck, reason).otherwise(F.col("translation_error")), "translation_status": F.when(stuck, "pending").otherwise(F.col("translation_status"))})


def apply_outcomes(df: DataFrame, outcomes: DataFrame, cap: int) -> DataFrame:
    """Writes outcomes (dataset, id, outcome, lines, note) into the status columns; failures count up to the cap."""
    joined = df.join(outcomes, ["dataset", "id"], "left")
    o, retries = F.col("outcome"), F.coalesce("translation_retry_count", F.lit(0)) + 1
    failed = F.when(retries >= cap, F.concat(F.lit("given up: "), F.col("note"))).otherwise(F.col("note"))
    return joined.withColumns(
        {
            "translation": F.when(o == "done", F.col("lines")).otherwise(F.col("translation")),
            "translation_error": F.when(o == "done", F.lit(None)).when(o == "skipped", F.col("note")).when(o == "failed", failed).otherwise(F.col("translation_error")),
            "translation_retry_count": F.when(o == "failed", retries).otherwise(F.col("translation_retry_count")),
            "translation_status": F.coalesce(o, "translation_status"),
        }
    ).drop("outcome", "lines", "note")


def aligned(rows: DataFrame, content: str = "content", translation: str = "translation") -> DataFrame:
    """rows with `reason` and `pairs` of their lines and translations."""
    return rows.withColumn("found", S.align_pairs(F.col(content), F.col(translation))).select("*", "found.reason", "found.pairs").drop("found")


def sentences(rows: DataFrame, first_row: Column | None = None) -> DataFrame:
    """A row for each indexable pair: dataset, source_row_id, raw_index, normalized_index, work_id, original, translation.

    Pairs without a letter or number go after the places are given.
    """
    first = F.col("id") if first_row is None else first_row
    # No filter before the rows are made (and none inferred from an inner inline): it would align the lines again.
    told = F.inline_outer(F.when(F.col("reason").isNull(), F.col("pairs")))
    pairs = rows.select("dataset", F.col("id").alias("source_row_id"), S.work_id(F.col("dataset"), first).alias("work_id"), told)
    return pairs.where(S.indexable(F.col("original"), F.col("translation"))).select("dataset", "source_row_id", F.col("raw").alias("raw_index"), F.col("norm").alias("normalized_index"), "work_id", "original", "translation")


def validate_split(rows: DataFrame, identity: list[str]) -> DataFrame:
    """(dataset, first_id, rows, reason) of each work of several parts; reason is null for whole works."""
    n = len(identity)
    own = rows.select("dataset", (F.col("id") - F.col("part") + 1).alias("first_id"), "part", "part_count", F.coalesce("translation_status", F.lit("")).alias("status"), *[F.col(c).alias(f"i{k}") for k, c in enumerate(identity)])
    spread = lambda low, high, known: [f(c(k)).alias(f"{name}{k}") for k in range(n) for name, f, c in (("low", F.min, low), ("high", F.max, high), ("known", *known))]
    # Copies of a part are brought together first: distinct counts would make a row of each for every one of them.
    by_part = own.groupBy("dataset", "first_id", "part").agg(F.count("*").alias("rows"), F.min("part_count").alias("least"), F.max("part_count").alias("most"), F.count_if(F.col("status") != "done").alias("open"), *spread(lambda k: f"i{k}", lambda k: f"i{k}", (F.count, lambda k: f"i{k}")))
    grouped = by_part.groupBy("dataset", "first_id").agg(
        F.sum("rows").alias("rows"), F.count("part").alias("parts"), F.min("part").alias("low"), F.max("part").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.sum("open").alias("open"), *spread(lambda k: f"low{k}", lambda k: f"high{k}", (F.sum, lambda k: f"known{k}")),
    )
    differs = [~F.col(f"low{k}").eqNullSafe(F.col(f"high{k}")) | F.col(f"known{k}").between(1, F.col("rows") - 1) for k in range(n)]
    reason = (
        F.when(F.col("least") != F.col("most"), "counts differ")
        .when((F.col("rows") != F.col("most")) | (F.col("parts") != F.col("rows")) | (F.col("low") != 1) | (F.col("high") != F.col("rows")), "parts missing")
        .when(F.col("open") > 0, "not done")
        .when(reduce(Column.__or__, differs, F.lit(False)), "identity differs")
    )
    return grouped.select("dataset", "first_id", "rows", reason.alias("reason"))


def assemble_works(rows: DataFrame) -> DataFrame:
    """Works from their parts: lines, translations, row ids and interpretations in order; title and author of the first part that has them."""

    def ordered(*values: str) -> Column:
        return F.sort_array(F.collect_list(F.struct("part", *values)))

    grouped = rows.groupBy("dataset", (F.col("id") - F.col("part") + 1).alias("first_id")).agg(ordered("id", "original", "translation", "interpretation", "title", "author").alias("parts"))

    def filled(field: str) -> Column:
        return F.get(F.filter(F.transform("parts", lambda p: S.trim_all(p[field])), lambda x: x != ""), F.lit(0))

    return grouped.select(
        S.work_id(F.col("dataset"), F.col("first_id")).alias("work_id"), "dataset", F.coalesce(filled("title"), "dataset").alias("title"), filled("author").alias("author"),
        F.flatten(F.transform("parts", lambda p: p["original"])).alias("original"), F.flatten(F.transform("parts", lambda p: p["translation"])).alias("translation"),
        F.transform("parts", lambda p: p["id"]).alias("source_row_ids"), F.filter(F.transform("parts", lambda p: S.trim_all(p["interpretation"])), lambda x: x != "").alias("interpretations"),
    )


def work_locators(found: DataFrame) -> DataFrame:
    """(work_id, locators): a map of locator keys to originals; a key that occurs twice is an error."""
    key = S.locator_key(F.col("source_row_id"), F.col("raw_index"), F.col("normalized_index"))
    return found.groupBy("work_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), F.col("original").alias("value"))))).alias("locators"))


def sentence_places(rows: DataFrame) -> DataFrame:
    """rows (dataset, id, part, sentences) with `before`: the sentences of the work's earlier parts."""
    w = Window.partitionBy("dataset", F.col("id") - F.col("part")).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("sentences").over(w), F.lit(0)))


def schema_union(rows: DataFrame, file: str, pos: str, json: str) -> DataFrame:
    """(field, type, place) over ragged JSON objects: the type of a file is that of its first value; files that differ make TEXT."""
    fields = rows.select(file, pos, F.posexplode(F.json_object_keys(json)).alias("at", "field"), F.try_parse_json(json).alias("v"))
    kinds = rows.select(file, pos, F.explode(F.transform_values(F.from_json(json, "map<string,variant>"), lambda _, v: F.schema_of_variant(v))).alias("field", "kind"))
    sql = F.when(F.col("kind") == "BOOLEAN", "INTEGER").when(F.col("kind").rlike("^(BIGINT|DOUBLE|DECIMAL)"), "NUMERIC").otherwise("TEXT")
    by_file = kinds.groupBy(file, "field").agg(F.min_by(sql, pos).alias("type"))
    place = fields.groupBy("field").agg(F.min(F.struct(file, pos, "at")).alias("place"))
    return by_file.groupBy("field").agg(F.when(F.countDistinct("type") > 1, "TEXT").otherwise(F.min("type")).alias("type")).join(place, "field")


def field_types(rows: DataFrame, dataset: str, fields: list[str]) -> DataFrame:
    """(dataset, field, type) of the fields that a dataset has a value of: INTEGER if all its values are whole numbers, else TEXT."""
    of = lambda c: F.struct(F.lit(c).alias("field"), F.count(c).alias("n"), F.bool_and(F.col(c).rlike(r"^-?[0-9]+\z")).alias("whole"))
    seen = rows.groupBy(dataset).agg(*[of(c).alias(f"of {c}") for c in fields])
    return seen.select(dataset, F.inline(F.array(*[F.col(f"`of {c}`") for c in fields]))).where("n > 0").select(dataset, "field", F.when(F.col("whole"), "INTEGER").otherwise("TEXT").alias("type"))
