"""Reading and writing: the dataset registry, JSON files, logs, manifests; tables that are replaced are in versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.operators.search import point_reason

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
REGISTRY = "name string, id long, path string, tag string, excludes array<string>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The datasets of a registry file; none, or a name that is no identifier, is an error. A missing name is the table's."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<datasets:map<string,struct<name:string,id:bigint,path:string,tag:string,excludes:array<string>>>>", {"mode": "FAILFAST"}).alias("r"))
    found = whole.select(F.explode("r.datasets").alias("table", "d")).select("table", F.coalesce("d.name", "table").alias("name"), "d.id", "d.path", "d.tag", F.coalesce("d.excludes", F.array().cast("array<string>")).alias("excludes"))
    names = [r["table"] for r in found.select("table").collect()]  # a registry is a small file
    if not names:
        raise ValueError("the registry has no datasets")
    if bad := [n for n in names if not IDENTIFIER.fullmatch(n)]:
        raise ValueError(f"not identifiers: {bad}")
    return found


def scan_corpus_files(spark: SparkSession, path: str, excludes: list[str] | None = None) -> DataFrame:
    """(file, value): the JSON files of a dataset, whole; a directory's direct children without the excluded names."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.where(~F.col("file").isin(*excludes)) if excludes else files


def read_json_records(files: DataFrame) -> DataFrame:
    """(file, pos, json): the objects of each file's array in order; a file that isn't such an array fails."""
    checked = files.withColumn("v", F.parse_json("value")).withColumn("kind", F.schema_of_variant("v"))
    array = F.when(F.col("kind").startswith("ARRAY"), F.from_json("value", "array<string>")).otherwise(F.raise_error(F.concat(F.lit("no array in "), F.col("file"))).cast("array<string>"))
    return checked.select("file", F.posexplode(array).alias("pos", "json"))


def write_manifest(df: DataFrame, path: str, id_: str) -> None:
    """JSON lines in id order, in as many files as there are ranges."""
    df.repartitionByRange(id_).sortWithinPartitions(id_).write.mode("errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str, id_: str) -> DataFrame:
    """A manifest read back; a line that doesn't fit, or an id that occurs twice, fails."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    twice = df.groupBy(id_).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"twice in the manifest: {twice[0][0]}")
    return df


def read_points(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """Stored points (point_id, vector, dataset, row, work_id and more) with `reason`: why a point isn't valid, `twice` for an id of several points, or null."""
    points = spark.read.parquet(path)
    times = points.groupBy("point_id").agg(F.count("*").alias("times"))
    own = point_reason(F.col("point_id"), F.col("vector"), dimensions, F.col("dataset"), F.col("row"), F.col("work_id"))
    reason = F.coalesce(own, F.when(F.col("times") > 1, "twice"))
    return points.join(times, "point_id", "left").withColumn("reason", reason).drop("times")


def read_metric_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Host samples of JSON lines; a line that doesn't fit the schema is in `broken`, which is null for all others."""
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)


def write_field_catalog(fields: DataFrame, path: str, added: list[str]) -> None:
    """The catalog of (field, type) as JSON lines under a new path: which fields the job added, and whether the records had an id of their own."""
    own = F.col("field") == "original_id"
    fields.select("field", "type", F.col("field").isin(*added).alias("added"), own.alias("original_id")).write.mode("errorifexists").json(path)


def parse_access_log(lines: DataFrame) -> DataFrame:
    """(peer, time, path, status) of access-log lines; lines of another shape are left out."""
    pattern = r'^(\S+) - - \[([^\]]+)\] "GET (\S+) HTTP/\S+" (\d{3})'
    part = lambda k: F.regexp_extract("value", pattern, k)
    return lines.where(F.col("value").rlike(pattern)).select(part(1).alias("peer"), part(2).alias("time"), part(3).alias("path"), part(4).cast("int").alias("status"))


def validate_schema(df: DataFrame, tag: str) -> None:
    """Fails unless the rows have id, content, translation and status, and both split columns or neither."""
    missing = {"id", tag, "translation", "translation_status"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    if ("content_part" in df.columns) != ("content_part_count" in df.columns):
        raise ValueError("content_part and content_part_count go together")


def write_works_export(works: DataFrame, metadata: DataFrame, path: str) -> None:
    """Works and their metadata under a new path; an existing one is an error."""
    works.write.mode("errorifexists").parquet(f"{path}/works")
    metadata.write.mode("errorifexists").parquet(f"{path}/metadata")
