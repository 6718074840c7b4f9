"""Reconciling stored payloads with canonical ones, field by field and by type.

Payloads are JSON objects. Those that are equal as a whole, in text and types, are left alone; the others are taken apart
into leaves (path, type, value), level by level in columns, and compared by (id, path) in one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers, other numbers, text and so on: 1 and 1.0 are of different types, 1.0 and 1.00 aren't.
NUMBER = r"^(DECIMAL.*|DOUBLE|FLOAT)$"


def nesting(json: Column) -> Column:
    """How deep a JSON text is nested; 0 for a single value."""
    bare = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), start, step, lambda a: a["most"])


def leaves(df: DataFrame, id_: str, payload: str, depth: int) -> DataFrame:
    """(id, path, type, value) of the leaves of variants nested so deep; empty objects and lists are leaves too."""
    level = df.select(F.col(id_), F.lit("$").alias("path"), F.col(payload).alias("v"))
    found: DataFrame | None = None
    for k in range(depth + 1):
        kind = F.schema_of_variant("v")
        inner = F.coalesce(kind.startswith("OBJECT<") & (kind != "OBJECT<>") | kind.startswith("ARRAY<") & (F.to_json("v") != "[]"), F.lit(False))
        own = level.where(~inner).select(id_, "path", F.regexp_replace(F.regexp_replace(F.regexp_replace(kind, NUMBER, "NUMBER"), "^ARRAY.*", "ARRAY"), "^OBJECT.*", "OBJECT").alias("type"), F.to_json("v").alias("value"))
        found = own if found is None else found.unionAll(own)
        if k < depth:
            opened = level.where(inner).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
            step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
            level = opened.select(id_, F.concat("path", step).alias("path"), F.col("value").alias("v"))
    return found


def differences(canonical: DataFrame, stored: DataFrame, id_: str, payload: str, owned: Sequence[str] = (), hashes: Sequence[str] = ()) -> DataFrame:
    """(id, path, kind) of all that is wrong with stored payloads (JSON text), both sides' ids being unique.

    `missing` and `unknown` tell of points (path $) and of fields that one side lacks, `type` and `value` of fields that differ, `owned` of
    fields that another service has put there already, `hash form` of digests that aren't 64 hexadecimal digits; of digests only
    the form counts. `broken` is a stored payload that is no JSON object.
    """
    theirs = F.try_parse_json("theirs")
    both = canonical.select(id_, F.col(payload).alias("ours")).join(stored.select(id_, F.col(payload).alias("theirs"), F.lit(True).alias("is stored")), id_, "full_outer")
    both = both.withColumns({"a": F.parse_json("ours"), "b": theirs})
    whole = F.when(F.col("is stored").isNull(), "missing").when(F.col("ours").isNull(), "unknown").when(~F.coalesce(F.schema_of_variant("b").startswith("OBJECT<"), F.lit(False)), "broken")
    points = both.select(id_, F.lit("$").alias("path"), whole.alias("kind")).where("kind is not null")
    same = (F.to_json("a") == F.to_json("b")) & (F.schema_of_variant("a") == F.schema_of_variant("b"))
    field = lambda name: F.try_variant_get("b", f"$.{name}", "string")
    odd = [F.coalesce(field(h).rlike("^[0-9a-f]{64}$"), F.lit(False)) == F.lit(False) for h in hashes] + [F.try_variant_get("b", f"$.{o}", "variant").isNotNull() for o in owned]
    doubtful = ~same
    for o in odd:
        doubtful |= o
    checked = both.where(whole.isNull() & doubtful)
    depth = checked.agg(F.max(F.greatest(nesting(F.col("ours")), nesting(F.col("theirs")))).alias("d")).first()["d"] or 0
    side = lambda v, name: leaves(checked, id_, v, depth).select(id_, "path", F.lit(name).alias("side"), F.struct("type", "value").alias("leaf"))
    ours, other = (F.max(F.when(F.col("side") == s, F.col("leaf"))).alias(s) for s in ("a", "b"))
    fields = side("a", "a").unionAll(side("b", "b")).groupBy(id_, "path").agg(ours, other)
    top = F.regexp_extract("path", r"^\$\.([^.\[]+)", 1)
    digest = top.isin(*hashes) if hashes else F.lit(False)
    good = F.coalesce((F.col("b.type") == "STRING") & F.col("b.value").rlike('^"[0-9a-f]{64}"$'), F.lit(False))
    kind = (
        F.when(F.col("b").isNotNull() & (top.isin(*owned) if owned else F.lit(False)), "owned")
        .when(F.col("b").isNull() & F.col("a").isNotNull(), "missing")
        .when(digest, F.when(~good, "hash form"))
        .when(F.col("a").isNull(), "unknown")
        .when(F.col("a.type") != F.col("b.type"), "type")
        .when(F.col("a.value") != F.col("b.value"), "value")
    )
    return points.unionAll(fields.select(id_, "path", kind.alias("kind")).where("kind is not null"))
