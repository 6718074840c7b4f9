"""Small batches against large tables: Bloom filters before exact joins, and trees of digests that lead to the rows that differ.

A Bloom filter here is a table of blocks, each 512 longs; a key has one block and some bits in it, so that a look-up joins one row. It is built from the
smaller side with `bit_or`, broadcast while its size allows, and tells of most rows of the larger side that they can't have a
partner. Only the others are shuffled, and an exact join decides on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each key, bits that a key sets, bits of a block.
BITS, HASHES, BLOCK = 12, 6, 32_768
#: Keys up to which a filter is broadcast: 60 MB. Beyond, both sides are of like size, and the exact join stands alone.
MOST_KEYS = 40_000_000


def places(key: Column) -> list[Column]:
    """The bits of a key in its block."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BLOCK)) for k in range(HASHES)]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, words) of the keys."""
    bits = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.explode(F.array(*places(F.col(key)))).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    words = bits.groupBy("block", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask"))
    found = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("set"))
    return found.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda w: F.coalesce(F.try_element_at("set", w), F.lit(0).cast("long"))).alias("words"))


def told_apart(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with `maybe`: false only for those whose key none of `keys` has; always true if the filter would be too large. A null key has no partner."""
    n = keys.count()
    if n > MOST_KEYS:
        return rows.withColumn("maybe", F.col(key).isNotNull())
    blocks = max(1, -(-n * BITS // BLOCK))
    held = bloom(keys.select(key), key, blocks).withColumnRenamed("block", "block of key")
    joined = rows.join(F.broadcast(held), F.pmod(F.xxhash64(key), F.lit(blocks)) == F.col("block of key"), "left")
    found = F.lit(True)
    for p in places(F.col(key)):
        found &= F.getbit(F.get("words", F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
    return joined.select(*rows.columns, (F.col(key).isNotNull() & F.coalesce(found, F.lit(False))).alias("maybe"))


def lacking(new: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows of a batch whose key a large table lacks; of the table only keys that the batch may have are shuffled."""
    near = told_apart(table.select(key), new, key).where("maybe").select(key)
    return new.join(near, key, "left_anti")


def upserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A large table with a batch's rows in place of those with their keys (of repeated keys one stays); rows that no key of the batch may have aren't shuffled."""
    new = new.dropDuplicates([key])
    marked = told_apart(table, new, key)
    kept = marked.where("maybe").drop("maybe").join(new.select(key), key, "left_anti")
    return marked.where("not maybe").drop("maybe").unionByName(kept.select(*table.columns)).unionByName(new.select(*table.columns))


#: Digits of a key's digest that name a place: those of folders, then those of leaves.
LEVELS = (2, 4, 6)


def write_with_digests(rows: DataFrame, path: str, key: str, digest: str) -> None:
    """Writes rows in 256 folders by their key's place, and beside them the digests of all places, level by level."""
    placed = rows.withColumn("place", F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256))
    placed.withColumn("folder", F.concat(F.lit("p"), F.left("place", F.lit(LEVELS[0])))).repartition("folder").write.partitionBy("folder").parquet(f"{path}/rows")
    spark = rows.sparkSession
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda p: p["h"]), ""), 256)
    level = spark.read.parquet(f"{path}/rows").select("place", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.coalesce(F.col(digest), F.lit("null"))), 256).alias("h"))
    for digits in reversed(LEVELS):
        level.groupBy(F.left("place", F.lit(digits)).alias("at")).agg(whole.alias("h")).withColumnRenamed("at", "place").write.parquet(f"{path}/digests/{digits}")
        level = spark.read.parquet(f"{path}/digests/{digits}")


def differing(spark: SparkSession, a: str, b: str) -> tuple[list[str], DataFrame]:
    """The folders, and the leaves, whose digests differ between two tables; a level is read only below places that differ above."""
    folders: list[str] | None = None
    above: DataFrame | None = None
    for digits in LEVELS:
        sides = []
        for name, path in (("a", a), ("b", b)):
            one = spark.read.parquet(f"{path}/digests/{digits}").select("place", F.col("h").alias(name))
            sides.append(one if above is None else one.join(F.broadcast(above), F.left("place", F.lit(len_above)) == F.col("up"), "left_semi"))
        odd = sides[0].join(sides[1], "place", "full_outer").where("not (a <=> b)").select("place")
        if folders is None:
            folders = sorted(r["place"] for r in odd.collect())  # 256 at most
            odd = odd.where(F.col("place").isin(folders))
        above, len_above = odd.select(F.col("place").alias("up")), digits
    return folders or [], above


def difference(spark: SparkSession, a: str, b: str, key: str, digest: str) -> DataFrame:
    """(key, a, b): digests of the rows that two tables written with digests don't share, read from leaves that differ only; unique keys."""
    folders, leaves = differing(spark, a, b)
    names = [f"p{f}" for f in folders]

    def side(path: str, name: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/rows").where(F.col("folder").isin(names) if names else F.lit(False))
        return rows.join(leaves, F.left("place", F.lit(LEVELS[-1])) == F.col("up"), "left_semi").select(key, F.col(digest).alias(name), F.lit(True).alias(f"in {name}"))

    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    return both.where("not (a <=> b) or `in a` is null or `in b` is null").select(key, "a", "b", F.coalesce("in a", F.lit(False)).alias("in a"), F.coalesce("in b", F.lit(False)).alias("in b"))
