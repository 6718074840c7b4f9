"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: sources in code point order (null last) have the weights 5, 2, 1, repeating, and share
1.5 times the words of all documents; a target stops at 2 times its source's size, and what is over
is shared again by weight until no target is above. The level at which the rest stands (target =
level * weight) is found by repeating one aggregate over the table of sources.

Rounding: every document of a source should be taken target / source_size times. The whole part is
taken at once. The fractions are rounded in pairs: words are moved at random, without bias, from one
document's expected share to the other's until one of the two has a fraction of 0 or 1, so that the
source's expected words stay the same. Documents are dealt to blocks of about 128 by a hash; each
block ends with one fraction at most, and these are blocked again, level after level, until each
source has one left, which is rounded to the nearer side. So a source misses its target by no more
than half of one document.

All chance comes from hashes of ids and texts: reruns agree, whatever the partitions. A null text has
no words; documents without words are taken 0 words. Null and repeated ids are told apart by their
text; rows that are equal in both are interchangeable. Very long texts count whole, and a document larger than its source's
target is rounded like others. An empty table gives an empty result; columns other than doc_id, source and text are kept whatever their names.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusjobs.llm.common import checkpointed, let, small, words

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK = 128
NEAR = 1e-9
ITEM = "struct<big:bigint,h:bigint,doc_id:bigint,size:bigint,whole:bigint,p:double>"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash that tells rows apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text").cast("string"))).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("h"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs (with words), weight and target of each source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    placed = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before, start = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        start += [F.lit(r["part"]), F.lit(before)]
        before += r["n"]
    if not start:
        return placed.select("source", "source_size", "n_docs", F.lit(0).alias("weight"), F.lit(0.0).alias("target"))
    rank = F.create_map(*start)[part] + F.col("place").bitwiseAND(2**33 - 1)
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", F.col("source_size") * MOST)
    first = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total, level, full = SHARE * first["words"], SHARE * first["words"] / first["weight"], -1
    while True:
        under = F.col("cap") > level * F.col("weight")
        now = weighed.agg(F.sum(F.when(under, F.col("weight"))).alias("weight"), F.sum(F.when(~under, F.col("cap"))).alias("capped"), F.count_if(~under).alias("full")).first()
        if now["full"] == full or not now["weight"]:
            break
        full, level = now["full"], (total - (now["capped"] or 0.0)) / now["weight"]
    return weighed.select("source", "source_size", "n_docs", "weight", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def chance(*parts: Column) -> Column:
    """A number in [0, 1) that the parts determine."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**53)) / F.lit(float(2**53))


def pivoted(items: Column, level: int, last: bool) -> Column:
    """(done, held): the items whose fraction p became 0 or 1, and the one left over, by pairing one after the other."""

    def snapped(p: Column) -> Column:
        return F.when(p < NEAR, 0.0).when(p > 1 - NEAR, 1.0).otherwise(p)

    def with_p(item: Column, p: Column) -> Column:
        return F.struct(*[item[k].alias(k) for k in ("big", "h", "doc_id", "size", "whole")], p.alias("p")).cast(ITEM)

    def pair(a: Column, b: Column) -> Column:
        """The new fractions of both."""
        room_a, mass_a = a["size"] * (1 - a["p"]), a["size"] * a["p"]
        room_b, mass_b = b["size"] * (1 - b["p"]), b["size"] * b["p"]
        up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)
        to_a = chance(a["h"], b["h"], F.lit(level)) * (up + down) < down
        new_a = F.when(to_a, F.when(room_a <= mass_b, 1.0).otherwise(a["p"] + up / a["size"])).otherwise(F.when(mass_a <= room_b, 0.0).otherwise(a["p"] - down / a["size"]))
        new_b = F.when(to_a, F.when(mass_b <= room_a, 0.0).otherwise(b["p"] - up / b["size"])).otherwise(F.when(room_b <= mass_a, 1.0).otherwise(b["p"] + down / b["size"]))
        return F.struct(snapped(new_a).alias("a"), snapped(new_b).alias("b"))

    def fraction(p: Column) -> Column:
        return (p > 0) & (p < 1)

    nothing, none = F.array().cast(f"array<{ITEM}>"), F.lit(None).cast(ITEM)

    def moved(acc: Column, item: Column) -> Column:
        held = acc["held"]
        both = let(pair(held, item), lambda n: let(F.array(with_p(held, n["a"]), with_p(item, n["b"])), lambda two: F.struct(F.concat(acc["done"], F.filter(two, lambda x: ~fraction(x["p"]))).alias("done"), F.get(F.filter(two, lambda x: fraction(x["p"])), F.lit(0)).alias("held"))))
        return F.when(held.isNull(), F.struct(acc["done"].alias("done"), item.alias("held"))).otherwise(both)

    found = F.aggregate(items, F.struct(nothing.alias("done"), none.alias("held")), moved)
    if not last:
        return found
    return let(found, lambda f: F.struct(F.when(f["held"].isNull(), f["done"]).otherwise(F.concat(f["done"], F.array(with_p(f["held"], F.when(f["held"]["p"] >= 0.5, 1.0).otherwise(0.0))))).alias("done"), none.alias("held")))


def mix(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, and h and copies (how often it is taken)."""
    sizes = checkpointed(sized(docs))
    by_source = checkpointed(targets(sizes)).withColumnRenamed("source", "of")
    rows = sizes.join(small(by_source), F.col("source").eqNullSafe(F.col("of")))
    each = F.when(F.col("size") == 0, 0.0).when(F.col("target") >= F.col("source_size") * MOST, MOST).otherwise(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rows = rows.withColumn("whole", F.floor(each)).withColumn("p", each - F.floor(each)).withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK))
    fractional = (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR)
    common = ["source", "source_size", "target", "blocks"]
    item = F.struct((-F.col("size")).alias("big"), "h", "doc_id", "size", "whole", "p").cast(ITEM).alias("item")
    out = [rows.where(~fractional).select("source_size", "target", F.struct((-F.col("size")).alias("big"), "h", "doc_id", "size", "whole", F.round("p").alias("p")).cast(ITEM).alias("item"))]
    left = rows.where(fractional).select(*common, item)
    blocks, level = ceil((by_source.agg(F.max("n_docs")).first()[0] or 0) / BLOCK), 0
    while True:
        dealt = left.withColumn("block", F.pmod(F.xxhash64("item.h", F.lit(level)), F.greatest("blocks", F.lit(1))))
        grouped = dealt.groupBy(*common, "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        done = checkpointed(grouped.select(*common, pivoted(F.col("items"), level, blocks <= 1).alias("found")))
        out.append(done.select("source_size", "target", F.explode("found.done").alias("item")))
        if blocks <= 1:
            break
        left = done.where("found.held is not null").select("source", "source_size", "target", F.ceil(F.col("blocks") / BLOCK).alias("blocks"), F.col("found.held").alias("item"))
        blocks, level = ceil(blocks / BLOCK), level + 1
    mixed = out[0]
    for more in out[1:]:
        mixed = mixed.unionAll(more)
    copies = F.col("item.whole") + F.col("item.p").cast("long")
    return mixed.select("item.doc_id", "item.size", "source_size", "target", (copies * F.col("item.size")).alias("taken"), "item.h", copies.alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix has them: each row as often as it is taken, with its own columns."""
    picks = checkpointed(mix(docs).groupBy("doc_id", "h").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own id"), F.xxhash64("doc_id", "text").alias("own h"))
    joined = own.join(small(picks), F.col("own id").eqNullSafe(F.col("doc_id")) & (F.col("own h") == F.col("h")))
    several = joined.where("rows > 1") if picks.where("rows > 1").limit(1).count() else None
    if several is not None:  # rows that are equal in id and text share their copies, as evenly as can be
        place = F.row_number().over(Window.partitionBy("own id", "own h").orderBy(F.xxhash64("row")))
        joined = joined.where("rows = 1").unionByName(several.withColumn("copies", F.floor((F.col("copies") + F.col("rows") - place) / F.col("rows"))).where("copies > 0"))
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
