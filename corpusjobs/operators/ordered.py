"""Windows in one global order, or in groups of which one may hold most rows: ranges of rows, and what is carried over their borders.

Rows are dealt into ranges of their order, so that a large group lies in many of them, and written once, since ranges are drawn from
a sample and must not change. A task sees a range. What it needs of those before is small: sums, or the last few rows of a
group that goes on; there are no more such groups than ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusjobs.sources.shared import scratch, shared_dir


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `part`, the number of its range; rows of later ranges come later in the order."""
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def heads(parts: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """(part, by, totals of what earlier ranges hold of the group, `earlier` and `later`: how many ranges do): a row for each range that a group comes to from another one, or leaves for one."""
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy("part")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    found = parts.groupBy("part", *by).agg(*[F.sum(c).alias(k) for k, c in totals.items()])
    kept = found.select("part", *by, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in totals], F.count("*").over(before).alias("earlier"), F.count("*").over(after).alias("later"))
    return kept.where("earlier > 0 or later > 0")


def running(df: DataFrame, by: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """df with running totals of its groups (in place of columns of their names), the row itself included; rows of a group differ in the order's columns."""
    parts = ranged(df, [*by, *order])
    carried = heads(parts, by, totals).where("earlier > 0").select(F.col("part").alias("in part"), *[F.col(c).alias(f"{c} of") for c in by], *[F.col(k).alias(f"{k} before") for k in totals])
    w = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumns({k: F.sum(c).over(w) for k, c in totals.items()})
    match = own["part"] == carried["in part"]
    for c in by:
        match &= own[c].eqNullSafe(carried[f"{c} of"])
    joined = own.join(F.broadcast(carried), match, "left")  # a row for each range at most
    return joined.select(*[c for c in df.columns if c not in totals], *[(F.col(k) + F.coalesce(F.col(f"{k} before"), F.lit(0))).alias(k) for k in totals])


def with_halo(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """df with `part`, and in each range also the n last rows before it of the group that it goes on with, told by `halo`.

    So a window of n + 1 rows over (part, by) in the order is right for all rows that aren't of the halo.
    """
    parts = ranged(df, [*by, *order])
    known = heads(parts, by, {"rows before": F.lit(1)})
    w = Window.partitionBy("part", *by)
    numbered = parts.withColumns({"k": F.row_number().over(w.orderBy(*order)), "size": F.count("*").over(w)}).where(F.col("size") - F.col("k") < n)
    left = known.where("later > 0").select(F.col("part").alias("in part"), *[F.col(c).alias(f"{c} of") for c in by], "rows before")
    going = known.where("earlier > 0").select(F.col("part").alias("to part"), *[F.col(c).alias(f"{c} to") for c in by], (F.col("rows before") + 1).alias("first"))
    match, meets = numbered["part"] == left["in part"], F.lit(True)
    for c in by:
        match &= numbered[c].eqNullSafe(left[f"{c} of"])
        meets &= F.col(c).eqNullSafe(F.col(f"{c} to"))
    place = F.col("rows before") + F.col("k")
    tails = numbered.join(F.broadcast(left), match).select(*df.columns, F.explode(F.sequence(place + 1, place + n)).alias("first of"))
    halo = tails.join(F.broadcast(going), meets & (F.col("first of") == F.col("first")))
    return parts.select(*df.columns, "part", F.lit(False).alias("halo")).unionAll(halo.select(*df.columns, F.col("to part"), F.lit(True)))


#: Rows of a block within which the starts of batches are followed.
BLOCK = 4_096


def batches(rows: DataFrame, id_: str, size: str, most_rows: int = 128, most_bytes: int = 1_048_576) -> DataFrame:
    """(id, size, batch): greedy batches in the order of unique ids, numbered from 0; a row over the limit fails, a null size is 0.

    Running sums tell each row which one would follow the batch that starts with it. These pointers are doubled within blocks of rows, giving for
    each of the first `most_rows` rows of a block where a batch that starts there leaves it; doubling these over the blocks from
    the first row tells where batches start in each block.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    bytes_ = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    own = rows.select(F.col(id_), F.when(bytes_ > most_bytes, F.raise_error(F.lit("a row is larger than a batch may be")).cast("long")).otherwise(bytes_).alias(size))
    placed = running(own, [], [id_], {"place": F.lit(1), "upto": F.col(size)}).checkpoint()
    ends = placed.select(F.col("upto").alias("value"), F.lit(0).alias("asks"), F.col("place").alias("of"))
    asks = placed.select((F.col("upto") - F.col(size) + most_bytes).alias("value"), F.lit(1).alias("asks"), F.col("place").alias("of"))
    seen = running(ends.unionAll(asks), [], ["value", "asks", "of"], {"fit": 1 - F.col("asks")}).where("asks = 1")
    follow = seen.select(F.col("of").alias("place"), F.least(F.col("fit") + 1, F.col("of") + most_rows).alias("next"))
    block, at = F.floor((F.col("place") - 1) / BLOCK), F.col("place") - BLOCK * F.floor((F.col("place") - 1) / BLOCK)
    steps = follow.select(block.alias("block"), at.alias("at"), (F.col("next") - BLOCK * block).alias("next")).groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "next"))), lambda s: s["next"]).alias("next")).checkpoint()
    count = steps.count()
    rounds = F.sequence(F.lit(1), F.lit(BLOCK.bit_length()))
    jump = lambda next_, p: F.when(p <= F.size(next_), F.element_at(next_, F.least(p, F.size(next_)).cast("int"))).otherwise(p)
    leaves = F.aggregate(rounds, F.col("next"), lambda j, _: F.transform(j, lambda p: jump(j, p)))
    doors = steps.select("block", F.posexplode(F.slice(leaves, 1, most_rows)).alias("door", "out")).select("block", (F.col("door") + 1).cast("long").alias("door"), (F.col("block") + 1).alias("to"), (F.col("out") - BLOCK).alias("at"))
    reached = spark.createDataFrame([(0, 1)], "block long, door long").checkpoint()
    while reached.count() < count:
        doors = doors.checkpoint()
        new = reached.join(doors, ["block", "door"]).select(F.col("to").alias("block"), F.col("at").alias("door"))
        reached = reached.unionAll(new).where(F.col("block") < count).distinct().checkpoint()
        onward = doors.select(F.col("block").alias("to"), F.col("door").alias("at"), F.col("to").alias("far"), F.col("at").alias("there"))
        doors = doors.join(onward, ["to", "at"]).select("block", "door", F.col("far").alias("to"), F.col("there").alias("at"))
    start = F.struct(F.col("next").alias("j"), F.array("door").alias("r"))

    def twice(a: Column, _: Column) -> Column:
        more = F.filter(F.transform(a["r"], lambda p: jump(a["j"], p)), lambda p: p <= F.size(a["j"]))
        return F.struct(F.transform(a["j"], lambda p: jump(a["j"], p)).alias("j"), F.array_union(a["r"], more).alias("r"))

    starts = steps.join(reached, "block").select("block", F.explode(F.aggregate(rounds, start, twice, lambda a: a["r"])).alias("at"))
    marks = starts.select((F.col("block") * BLOCK + F.col("at")).alias("place"), F.lit(1).alias("starts"))
    flagged = placed.join(marks, "place", "left").select(id_, size, "place", F.coalesce("starts", F.lit(0)).alias("starts"))
    return running(flagged, [], ["place"], {"batch": F.col("starts")}).select(id_, size, (F.col("batch") - 1).alias("batch"))
