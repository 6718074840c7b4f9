"""Reports on probes of a service: their lines in its access log, outcomes by region, side and round, pools of queries, locators of hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusjobs.functions import scalars as S


def correlate(probes: DataFrame, log: DataFrame, by: list[str]) -> DataFrame:
    """(by, probes, answered, unanswered, logged, logged_200, agree): probes (by, path with its nonce, ok) and their lines in the log (path, status).

    Paths are compared whole, so that the nonce tells a probe from others of its page. `answered` are probes that have a line of
    status 200; sides agree if there are as many such lines as probes that say they went well. Lines of other paths don't count.
    """
    lines = log.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("status") == 200).alias("good"))
    joined = probes.join(lines, "path", "left")
    told = joined.groupBy(*by).agg(
        F.count("*").alias("probes"), F.count_if(F.col("good") > 0).alias("answered"), F.count_if(F.col("lines").isNull()).alias("unanswered"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("logged"), F.coalesce(F.sum("good"), F.lit(0)).alias("logged_200"), F.count_if("ok").alias("ok"),
    )
    return told.withColumn("agree", F.col("logged_200") == F.col("ok")).drop("ok")


def listed(counts: Column) -> Column:
    """(name, n) pairs as text, by name: `a:1,b:2`."""
    return F.array_join(F.transform(F.array_sort(counts), lambda c: F.concat_ws(":", c["name"].cast("string"), c["n"].cast("string"))), ",")


def breakdown(samples: DataFrame) -> DataFrame:
    """(region, side, round, attempts, successes, statuses, reasons) of samples (regions, side, round, ok, status, reasons): a row for each region and side, over all rounds (null) and for each.

    A sample belongs to all of its regions, and counts under each of its reasons.
    """
    rows = samples.withColumn("region", F.explode("regions"))
    sets = [[F.col("region"), F.col("side")], [F.col("region"), F.col("side"), F.col("round")]]
    keys = [F.col("region"), F.col("side"), F.col("round")]
    totals = rows.groupingSets(sets, *keys).agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.grouping("round").alias("whole"))

    def counted(of: DataFrame, column: str, name: str) -> DataFrame:
        each = of.groupingSets([[*s, F.col(column)] for s in sets], *keys, F.col(column)).agg(F.count("*").alias("n"), F.grouping("round").alias("whole"))
        return each.where(F.col(column).isNotNull()).groupBy("region", "side", "round", "whole").agg(listed(F.collect_list(F.struct(F.col(column).alias("name"), "n"))).alias(name))

    found = totals
    for part in (counted(rows, "status", "statuses"), counted(rows.withColumn("reason", F.explode("reasons")), "reason", "reasons")):
        renamed = part.select(*[F.col(c).alias(f"{c} of") for c in ("region", "side", "round", "whole")], part.columns[-1])
        match = F.lit(True)
        for c in ("region", "side", "round", "whole"):
            match &= F.col(c).eqNullSafe(F.col(f"{c} of"))
        found = found.join(renamed, match, "left").drop(*[f"{c} of" for c in ("region", "side", "round", "whole")])
    return found.select("region", "side", "round", "attempts", "successes", F.coalesce("statuses", F.lit("")).alias("statuses"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def query_pool(topics: DataFrame, preferences: DataFrame, seed: str, first: int, count: int) -> DataFrame:
    """(place, query): a slice of all topics (topic) with all preferences (preference), in an order that the seed decides.

    Both are short fixed lists; two equal queries are an error.
    """
    pool = topics.crossJoin(F.broadcast(preferences)).select(F.concat_ws(" ", "topic", "preference").alias("query"))
    twice = pool.groupBy("query").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"queries that occur twice: {[r['query'] for r in twice]}")
    mixed = pool.withColumn("h", F.sha2(F.concat(F.lit(seed), "query"), 256))
    taken = mixed.orderBy("h").limit(first + count).withColumn("place", F.row_number().over(Window.orderBy("h")) - 1)  # a short list
    return taken.where(F.col("place") >= first).select("place", "query")


def locator_reason(hit: dict[str, Column], generation: str, datasets: Sequence[str]) -> Column:
    """The first reason against a hit's locator (generation, dataset, row, raw, norm, work), or null."""
    work = S.parse_work_id(hit["work"])
    good = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~good(hit["generation"] == generation), "generation")
        .when(~good(hit["dataset"].isin(*datasets)), "dataset")
        .when(~good(hit["row"] > 0), "row")
        .when(~good((hit["raw"] >= 0) & (hit["norm"] >= 0) & (hit["raw"] >= hit["norm"])), "index")
        .when(~good((S.trim_all(hit["work"]) != "") & (work["dataset"] == hit["dataset"]) & (work["row"] <= hit["row"])), "work")
    )
