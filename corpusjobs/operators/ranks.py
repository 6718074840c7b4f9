"""Rank lists of several engines put together by place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_lists(lists: DataFrame, engines: Sequence[str]) -> DataFrame:
    """(file, pos, author, title, a count for each engine, bad_info, has_zero) of lists (file, engine, pos, author, title, count).

    Only files that every engine has are merged. What engines tell of the same place is overwritten by later ones, in the order
    given; where one's author or title isn't that of those before, the place has bad info. A place that an engine lacks has a
    null there. Unknown engines don't count; of an engine's repeated places the one with the highest count stands.
    """
    rank = F.array_position(F.array(*map(F.lit, engines)), F.col("engine"))
    known = lists.where(F.col("engine").isin(*engines)).select("file", "pos", rank.alias("rank"), "author", "title", "count")
    complete = known.groupBy("file").agg(F.countDistinct("rank").alias("engines")).where(F.col("engines") == len(engines)).select("file")
    last = F.max_by(F.struct("author", "title"), F.struct("rank", "count")).alias("last")
    counts = [F.max(F.when(F.col("rank") == k + 1, F.col("count"))).alias(e) for k, e in enumerate(engines)]
    differ = F.count_distinct(F.struct(F.coalesce("author", F.lit("")), F.coalesce("title", F.lit("")))) > 1
    merged = known.join(complete, "file", "left_semi").groupBy("file", "pos").agg(last, *counts, differ.alias("bad_info"), F.coalesce(F.bool_or(F.col("count") == 0), F.lit(False)).alias("has_zero"))
    return merged.select("file", "pos", "last.author", "last.title", *engines, "bad_info", "has_zero")
