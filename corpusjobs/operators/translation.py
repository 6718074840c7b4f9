"""Translating rows with a caller's model: chunks, validated answers, retries that say what was wrong, single lines, outcomes.

A row without lines, or of punctuation alone, is skipped without a call. The lines of others are cut into chunks. A chunk is
asked for until an answer passes all checks, `retries` times more at most; each retry tells the model why its last answer was refused. A
message that content is refused for good skips the chunk. A chunk of several lines whose answers fail by what they say, and not by
transport, is asked for line by line. The first chunk, and within it the first line, that isn't done decides its row; all done are put together.

Every round reads the ledger of calls (see calls), so that a job that starts again goes on where it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusjobs.functions import scalars as S
from corpusjobs.operators import calls
from corpusjobs.sources.shared import scratch

#: Reasons of a refused answer after which single lines are tried.
BY_LINE = ("no translation", "refusal", "line count", "placeholder not explained", "identical", "too short", "interpretation refused")


def pause(error: Exception, attempt: int) -> float:
    """Seconds until a failed call is tried again."""
    return float(min(2**attempt, 8))


def judged(pieces: DataFrame, facts: DataFrame, retries: int) -> DataFrame:
    """pieces (key, lines) with what the ledger says of them: state (done, skipped, failed, open), reason, attempts, translation, interpretation, due."""
    last = calls.last_facts(facts).select("key", F.col("attempt").alias("last"), "answer", "message", "status", "due")
    parsed = F.when(F.col("answer").isNotNull(), S.parse_response(F.col("lines"), F.col("answer")))
    refused = F.col("message").isNotNull() & (S.classify_failure(F.col("message"), F.col("status")) == "skip")

    def told(p: Column) -> Column:
        done = p["status"] == "done"
        state = F.when(F.col("last").isNull(), "open").when(done, "done").when(refused, "skipped").when(F.col("last") >= retries, "failed").otherwise("open")
        reason = F.when(done, None).otherwise(F.coalesce(p["reason"], "message"))
        return F.struct(state.alias("state"), reason.alias("reason"), p["translation"].alias("translation"), p["interpretation"].alias("interpretation"))

    found = pieces.join(last, "key", "left").withColumn("told", S.let(parsed, told))
    return found.select(*pieces.columns, "told.state", "told.reason", F.coalesce(F.col("last") + 1, F.lit(0)).alias("attempts"), "told.translation", "told.interpretation", "due")


def settled(pieces: DataFrame, call: calls.Call, path: str, retries: int, **how) -> DataFrame:
    """pieces judged after as many rounds as they need, kept in files of the shared folder.

    A round judges only the pieces that the one before left open, by the answers that it got, so that each answer is parsed once.
    Scans of one folder count as equal in a plan although files were added between them, so no plan may hold the ledger of two times.
    """
    spark = pieces.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        place = scratch(spark, "pieces")
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    now = kept(judged(pieces, calls.read_facts(spark, path, "string"), retries))
    rounds = [now.where("state != 'open'")]
    for _ in range(retries + 1):
        left = now.where("state = 'open'")
        request = F.to_json("lines")
        if not calls.ask(left.select("key", F.col("attempts").alias("attempt"), request.alias("request"), F.col("reason").alias("hint"), "due"), call, path, "string", schedule=pause, batch=1, **how):
            break
        told = calls.read_facts(spark, path, "string").join(left.select("key", F.col("attempts").alias("attempt")), ["key", "attempt"], "left_semi")
        now = kept(judged(left.select(*pieces.columns), told, retries))
        rounds.append(now.where("state != 'open'"))
    return reduce(DataFrame.union, [*rounds, now.where("state = 'open'")])


def first_open(states: Column) -> Column:
    """Of (place, state, reason) in order: the first that isn't done, or null."""
    return F.get(F.filter(states, lambda s: s["state"] != "done"), F.lit(0))


def put_together(parts: DataFrame, by: str, place: str) -> DataFrame:
    """Outcomes of the parts of each `by`: done with all lines and interpretations in order, else as the first that isn't done."""
    grouped = parts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(place, "state", "reason", "translation", "interpretation"))).alias("parts"), F.sum("attempts").alias("attempts"))
    odd = first_open(F.col("parts"))
    done = odd.isNull()
    return grouped.select(
        by,
        F.coalesce(odd["state"], F.lit("done")).alias("state"),
        odd["reason"].alias("reason"),
        F.when(done, F.flatten(F.transform("parts", lambda p: p["translation"]))).alias("translation"),
        F.when(done, F.array_join(F.transform("parts", lambda p: p["interpretation"]), "\n")).alias("interpretation"),
        "attempts",
    )


def translate(rows: DataFrame, call: calls.Call, path: str, id_: str = "id", lines: str = "lines", retries: int = 3, most_lines: int = 8, most_chars: int = 600, **how) -> DataFrame:
    """(id, outcome, reason, translation, interpretation, attempts) of rows (id, lines), ids being unique; attempts are the calls made.

    call gets one (key, attempt, JSON list of lines, why the last answer was refused) at a time and gives the model's answer as text.
    """
    kept = F.filter(F.coalesce(F.col(lines), F.array().cast("array<string>")), lambda x: S.trim_all(F.coalesce(x, F.lit(""))) != "")
    own = rows.select(F.col(id_).cast("string").alias("row"), F.col(id_).alias("id of row"), kept.alias("lines"))
    skipped = F.when(F.size("lines") == 0, "empty").when(F.forall("lines", S.is_punctuation_only), "punctuation")
    own = own.withColumn("skipped", skipped)
    spans = own.where("skipped is null").select("row", "lines", F.posexplode(S.chunk_lines(F.col("lines"), most_lines, most_chars)).alias("chunk", "s"))
    chunks = spans.select(F.concat_ws(":", "row", F.col("chunk").cast("string")).alias("key"), "row", "chunk", F.slice("lines", F.col("s.from"), F.col("s.to") - F.col("s.from") + 1).alias("lines"))
    whole = settled(chunks, call, path, retries, **how)
    again = (F.col("state") == "failed") & F.col("reason").isin(*BY_LINE) & (F.size("lines") > 1)
    single = whole.where(again).select(F.col("key").alias("of"), F.posexplode("lines").alias("line", "text"))
    single = single.select(F.concat_ws(".", "of", F.col("line").cast("string")).alias("key"), "of", "line", F.array("text").alias("lines"))
    by_line = put_together(settled(single, call, path, retries, **how), "of", "line")
    joined = whole.join(by_line.select(F.col("of").alias("key"), F.struct("state", "reason", "translation", "interpretation", "attempts").alias("l")), "key", "left")
    pick = lambda c: F.when(F.col("l").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(c)).alias(c)
    parts = joined.select("row", "chunk", pick("state"), pick("reason"), pick("translation"), pick("interpretation"), (F.col("attempts") + F.coalesce("l.attempts", F.lit(0))).alias("attempts"))
    found = put_together(parts, "row", "chunk")
    return own.join(found, "row", "left").select(
        F.col("id of row").alias(id_),
        F.when(F.col("skipped").isNotNull(), "skipped").otherwise(F.col("state")).alias("outcome"),
        F.coalesce("skipped", "reason").alias("reason"),
        "translation",
        "interpretation",
        F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"),
    )
