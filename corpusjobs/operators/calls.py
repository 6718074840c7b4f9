"""Calls of a caller's function over many rows, with a ledger: what has been answered isn't asked again.

A job goes in rounds. A round asks for the keys that the ledger leaves open and appends a fact for each: its answer, or
how the call failed and when it may be tried again. A task's facts are moved into the ledger as the task ends
(the second commit algorithm of Hadoop's writers), so that they stay although the job fails: facts are true on their own. What
follows reads the ledger, so that a stage that is run again calls nothing. A task that is lost in its course is run again, and with it
at most `per_task` requests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What a call gets: (key, attempt, request, why the last answer was refused or null) of a few requests. What it gives: an answer for each.
Call = Callable[[list[tuple[str, int, str, str | None]]], list]


class CallError(Exception):
    """A failed call: its HTTP status, how long to wait if the answer said so, and whether a broken connection or a timeout was the cause."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None, transient: bool = False):
        super().__init__(message)
        self.status, self.retry_after, self.transient = status, retry_after, transient


def backoff(error: Exception, attempt: int, most: int = 3) -> float | None:
    """Seconds until the next attempt, None for none: what the answer said, else 30 for 429 and 1 otherwise, doubled each time."""
    if not isinstance(error, CallError) or attempt >= most:
        return None
    status = error.status or 0
    if not (error.transient or status in (408, 429) or 500 <= status < 600):
        return None
    if error.retry_after is not None and error.retry_after >= 0:
        return error.retry_after
    return (30.0 if status == 429 else 1.0) * 2**attempt


def read_facts(spark: SparkSession, path: str, answer: str) -> DataFrame:
    """The facts (key, attempt, answer, message, status, due): due is when a failed call may be tried again, null if never or if answered.

    A task that was lost may have told its facts twice; last_facts takes one of them.
    """
    schema = f"key string, attempt int, answer {answer}, message string, status int, due double"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("f")).select("f.*")
    return spark.read.schema(schema).parquet(path)


def read_ledger(spark: SparkSession, path: str, answer: str) -> DataFrame:
    """The facts, one for each key and attempt."""
    return read_facts(spark, path, answer).dropDuplicates(["key", "attempt"])


def ask(requests: DataFrame, call: Call, path: str, answer: str, schedule: Callable[[Exception, int], float | None] = backoff, batch: int = 64, per_task: int = 1024, wait: Callable[[float], None] = time.sleep) -> int:
    """One round: calls for all requests (key, attempt, request, hint, due), `batch` at once, appends the facts, and returns how many requests there were.

    A call that raises, or gives another number of answers, fails its batch; if it isn't to be tried again, each request is asked alone.
    Requests that aren't due yet are waited for.
    """
    schema = f"key string, attempt int, answer {answer}, message string, status int, due double"
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def facts_of(rows: list[dict]) -> list[dict]:
        try:
            got = call([(r["key"], r["attempt"], r["request"], r["hint"]) for r in rows])
            if len(got) != len(rows):
                raise CallError(f"{len(got)} answers for {len(rows)} requests")
        except Exception as e:  # the caller's function may raise anything; it is told in the ledger
            pauses = [schedule(e, r["attempt"]) for r in rows]
            if len(rows) > 1 and None in pauses:  # one of them may be to blame
                return [f for r in rows for f in facts_of([r])]
            return [{"key": r["key"], "attempt": r["attempt"], "message": f"{type(e).__name__}: {e}", "status": getattr(e, "status", None), "due": None if p is None else time.time() + p} for r, p in zip(rows, pauses)]
        return [{"key": r["key"], "attempt": r["attempt"], "answer": a} for r, a in zip(rows, got)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            facts: list[dict] = []
            for at in range(0, whole.num_rows, batch):
                rows = whole.slice(at, batch).to_pylist()
                early = max((r["due"] for r in rows if r["due"] is not None), default=0.0) - time.time()
                if early > 0:
                    wait(early)
                facts += facts_of(rows)
            yield pa.RecordBatch.from_arrays([pa.array([f.get(c.name) for f in facts], c.type) for c in fields], schema=fields)

    n = requests.count()
    if n:
        parts = -(-n // per_task)
        dealt = requests.select("key", "attempt", "request", "hint", "due").repartition(parts, "key").sortWithinPartitions("due", "key")
        facts = dealt.mapInArrow(run, schema)
        facts.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return n


def last_facts(facts: DataFrame) -> DataFrame:
    """The last fact of each key."""
    last = F.max_by(F.struct("attempt", "answer", "message", "status", "due"), "attempt").alias("f")
    return facts.groupBy("key").agg(last).select("key", "f.*")


def answers(tasks: DataFrame, call: Call, path: str, answer: str, rounds: int = 4, **how) -> DataFrame:
    """The last fact of each of tasks (key, request), asked for until answered or given up; an earlier run's ledger is gone on with."""
    spark = tasks.sparkSession
    for _ in range(rounds):
        last = last_facts(read_facts(spark, path, answer)).select("key", "attempt", "due", F.lit(True).alias("known"))
        open_ = tasks.join(last, "key", "left").where("known is null or due is not null")
        if not ask(open_.select("key", F.coalesce(F.col("attempt") + 1, F.lit(0)).alias("attempt"), "request", F.lit(None).cast("string").alias("hint"), "due"), call, path, answer, **how):
            break
    return last_facts(read_facts(spark, path, answer))


def embed(rows: DataFrame, embedder: Call, text: str, dimensions: int, path: str, rounds: int = 4, **how) -> DataFrame:
    """rows with `embedding` and `embed_error`: each distinct text is embedded once, known by its hash; null text has neither.

    Vectors of other dimensions count as a failure for good. Where calls failed to the end, the embedding is null and the error tells why.
    """

    def call(requests: list[tuple[str, int, str, str | None]]) -> list[list[float]]:
        got = embedder(requests)
        if any(v is None or len(v) != dimensions for v in got):
            raise CallError("the embedder returned other dimensions")
        return [[float(x) for x in v] for v in got]

    key = F.sha2(F.encode(F.col(text), "UTF-8"), 256)
    distinct = rows.where(F.col(text).isNotNull()).groupBy(key.alias("key")).agg(F.first(text).alias("request"))
    found = answers(distinct, call, path, "array<float>", rounds, **how)
    told = found.select("key", F.col("answer").alias("embedding"), F.when(F.col("answer").isNull(), F.col("message")).alias("embed_error"))
    return rows.withColumn("key of text", key).join(told.withColumnRenamed("key", "key of text"), "key of text", "left").drop("key of text")
