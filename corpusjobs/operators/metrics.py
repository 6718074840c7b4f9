"""Summaries of request and host logs: latencies, distributions, resource windows, rates, budgets."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusjobs.operators import ordered


#: Ranks of quantile sketches are right within this part of a group's rows.
ACCURACY = 10_000


def counted(rows: DataFrame, by: list[str], value: str, kinds: dict[str, Column], places: dict[str, list[float]]) -> DataFrame:
    """Values ("the value") of each group around the given percentiles of its rows of each kind, with how many rows of the kind have it, up to it, and in the whole group.

    Two passes. Sketches, which tasks merge, tell between which two values a percentile lies, up to a few ten-thousandths of the rows; then
    rows between these values are counted by value, and all others only by the gap they fall in. So however large a group is, what one sort
    sees of it is small. A group of up to 2 * ACCURACY rows is counted whole. "least" and "largest" are the group's ends.
    """
    own = rows.where(F.col(value).isNotNull())
    near = 3 / ACCURACY
    of = lambda k: F.when(kinds[k], F.col(value))
    sketch = {k: F.percentile_approx(of(k), [x for p in ps for x in (max(0.0, p - near), min(1.0, p + near))], ACCURACY).alias(f"{k} at") for k, ps in places.items()}
    marks = own.groupBy(*[F.col(c).alias(f"{c} of") for c in by]).agg(F.count("*").alias("the count"), F.min(value).alias("least"), F.max(value).alias("largest"), *[F.count_if(c).alias(f"{k} n") for k, c in kinds.items()], *sketch.values())
    cuts = F.array(*[F.struct(F.col(f"{k} at")[2 * i].alias("low"), F.col(f"{k} at")[2 * i + 1].alias("high")) for k, ps in places.items() for i in range(len(ps))])
    whole = F.array(F.struct(F.col("least").alias("low"), F.col("largest").alias("high")))
    marks = marks.withColumn("cuts", F.when(F.col("the count") <= 2 * ACCURACY, whole).otherwise(F.filter(cuts, lambda c: c["low"].isNotNull())))
    match = F.lit(True)
    for c in by:
        match &= own[c].eqNullSafe(marks[f"{c} of"])
    v = F.col(value)
    inside = F.exists("cuts", lambda c: (c["low"] <= v) & (v <= c["high"]))
    below = F.array_max(F.transform(F.filter("cuts", lambda c: c["high"] < v), lambda c: c["high"]))
    dealt = own.join(marks.select(*[f"{c} of" for c in by], "cuts"), match).select(*[own[c] for c in by], *[c.alias(k) for k, c in kinds.items()], F.when(inside, v).alias("the value"), F.when(inside, v).otherwise(below).alias("after"))
    seen = dealt.groupBy(*by, "the value", "after").agg(*[F.count_if(k).alias(k) for k in kinds])
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first("after"), F.col("the value").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumns({f"{k} upto": F.sum(k).over(w) for k in kinds})
    match = F.lit(True)
    for c in by:
        match &= seen[c].eqNullSafe(marks[f"{c} of"])
    return seen.join(marks, match).where("`the value` is not null").select(*[seen[c] for c in by], "the value", *[F.col(f"{k} upto") for k in kinds], *[F.col(f"{k} n") for k in kinds], "least", "largest")


def at_place(kind: str, place: Column) -> Column:
    """Of counted(): the value at a place of a group, from 0; null where the group has no row of the kind."""
    return F.min(F.when((F.col(f"{kind} n") > 0) & (F.col(f"{kind} upto") > place), F.col("the value")))


def interpolated(kind: str, p: float) -> Column:
    """Of counted(): the percentile of a group, on the line between its two neighbours."""
    of, exact = (F.col(f"{kind} n") - 1) * p, (F.max(f"{kind} n") - 1) * p
    low, high = at_place(kind, F.floor(of)), at_place(kind, F.ceil(of))
    return F.when(low == high, low).otherwise((F.ceil(exact) - exact) * low + (exact - F.floor(exact)) * high).cast("double")


def nearest_rank(kind: str, p: float) -> Column:
    """Of counted(): the smallest value that is not below a share p of the group."""
    return at_place(kind, F.ceil(F.col(f"{kind} n") * p) - 1)


def stage_latency(outcomes: DataFrame, stage: list[str], seconds: str, ok: str, wall: Column) -> DataFrame:
    """Per stage: requests, passed, rate of passed, error rate, interpolated percentiles of passed and of all, the largest."""
    grouped = outcomes.groupBy(*stage).agg(F.count("*").alias("requests"), F.count_if(ok).alias("passed"), F.max(seconds).alias("slowest"), wall.alias("wall"))
    places = counted(outcomes, stage, seconds, {"ok": F.col(ok), "all": F.lit(True)}, {"ok": [0.5, 0.95, 0.99], "all": [0.95]}).groupBy(*[F.col(c).alias(f"{c} of") for c in stage]).agg(
        *[interpolated("ok", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)], interpolated("all", 0.95).alias("all_p95"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"{c} of")) for c in stage]
    return grouped.join(places, same, "left").select(
        *stage, "requests", "passed", F.try_divide("passed", "wall").alias("rps"), (1 - F.col("passed") / F.col("requests")).alias("error_rate"),
        "p50", "p95", "p99", "all_p95", "slowest",
    )


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, median, nearest-rank 95th percentile, least and largest; nulls and NaN don't count."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ends = [F.first("least").alias("least"), F.first("largest").alias("largest")]
    return counted(good, by, value, {"all": F.lit(True)}, {"all": [0.5, 0.95]}).groupBy(*by).agg(F.max("all n").alias("n"), interpolated("all", 0.5).alias("median"), nearest_rank("all", 0.95).alias("p95"), *ends)


def resource_summary(samples: DataFrame, by: list[str], at: str, available: str, counter: str) -> DataFrame:
    """Per window: samples, seconds, least available, the counter's growth, and its growth per second (null for no time)."""
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    grown = F.max_by(counter, at) - F.min_by(counter, at)
    return samples.groupBy(*by).agg(F.count("*").alias("samples"), seconds.alias("seconds"), F.min(available).alias("least_available"), grown.alias("grown")).withColumn("per_second", F.try_divide("grown", "seconds"))


def samples_in_stage(samples: DataFrame, stages: DataFrame, at: str, start: str, end: str, minutes: int = 60) -> DataFrame:
    """Samples with the stages they fall in, both ends included; stages are cut into buckets, so that the join is on equal keys."""
    width = minutes * 60
    bucket = F.floor(F.col(at).cast("long") / width)
    cut = stages.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start).cast("long") / width), F.floor(F.col(end).cast("long") / width))))
    return samples.withColumn("bucket", bucket).join(cut, "bucket").where(F.col(at).between(F.col(start), F.col(end))).drop("bucket")


def throughput_deltas(samples: DataFrame, run: str, at: str, done: str, failed: str) -> DataFrame:
    """Rates between one sample and the next of a run; the first has rate 0, and no time counts as a millionth of a second.

    A run may lie in many ranges, each with the last sample before it.
    """
    w = Window.partitionBy("part", run).orderBy(at, done)
    seconds = F.greatest((F.unix_micros(at) - F.lag(F.unix_micros(at)).over(w)) / 1e6, F.lit(1e-6))
    rate = {f"{c}_rate": F.coalesce((F.col(c) - F.lag(c).over(w)) / seconds, F.lit(0.0)) for c in (done, failed)}
    return ordered.with_halo(samples, [run], [at, done], 1).withColumns(rate).where("not halo").drop("part", "halo")


def rolling_health(results: DataFrame, run: str, order: list[str], seconds: str, flags: list[str], n: int = 32) -> DataFrame:
    """Rates of the flags and mean duration of the last n results; null until there are n. A run may lie in many ranges, each with the n - 1 results before it."""
    w = Window.partitionBy("part", run).orderBy(*order).rowsBetween(1 - n, 0)
    full = F.count("*").over(w) == n
    told = {f"{f}_rate": F.when(full, F.avg(F.col(f).cast("double")).over(w)) for f in flags} | {"mean_seconds": F.when(full, F.avg(seconds).over(w))}
    return ordered.with_halo(results, [run], order, n - 1).withColumns(told).where("not halo").drop("part", "halo")


def in_turn(rows: DataFrame, keys: int, start: Callable[[], Callable], made: str) -> DataFrame:
    """The rows with what a state makes of them: start() for each key (the first columns), asked with the other columns in their order.

    Keys are dealt over tasks and sorted in them; rows pass by in batches, so a task holds one batch and one state
    however many rows a key has.
    """
    names = rows.columns
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or row[:keys] != key:
                    key, state = row[:keys], start()
                out.append(state(*row[keys:]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, told)], names=[*names, name])

    name, kind = made.split()
    told = {"long": pa.int64(), "int": pa.int32()}[kind]
    return rows.repartition(*names[:keys]).sortWithinPartitions(*names).mapInArrow(run, f"{kinds}, {made}")


def admitted(arrivals: DataFrame, key: str, at: str, order: str, start: Callable[[], Callable]) -> DataFrame:
    """(key, order, admitted, wait) from a state that tells how long an arrival must wait, 0 if it is admitted; null for a null time."""
    rows = arrivals.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), F.col(order).alias("order"))
    return in_turn(rows, 1, start, "wait long").select(F.col("key").alias(key), F.col("order").alias(order), (F.col("wait") == 0).alias("admitted"), "wait")


def minute_budget(arrivals: DataFrame, key: str, at: str, order: str, budget: int) -> DataFrame:
    """Which arrivals a rolling minute of `budget` admits: refused ones use up nothing; wait is in whole seconds, 1 at least.

    The state of a key is as many times as the budget.
    """

    def start() -> Callable:
        held: deque[float] = deque()

        def ask(micros: int | None, _: object) -> int | None:
            if micros is None:
                return None
            now = micros / 1e6
            while held and held[0] + 60 <= now:
                held.popleft()
            if len(held) >= budget:
                return max(1, math.ceil(held[0] + 60 - now)) if held else 60
            held.append(now)
            return 0

        return ask

    return admitted(arrivals, key, at, order, start)


def token_bucket(arrivals: DataFrame, key: str, at: str, order: str, rate: float, burst: int) -> DataFrame:
    """Which arrivals a bucket of `burst` tokens admits that fills at `rate` a second, and after how long to try again."""

    def start() -> Callable:
        tokens, last = float(burst), None

        def ask(micros: int | None, _: object) -> int | None:
            nonlocal tokens, last
            if micros is None:
                return None
            now = micros / 1e6
            tokens, last = min(burst, tokens + (now - (now if last is None else last)) * rate), now
            if tokens >= 1:
                tokens -= 1
                return 0
            return max(1, math.ceil((1 - tokens) / rate))

        return ask

    return admitted(arrivals, key, at, order, start)
