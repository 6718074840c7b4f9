"""URL filters: rules for hosts and paths first, a character language-model ratio for the rest.

A rule names a host and the start of a path; it fits its host and all subdomains, and the longest rule that
fits a url decides (equal lengths: the longer host, then code point order). Urls that rules decide teach two
variable-order Markov models over characters, one of allowed and one of blocked urls: Witten-Bell smoothing
backs off from contexts of up to `order` characters, of which only those met `least` times are kept, down to a
uniform share of all characters met and one for all others. A url's score is its log likelihood (base e)
under the model of allowed urls less that under the other, over the number of its characters and its end.
It is blocked where its score is below a threshold that is calibrated on urls of hosts left out of learning:
the one that tells most of both kinds apart, each kind counted alike (ties: the one nearest to 0).

Learning takes all different urls that rules decide: those of four fifths of the hosts are counted, those of the
others calibrate. Counts, probabilities and scores are tables: nothing that grows with the urls is on the driver or
broadcast. `ratios`, `Ratios` and `threshold` are the same for a few urls in one process; the tables are
tested against them. Gains are whole multiples of 1 / `SCALE`, so that a score doesn't depend on the order of its sum.
The rules are a short list, part of the plan.

A null url, or one without `://`, has an empty host and path and no rule; the models judge its whole text,
null as the empty one. If the rules decide no url of one kind, nothing can be learnt: all others are allowed. If
one kind has no url to calibrate with, the threshold is 0. Repeated urls count once in learning and get the same
verdict; very long urls are scored whole; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import checkpointed, let
from corpusjobs.operators.ordered import running

#: Before the first and after the last character of a url.
START, END = "\x02", "\x03"
ALLOW, BLOCK = "allow", "block"
#: Parts of 1 that gains are rounded to.
SCALE = 2**30
#: A gram of more than this part of all characters gets its gain by broadcast: there are fewer of them than this.
COMMON = 20_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Ratios:
    """What a longest known context adds: gains by context and character, shares by context for going on to a shorter one."""

    gains: dict[str, float]
    shares: dict[str, float]
    other: float  # of a character that neither model met
    order: int

    def score(self, url: str) -> float:
        """The length-normalised log likelihood ratio of a url."""
        spread, total = START + url + END, 0.0
        gains, shares, order = self.gains, self.shares, self.order
        for at in range(1, len(spread)):
            first = max(0, at - order)
            while (gain := gains.get(spread[first : at + 1])) is None and first < at:
                total += shares.get(spread[first:at], 0.0)
                first += 1
            total += self.other if gain is None else gain
        return total / (len(spread) - 1)


def parse(rules: Sequence[tuple[str, str]]) -> list[Rule]:
    """Rules from (verdict, text) like ("block", "example.com/de/"), the longest first."""
    found = [Rule(verdict, *((text, "") if "/" not in text else (text[: text.index("/")], text[text.index("/") :]))) for verdict, text in rules]
    return sorted(found, key=lambda r: (-len(r.text), -len(r.host), r.text))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between :// and the first of / ? #, with A-Z in lower case, and what follows up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*+)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*+([^?#]*+)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def decided(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    kind = "struct<rule: string, verdict: string>"
    fits = [F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    return F.coalesce(*fits, F.lit(None).cast(kind))


def ratios(counts: list[tuple[str, str, int, int]], order: int) -> Ratios:
    """The two models' ratios from the counts (context, symbol, allowed, blocked)."""
    by: dict[str, dict[str, tuple[int, int]]] = {}
    for context, symbol, a, b in counts:
        by.setdefault(context, {})[symbol] = (a, b)
    uniform = 1 / (len(by.get("", {})) + 1)
    probabilities: dict[str, tuple[float, float]] = {}
    gains: dict[str, float] = {}
    shares: dict[str, float] = {}
    other = 0.0
    for context in sorted(by, key=len):
        followers = by[context]
        n = [sum(f[k] for f in followers.values()) for k in (0, 1)]
        kinds = [sum(f[k] > 0 for f in followers.values()) for k in (0, 1)]
        rest = [kinds[k] / (n[k] + kinds[k]) if n[k] else 1.0 for k in (0, 1)]  # what is left to shorter contexts
        shares[context] = math.log(rest[0] / rest[1])
        if not context:
            other = shares[context]
        for symbol, f in followers.items():
            lower = probabilities[context[1:] + symbol] if context else (uniform, uniform)
            p = tuple((f[k] / (n[k] + kinds[k]) if n[k] else 0.0) + rest[k] * lower[k] for k in (0, 1))
            probabilities[context + symbol] = (p[0], p[1])
            gains[context + symbol] = math.log(p[0] / p[1])
    return Ratios(gains, shares, other, order)


def threshold(scored: list[tuple[float, int]]) -> float:
    """The score below which urls are blocked: it tells most of both kinds apart, each kind counted alike."""
    allowed, blocked = (sorted(s for s, a in scored if a == k) for k in (1, 0))
    if not allowed or not blocked:
        return 0.0
    values = sorted({s for s, _ in scored})
    best, found, i, j = -1.0, 0.0, 0, 0
    for low, high in zip([values[0] - 1, *values], [*values, values[-1] + 1]):
        while i < len(allowed) and allowed[i] <= low:
            i += 1
        while j < len(blocked) and blocked[j] <= low:
            j += 1
        cut = 0.0 if low < 0 < high else (low + high) / 2
        right = 1 - i / len(allowed) + j / len(blocked)
        if right > best + 1e-12 or right > best - 1e-12 and abs(cut) < abs(found):
            best, found = right, cut
    return found


def lessons(urls: DataFrame) -> DataFrame:
    """All different urls (id below 0, url, allowed) that rules decide, and whether their hosts calibrate."""
    told = urls.where("verdict is not null and url is not null").select("url", "host", "verdict").distinct()
    aside = F.pmod(F.xxhash64("host", F.lit("calibration")), F.lit(5)) == 0
    return checkpointed(told.select((-1 - F.monotonically_increasing_id()).alias("id"), "url", (F.col("verdict") == ALLOW).cast("int").alias("allowed"), aside.alias("aside")))


def windows(url: Column, order: int) -> Column:
    """Each character of a url, and its end, with up to `order` characters before it."""
    return let(F.split(F.concat(F.lit(START), url, F.lit(END)), ""), lambda c: F.transform(F.sequence(F.lit(2), F.size(c)), lambda at: F.array_join(F.slice(c, F.greatest(F.lit(1), at - order), F.least(F.lit(order + 1), at)), "")))


def suffixes(gram: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(gram)), lambda n: gram.substr(F.length(gram) - n + 1, n))


def gram_counts(urls: DataFrame, order: int, least: int) -> DataFrame:
    """(context, symbol, allowed, blocked): how often a character follows a context in learnt urls, rare contexts left out."""
    both = [F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")]
    longest = urls.select("allowed", (1 - F.col("allowed")).alias("blocked"), F.explode(windows(F.col("url"), order)).alias("gram")).groupBy("gram").agg(*both)
    met = longest.select("allowed", "blocked", F.explode(suffixes(F.col("gram"))).alias("gram")).groupBy("gram").agg(*both)
    met = checkpointed(met.select(*split_gram(), "allowed", "blocked"))
    known = met.groupBy("context").agg(F.sum(F.col("allowed") + F.col("blocked")).alias("n")).where((F.col("n") >= least) | (F.col("context") == "")).select("context")
    return met.join(known, "context")


def split_gram() -> list[Column]:
    gram = F.col("gram")
    return [gram.substr(F.lit(1), F.length(gram) - 1).alias("context"), gram.substr(F.length(gram), F.lit(1)).alias("symbol")]


def gains(grams: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(gram, gain): the log ratio of a gram's last character after those before it; all suffixes of `grams` (different) are among them.

    A gram needs the probabilities of its longest suffix, so lengths are taken in turn. A suffix meets one gram for each character at most.
    """
    totals = counts.groupBy("context").agg(*[f(k).alias(f"{k} {name}") for k in ("allowed", "blocked") for name, f in (("n", F.sum), ("kinds", lambda k: F.count_if(F.col(k) > 0)))])
    facts = grams.select("gram", *split_gram()).join(counts, ["context", "symbol"], "left").join(totals, "context", "left")
    seen, rest = {}, {}
    for k in ("allowed", "blocked"):
        n, kinds = F.col(f"{k} n"), F.col(f"{k} kinds")
        seen[k] = F.when(n > 0, F.coalesce(F.col(k), F.lit(0)) / (n + kinds)).otherwise(0.0).alias(f"{k} seen")
        rest[k] = F.when(n > 0, kinds / (n + kinds)).otherwise(1.0).alias(f"{k} rest")  # what is left to shorter contexts
    facts = checkpointed(facts.select("gram", *seen.values(), *rest.values()))
    uniform = 1 / (counts.where("context = ''").count() + 1)
    p = [(F.col(f"{k} seen") + F.col(f"{k} rest") * F.col(f"{k} lower")).alias(k) for k in ("allowed", "blocked")]
    level = checkpointed(facts.where(F.length("gram") == 1).withColumns({f"{k} lower": F.lit(uniform) for k in ("allowed", "blocked")}).select("gram", *p))
    found = level
    for size in range(2, order + 2):
        lower = level.select(F.col("gram").alias("suffix"), *[F.col(k).alias(f"{k} lower") for k in ("allowed", "blocked")])
        level = checkpointed(facts.where(F.length("gram") == size).withColumn("suffix", F.substring("gram", 2, size)).join(lower, "suffix").select("gram", *p))
        found = found.unionAll(level)
    return found.select("gram", F.log(F.col("allowed") / F.col("blocked")).alias("gain"))


def scores(urls: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(id, score) of urls with different ids: sums of gains, over the number of characters and the end."""
    spread = urls.select("id", F.explode(windows(F.col("url"), order)).alias("gram"))
    met = checkpointed(spread.groupBy("gram").agg(F.count("*").alias("n")))
    grams = met.select(F.explode(suffixes(F.col("gram"))).alias("gram")).distinct()
    total = met.agg(F.sum("n")).first()[0] or 0
    known = checkpointed(met.join(gains(grams, counts, order), "gram").select("gram", F.round(F.col("gain") * SCALE).cast("long").alias("gain"), (F.col("n") * COMMON > total).alias("common")))
    # Rows of common grams have their gain already: they are spread by id, so that none of them fills a task.
    common = F.broadcast(known.where("common").select("gram", F.col("gain").alias("common gain")))
    others = known.where("not common").select("gram", F.lit(-1).cast("long").alias("part"), "gain")
    part = F.when(F.col("common gain").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(2**31))).otherwise(-1)
    told = spread.join(common, "gram", "left").withColumn("part", part.cast("long")).join(others, ["gram", "part"], "left")
    return told.groupBy("id").agg((F.sum(F.coalesce("common gain", "gain")) / F.lit(float(SCALE)) / F.count("*")).alias("score"))


def cutoff(scored: DataFrame) -> float:
    """The threshold of all rows (score, allowed), from running counts in the order of scores."""
    each = checkpointed(scored.groupBy("score").agg(F.sum("allowed").alias("allowed"), F.sum(1 - F.col("allowed")).alias("blocked")))
    allowed, blocked, lowest = each.agg(F.sum("allowed"), F.sum("blocked"), F.min("score")).first()
    if not allowed or not blocked:
        return 0.0
    upto = checkpointed(running(each, [], ["score"], {"place": F.lit(1), "allowed": F.col("allowed"), "blocked": F.col("blocked")}))
    after = upto.select((F.col("place") - 1).alias("place"), F.col("score").alias("high"))
    low, high = F.col("score"), F.coalesce("high", F.col("score") + 1)
    cuts = upto.join(after, "place", "left").select((F.col("blocked") * allowed - F.col("allowed") * blocked).alias("right"), F.when((low < 0) & (high > 0), 0.0).otherwise((low + high) / 2).alias("cut"))
    best = cuts.agg(F.max(F.struct("right", (-F.abs("cut")).alias("near"), (-F.col("cut")).alias("first")))).first()[0]
    below = 0.0 if lowest - 1 < 0 < lowest else lowest - 0.5  # blocks none
    return -max(tuple(best), (0, -abs(below), -below))[2]


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", order: int = 5, least: int = 2) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row; the score is null where a rule decides or nothing was learnt."""
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`").cast("string").alias("url")).withColumns({"host": host, "path": path})
    own = own.withColumn("by", decided(F.col("host"), F.col("path"), parse(rules))).select(f"`{key}`", "url", "host", "path", "by.rule", "by.verdict")
    own = checkpointed(own.withColumn("own row", F.monotonically_increasing_id()))
    taught = lessons(own)
    learnt = taught.where("not aside")
    last = [F.col(f"`{key}`"), "host", "path", "rule"]
    if learnt.select("allowed").distinct().count() < 2:  # one kind has no url to learn from
        return own.select(*last, F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    counts = checkpointed(gram_counts(learnt, order, least))
    asked = own.where("verdict is null").select(F.col("own row").alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    told = checkpointed(scores(asked.unionAll(taught.where("aside").select("id", "url")), counts, order))
    cut = cutoff(told.join(taught.select("id", "allowed"), "id").select("score", "allowed"))
    by_model = F.when(F.col("score") < cut, BLOCK).otherwise(ALLOW)
    return own.join(told, F.col("own row") == F.col("id"), "left").select(*last, F.coalesce("verdict", by_model).alias("verdict"), "score")
