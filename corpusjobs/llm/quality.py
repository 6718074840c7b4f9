"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule turns a text into a badness of which 1 is the usual limit: symbols among the characters of
words, capitals among letters, exclamation marks per word, repeated lines, words in repeated windows,
and mean word lengths out of bounds. A document's badness is the largest of them.

Cutoffs on the badness are chosen for each stratum (the language) from labelled holdouts. From the
laxest cutoff of a fixed list to the strictest, the hypothesis "this cutoff rejects more than `risk` of
the stratum's good documents" is tested with the exact binomial tail of the rejected good holdouts; the
walk ends at the first cutoff that isn't proven (fixed-sequence testing, so the list costs no
correction), and the error rate is divided by the number of strata (Bonferroni). With probability
1 - `error`, no stratum then loses more than `risk` of its good documents to the cutoffs. A stratum
without enough evidence gets no cutoff and loses only what the base rules reject.

Nulls: a null text has no words (and fails the base rules); a null stratum is a stratum; labels with a
null id or quality are left out; of several labels of a document the lowest counts. Repeated rows are
measured alone, and their labels count once for each row. No row is dropped by `decide`. Documents
of equal badness are kept or rejected together. Very long texts are measured whole; an empty table of documents gives
an empty result, an empty one of labels no cutoff. Columns whose names clash with the operator's own are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusjobs.llm.common import checkpointed, let, small, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Laxest first; the list ends at the usual limit, so that no cutoff rejects what only the risk would allow.
CUTOFFS = (4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(found: Column) -> Column:
    """How many words stand in windows of 8 words that occur twice or more in the array."""
    places = F.sequence(F.lit(1), F.size(found) - (WINDOW - 1))
    hashes = F.transform(places, lambda k: F.xxhash64(F.slice(found, k, WINDOW)))

    def covered(sorted_windows: Column) -> Column:
        """Of (hash, place) in order: the places whose hash a neighbour has, then the length of the union of their windows."""
        same = F.filter(
            sorted_windows,
            lambda w, k: (F.get(sorted_windows, k - 1)["h"] == w["h"]) | (F.get(sorted_windows, k + 1)["h"] == w["h"]),
        )
        return let(
            F.sort_array(F.transform(same, lambda w: w["k"])),
            lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                lambda a, k: F.struct((a["n"] + F.least(F.lit(WINDOW), k - a["last"])).alias("n"), k.alias("last")),
            )["n"],
        )

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    return F.when(F.size(found) < WINDOW, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct `measures`: the base measures, base_failed and badness of the text, computed once for a row."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def without(value: Column, characters: str) -> Column:
        return F.length(F.translate(value, characters, ""))

    def measured(found: Column) -> Column:
        chars = F.aggregate(found, F.lit(0), lambda n, w: n + F.length(w)).cast("long")
        lines = F.filter(F.split(t, "\n"), lambda line: F.translate(line, "\t\x0b\x0c\r ", "") != "")
        base = F.struct(
            F.size(found).cast("long").alias("n_words"),
            chars.alias("word_chars"),
            (F.length(t) - without(t, SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).alias("n_lines"),
            repeated_words(found).alias("n_repeat_words"),
            (F.length(t) - without(t, "!")).cast("long").alias("n_exclamations"),
            F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        )
        return let(base, lambda m: F.struct(*[m[c].alias(c) for c in MEASURES], base_failed(m).alias("base_failed"), badness(m).alias("badness")))

    return docs.withColumn("measures", let(words(t), measured))


def badness(m: Column) -> Column:
    """The largest badness over the rules; 0 for no words."""
    n, chars = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["word_chars"], F.lit(1))
    mean = m["word_chars"] / n
    # Capitals and lengths say little about a few words.
    enough = m["n_words"] >= 10
    return F.when(
        m["n_words"] > 0,
        F.greatest(
            m["n_symbols"] / chars / 0.1,
            F.when(enough, m["n_capitals"] / chars / 0.5).otherwise(0.0),
            F.when(enough, m["n_exclamations"] / n / 0.5).otherwise(0.0),
            F.when(m["n_lines"] >= 4, m["n_dup_lines"] / m["n_lines"] / 0.5).otherwise(0.0),
            m["n_repeat_words"] / n / 0.3,
            F.when(enough, F.greatest(mean / 15, 2 / mean)).otherwise(0.0),
        ),
    ).otherwise(0.0)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def log_binomial_tail(rejected: Column, n: Column, risk: float) -> Column:
    """log P(X <= rejected) for X of a binomial distribution with n draws of chance risk, summed exactly."""
    import math

    odds = math.log(risk) - math.log1p(-risk)

    def step(a: Column, k: Column) -> Column:
        """k: the term to add; a: log of the last term and of the sum so far."""
        term = a["term"] + F.log((n - k + 1) / k) + odds
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    first = n * math.log1p(-risk)
    terms = F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), F.greatest(rejected, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), step)["sum"]


def calibrate(holdouts: DataFrame, risk: float = 0.03, error: float = 0.05) -> DataFrame:
    """The cutoff of each stratum, from rows (stratum, badness, good); strata without a proven cutoff are left out."""
    import math

    at_least = [F.count_if(F.col("good") & (F.col("badness") >= c)).alias(f"r{k}") for k, c in enumerate(CUTOFFS)]
    counts = holdouts.groupBy("stratum").agg(F.count_if("good").alias("n"), *at_least)
    counts = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("strata"))))  # one row
    tests = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"r{k}").alias("rejected")) for k, c in enumerate(CUTOFFS)])
    tested = counts.select("stratum", "n", "strata", F.posexplode(tests).alias("step", "test"))
    proven = log_binomial_tail(F.col("test.rejected"), F.col("n"), risk) <= F.lit(math.log(error)) - F.log(F.col("strata").cast("double"))
    so_far = F.min(proven.cast("int")).over(Window.partitionBy("stratum").orderBy("step"))
    return tested.withColumn("so_far", so_far).where("so_far = 1").groupBy("stratum").agg(F.min("test.cutoff").alias("cutoff"))


def holdouts(measured: DataFrame, labels: DataFrame, doc_id: str, stratum: str) -> DataFrame:
    """(stratum, badness, good) of the labelled documents; those that the base rules reject don't count as good."""
    graded = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"))
    own = measured.select(F.col(f"`{doc_id}`").alias("labelled"), F.col(f"`{stratum}`").cast("string").alias("stratum"), F.col("measures").alias("m"))
    return own.join(graded, "labelled").select("stratum", "m.badness", ((F.col("quality") == 1) & ~F.col("m.base_failed")).alias("good"))


def decide(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """measured with cutoff (null: none) and kept. The cutoffs are a row for each stratum."""
    found = small(cutoffs.select(F.col("stratum").alias("stratum of cutoff"), F.col("cutoff")))
    joined = measured.join(found, F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col("stratum of cutoff")), "left").drop("stratum of cutoff")
    # One comparison with columns of both sides: a filter on it stays above the join, and the text is measured once.
    limit = F.coalesce("cutoff", F.lit(float("inf")))
    return joined.withColumn("kept", F.when(F.col("measures.base_failed"), float("inf")).otherwise(F.col("measures.badness")) < limit)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: the base measures, base_failed, kept, and the badness and cutoff behind it."""
    measured = checkpointed(measure(docs.select("doc_id", "lang", "text")).drop("text"))
    cutoffs = checkpointed(calibrate(holdouts(measured, labels, "doc_id", "lang")))
    return decide(measured, cutoffs, "lang").select("doc_id", *[f"measures.{c}" for c in MEASURES], "measures.base_failed", "kept", "measures.badness", "cutoff")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    labelled = row.drop("row").join(small(labels.where("doc_id is not null").select("doc_id").distinct()), "doc_id", "left_semi")
    cutoffs = checkpointed(calibrate(holdouts(measure(labelled).drop("text"), labels, "doc_id", "lang")))
    return decide(measure(row), cutoffs, "lang").where("kept").select("row.*")
