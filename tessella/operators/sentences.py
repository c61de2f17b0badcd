"""Sentence boundaries learnt from the texts themselves, after Kiss and Strunk (2006): counts by type, log-likelihoods, rules.

A token is a run without white space; its type is its lower case without brackets and quotes around it and the dot behind it.
Abbreviations are types that stand with a dot far more often than chance has it; starters are types that follow
sentence ends, collocations are pairs around a dot, more often than chance has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import write_table

#: Thresholds of the paper, and how often a type that is an abbreviation stands with its dot.
ABBREVIATION, STARTER, COLLOCATION, ALWAYS = 0.3, 30.0, 7.88, 0.99
SPACE = r"[\x20\x09-\x0D]+"
_OPEN, _CLOSE = r"^[\"'(\[]+", r"[\"')\]]+$"
NUMBER = "##"


def tokens(c: Column | str) -> Column:
    """Runs without white space; a null or empty text has none."""
    return F.array_remove(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), SPACE), "")


def marked(token: Column) -> Column:
    """Whether a token has any mark in it, as all have that end with one: a cheap test before mark()."""
    return token.contains(".") | token.contains("!") | token.contains("?")


def followed(w: str) -> Column:
    """Each token (a) of an array column with the one behind it (b, null for the last)."""
    return F.arrays_zip(F.col(w).alias("a"), F.slice(w, 2, F.size(w)).alias("b"))


def mark(token: Column) -> Column:
    """How a token ends: '.' (a single dot), '!' (a mark of exclamation or question), '' else."""
    bare = F.regexp_replace(token, _CLOSE, "")
    return F.when(bare.rlike(r"[!?]$"), "!").when(bare.rlike(r"(^|[^.])\.$"), ".").otherwise("")


def kind(token: Column) -> Column:
    """A token's type; all numbers are one."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, _OPEN, ""), _CLOSE, ""), r"[.!?,;:]+$", ""))
    return F.when(bare.rlike(r"^[0-9]([0-9.,]*[0-9])?$"), NUMBER).otherwise(bare)


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, mark, next, n): how often each type ends in each way, and before which type if it ends a sentence or
    might (next is null elsewhere, and at a text's end). One scan; partial counts by task. Tokens are counted as they are
    written first, so patterns meet each once, not each time it occurs."""
    pairs = docs.select(tokens(text).alias("w")).select(F.explode(followed("w")).alias("p")).select("p.*")
    raw = pairs.groupBy("a", F.when(marked(F.col("a")), F.col("b")).alias("b")).agg(F.count("*").alias("n"))
    raw = raw.select(kind(F.col("a")).alias("type"), mark(F.col("a")).alias("mark"), "b", "n")
    return raw.groupBy("type", "mark", F.when(F.col("mark") != "", kind(F.col("b"))).alias("next")).agg(F.sum("n").alias("n"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, dotted, plain, score, abbreviation) of each type that stands with a dot at least once and has a letter.

    score is the log-likelihood ratio of always standing with the dot against doing so as all tokens do, scaled down
    for long types and for each time the type stands without, and up for dots inside.
    """
    types = write_table(counts.groupBy("type").agg(F.sum(F.when(F.col("mark") == ".", F.col("n")).otherwise(0)).alias("dotted"), F.sum("n").alias("n")), "types")
    every, dots = types.agg(F.sum("n"), F.sum("dotted")).first()
    of = types.filter((F.col("dotted") > 0) & F.col("type").rlike(r"\p{L}"))
    if not dots or dots == every:
        share = F.lit(0.5)  # no type stands out
    else:
        share = F.lit(dots / every)
    k, rest = F.col("dotted"), F.col("n") - F.col("dotted")
    ratio = 2 * (k * F.log(F.lit(ALWAYS)) + rest * F.log(F.lit(1 - ALWAYS)) - k * F.log(share) - rest * F.log(1 - share))
    inner = F.regexp_count("type", F.lit(r"\."))
    length = F.length("type") - inner
    score = ratio * F.exp(-length) * (inner + 1) * F.pow(length.cast("double"), -rest)
    return of.select("type", "dotted", rest.alias("plain"), score.alias("score"), (score >= ABBREVIATION).alias("abbreviation"))


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of two events seen a, b and both times of n; 0 where they avoid each other."""

    def part(k: Column, m: Column, p: Column) -> Column:
        hit = F.when(k > 0, k * F.log(p)).otherwise(0.0)
        return hit + F.when(m > k, (m - k) * F.log(1 - p)).otherwise(0.0)

    alone, rest = b - both, n - a
    ratio = 2 * (part(both, a, both / a) + part(alone, rest, alone / rest) - part(both, a, b / n) - part(alone, rest, b / n))
    return F.when((rest > 0) & (both * n > a * b), ratio).otherwise(0.0)


@dataclass
class Model:
    """Types that are abbreviations; (type, score) of sentence starters; (type, next, score) of pairs around a dot."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def train(docs: DataFrame, text: str = "text") -> Model:
    """A model of all texts. Counts are aggregates by type and pair; three totals come to the driver."""
    counts = write_table(token_counts(docs, text), "token_counts")
    short = write_table(abbreviations(counts).filter("abbreviation").select("type"), "abbreviations")
    types = counts.groupBy("type").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    pairs = counts.filter("next is not null").join(short.withColumn("short", F.lit(True)), "type", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    single = F.col("type").rlike(r"^\p{L}$") | (F.col("type") == NUMBER)
    ends = pairs.filter((F.col("mark") == "!") | ~(F.col("short") | single))
    after = ends.groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("both"))
    breaks = ends.agg(F.sum("n")).first()[0] or 0
    known = after.join(types, "type").filter(F.col("type").rlike(r"^\p{L}"))
    score = association(F.lit(breaks), F.col("n"), F.col("both"), F.lit(total))
    starters = write_table(known.select("type", score.alias("score")).filter(F.col("score") >= STARTER), "starters")
    around = pairs.filter((F.col("mark") == ".") & (F.col("short") | single)).groupBy("type", "next").agg(F.sum("n").alias("both")).join(starters.select(F.col("type").alias("next")), "next", "left_anti")
    around = around.join(types.withColumnRenamed("n", "a"), "type").join(types.select(F.col("type").alias("next"), F.col("n").alias("b")), "next")
    score = association(F.col("a"), F.col("b"), F.col("both"), F.lit(total))
    near = around.select("type", "next", score.alias("score")).filter((F.col("score") >= COLLOCATION) & F.col("next").rlike(r"^[\p{L}#]"))
    return Model(short, starters, write_table(near, "collocations"))


def split(docs: DataFrame, model: Model, key: str = "id", text: str = "text") -> DataFrame:
    """(key, sentences) of every row; white space within a sentence becomes single spaces. Null and empty texts have none.

    A mark of exclamation or question ends a sentence. A dot does, but for three cases: behind an abbreviation only a
    capitalised starter ends it; behind a single letter or a number neither a small letter nor a collocation does.
    """
    rows = write_table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), tokens(text).alias("w")), "tokens")
    every = rows.select("row", F.posexplode(followed("w")).alias("at", "p")).select("row", "at", "p.*")
    ends = every.filter(marked(F.col("a")) & F.col("b").isNotNull() & (mark(F.col("a")) != ""))
    ends = ends.select("row", "at", kind(F.col("a")).alias("type"), mark(F.col("a")).alias("mark"), kind(F.col("b")).alias("next"), F.regexp_replace("b", _OPEN, "").alias("b"))
    ends = ends.join(model.abbreviations.withColumn("short", F.lit(True)), "type", "left").join(model.starters.select(F.col("type").alias("next"), F.lit(True).alias("starts")), "next", "left")
    ends = ends.join(model.collocations.select("type", "next", F.lit(True).alias("near")), ["type", "next"], "left")
    single = F.col("type").rlike(r"^\p{L}$") | (F.col("type") == NUMBER)
    cut = (
        F.when(F.col("mark") == "!", True).when(F.col("short"), F.coalesce("starts", F.lit(False)) & F.col("b").rlike(r"^\p{Lu}") & F.col("near").isNull())
        .when(single, F.col("near").isNull() & ~F.col("b").rlike(r"^\p{Ll}")).otherwise(True)
    )
    cuts = ends.filter(cut).groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("cuts"))
    size = F.size("w")
    found = rows.join(cuts, "row", "left").withColumn("ends", F.when(size > 0, F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array(size - 1))).otherwise(F.array().cast("array<int>")))
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1) + 1)
    parts = F.transform("ends", lambda e, i: F.array_join(F.slice("w", begin(i) + 1, e - begin(i) + 1), " "))
    return found.select(F.col("key").alias(key), parts.alias("sentences"))
