"""A sorted table of terms for prefixes and spelling, and the collation of several words by how often they stand together."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path

#: Candidates that are looked at for each word of a query, and edits that they may be away.
CANDIDATES, EDITS = 5, 2


@dataclass
class Terms:
    """Tables in a folder: `terms` (term, df), in ranges and in order of term, so that a prefix is a range of few row
    groups; `pairs` (a, b, n), words that stand next to each other, in order of a."""

    spark: SparkSession
    path: str

    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long").parquet(f"{self.path}/terms")

    def pairs(self) -> DataFrame:
        return self.spark.read.schema("a string, b string, n long").parquet(f"{self.path}/pairs")


def build(docs: DataFrame, path: str | None = None, pairs: bool = True) -> Terms:
    """The tables of docs (id, w: words); counts are aggregates, whatever a term's share of documents. Prefixes and
    candidates need no pairs, so where nothing is collated they can be left out."""
    spark = docs.sparkSession
    out = Terms(spark, path or new_path(spark, "terms"))
    df = docs.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df.repartitionByRange("term").sortWithinPartitions("term").write.option("parquet.block.size", str(4 << 20)).parquet(f"{out.path}/terms")
    if not pairs:
        return out
    beside = docs.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(0))).alias("b"))).alias("p")).select("p.*").filter("b is not null")
    counted = beside.groupBy("a", "b").agg(F.count("*").alias("n"))
    counted.repartitionByRange("a").sortWithinPartitions("a", "b").write.option("parquet.block.size", str(4 << 20)).parquet(f"{out.path}/pairs")
    return out


def after_prefix(prefix: str) -> str | None:
    """The first text, in order of code points, behind all that begin with prefix; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            following = ord(prefix[i]) + 1
            return prefix[:i] + chr(0xE000 if following == 0xD800 else following)
    return None


def suggest(terms: Terms, prefix: str, limit: int = 10) -> DataFrame:
    """(term, df) of the terms that begin with prefix, those in most documents first, then in order. The range that the
    prefix spans is asked of the files' statistics, so other row groups are not read."""
    found = terms.terms().filter(F.col("term") >= prefix)
    end = after_prefix(prefix)
    if end is not None:
        found = found.filter(F.col("term") < end)
    return found.orderBy(F.desc("df"), "term").limit(limit)


def candidates(terms: Terms, words: list[str], most: int = CANDIDATES, edits: int = EDITS) -> DataFrame:
    """(place, word, term, distance, df): for each word of a query the terms nearest to it, itself if it is one: by edits,
    then by documents, then in order. One pass over the terms."""
    asked = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(w).alias("word")) for i, w in enumerate(words)])
    near = terms.terms().select("term", "df", F.explode(asked).alias("q")).select("q.*", "term", "df")
    near = near.withColumn("distance", F.levenshtein("word", "term", edits)).filter("distance >= 0")
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", (-F.col("df")).alias("less"), "term", "df"))), 1, most)
    # few terms are within so few edits of a word
    each = near.groupBy("place", "word").agg(best.alias("best")).select("place", "word", F.explode("best").alias("x"))
    return each.select("place", "word", "x.term", "x.distance", "x.df")


def collate(terms: Terms, words: list[str], most: int = CANDIDATES, edits: int = EDITS) -> list[str]:
    """The words of a query, each replaced by one of its candidates, so that neighbours stand together most often in the
    texts: the greatest sum of ln(1 + n), then the fewest edits, then in order. A word without candidates stays.

    Of the texts' pairs only those of candidates are read; these and the candidates, at most `most` a word, come to
    the driver, where the best chain is found word by word.
    """
    if not words:
        return []
    found: list[list[tuple[str, int]]] = [[] for _ in words]
    for r in candidates(terms, words, most, edits).collect():
        found[r.place].append((r.term, r.distance))
    choices = [sorted(x) or [(w, 0)] for x, w in zip(found, words)]
    first, second = sorted({t for x in choices[:-1] for t, _ in x}), sorted({t for x in choices[1:] for t, _ in x})
    near = terms.pairs().filter(F.col("a").isin(first) & F.col("b").isin(second)) if first and second else None
    n = {(r.a, r.b): r.n for r in near.collect()} if near is not None else {}
    chains = {t: (0.0, d, [t]) for t, d in choices[0]}
    for options in choices[1:]:
        chains = {t: min(((s - math.log1p(n.get((c[-1], t), 0)), e + d, [*c, t]) for s, e, c in chains.values()), key=lambda x: (round(x[0], 9), *x[1:])) for t, d in options}
    return min(chains.values(), key=lambda x: (round(x[0], 9), *x[1:]))[2]
