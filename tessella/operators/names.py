"""Names by the case that words have within sentences: counts over all texts, then runs of words that are names by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sentences import mark, marked, tokens
from .store import write_table

#: Capitalised uses within sentences that a name has, at least.
LEAST = 2


def bare(token: Column) -> Column:
    """A token without brackets, quotes and marks around it."""
    return F.regexp_replace(token, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")


def _first(before: Column) -> Column:
    """Whether a token begins a sentence, by the one before it (null: none)."""
    return before.isNull() | (marked(before) & (mark(before) != ""))


def _capital(w: Column) -> Column:
    """Capitalised words of tokens with their place, whether they begin a sentence, and whether a mark closes them. Tokens
    without any capital are put aside first."""
    placed = F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("x"), F.get(w, i - 1).alias("before")))
    some = F.filter(placed, lambda t: t["x"].rlike(r"\p{Lu}"))
    named = F.transform(some, lambda t: F.struct(t["at"].alias("at"), bare(t["x"]).alias("word"), _first(t["before"]).alias("first"), (~t["x"].rlike(r"[\p{L}0-9]$")).alias("closed")))
    return F.filter(named, lambda t: t["word"].rlike(r"^\p{Lu}\p{L}+$"))


def case_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, upper, lower, name): how often a word is capitalised where no sentence begins, and how often it is in small
    letters anywhere. It is a name if the former is LEAST or more, and more than the latter. Tokens are counted as they are
    written first, so patterns meet each once, not each time it occurs."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))
    each = docs.select(tokens(text).alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("x"), before.alias("before"))).alias("t")).select("t.*").filter("x is not null")
    raw = each.groupBy("x", _first(F.col("before")).alias("first")).agg(F.count("*").alias("n")).select(bare(F.col("x")).alias("word"), "first", "n")
    upper, lower = F.col("word").rlike(r"^\p{Lu}\p{L}+$"), F.col("word").rlike(r"^\p{Ll}+$")
    some = raw.filter(lower | (upper & ~F.col("first"))).groupBy(F.lower("word").alias("word"))
    counts = some.agg(F.sum(F.when(upper, F.col("n")).otherwise(0)).alias("upper"), F.sum(F.when(lower, F.col("n")).otherwise(0)).alias("lower"))
    return counts.withColumn("name", (F.col("upper") >= LEAST) & (F.col("upper") > F.col("lower")))


def entities(docs: DataFrame, counts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, entities) of every row: its distinct runs of capitalised names, in order of the alphabet. A run ends where
    a mark or a sentence does. The first word of a sentence is one only if it is a name elsewhere. Null and empty texts have none."""
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), tokens(text).alias("w"))
    rows = write_table(each.select("row", "key", _capital(F.col("w")).alias("capital")), "capital")
    words = rows.select("row", F.explode("capital").alias("t")).select("row", "t.*").withColumn("small", F.lower("word"))
    named = words.join(counts.filter("name").select(F.col("word").alias("small")), "small", "left_semi")
    order = Window.partitionBy("row").orderBy("at")
    opens = F.coalesce((F.lag("at").over(order) != F.col("at") - 1) | F.lag("closed").over(order) | F.col("first"), F.lit(True))
    runs = named.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order))
    said = runs.groupBy("row", "run").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("x")).select("row", F.array_join(F.transform("x", lambda t: t["word"]), " ").alias("entity"))
    found = said.groupBy("row").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    none = F.array().cast("array<string>")
    return rows.join(found, "row", "left").select(F.col("key").alias(key), F.coalesce("entities", none).alias("entities"))
