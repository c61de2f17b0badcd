"""From feed items to stored articles: ids, keys, text, features, de-duplication, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, stemmer, text


def copy_missing(item: DataFrame, feed: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Fields of the feed where the item has none; feeds are a definition list, so their side is small, and the
    optimizer broadcasts it if it is."""
    side = feed.select(F.col(on).alias("__on"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = item.join(side, item[on] == F.col("__on"), "left")
    present = set(item.columns)
    filled = {f: F.coalesce(F.col(f), F.col(f"__{f}")) if f in present else F.col(f"__{f}") for f in fields}
    return out.withColumns(filled).drop("__on", *[f"__{f}" for f in fields])


def item_id() -> Column:
    """The link as an id, or the title's slug where there is no link."""
    return F.coalesce(text.id_slug("link"), text.slug("title"))


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of several rows with one key the first in the given order, ties by the other columns from left to right; a null
    comes before all values.

    The first is picked by a partial minimum of (order, rest of the row) before any shuffle, so a popular key costs a row
    for each task, not a sort of all its copies.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    if not [*order, *rest]:
        return df.distinct()
    least = F.min(F.struct(*[F.struct(F.col(c).isNotNull().alias("n"), F.col(c).alias("v")).alias(c) for c in [*order, *rest]])).alias("x")
    return df.groupBy(key).agg(least).select(key, *[F.col(f"x.{c}.v").alias(c) for c in [*order, *rest]]).select(*df.columns)


def new_items(items: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Items whose id is not stored yet; of several with one id the first in the given order."""
    return first_rows(items, "id", order).join(existing.select("id").distinct(), "id", "left_anti").select(*items.columns)


def analyse(items: DataFrame, stemmed: bool = True) -> DataFrame:
    """Items with id, stripped summary, body and n-grams of the title."""
    rows = items.withColumn("id", item_id()).withColumn("summary", markup.strip_html(F.coalesce("summary", "description")))
    rows = rows.withColumn("body", F.col("summary"))
    if not stemmed:
        return rows.withColumn("ngram", text.with_fallback(text.title_ngrams("title"), "id"))
    kept = F.filter("__w", lambda w: ~w.rlike("^[0-9]+$"))
    rows = rows.withColumn("__w", stemmer.stem_words()(text.feature_words("title")))
    return rows.withColumn("ngram", text.with_fallback(text.title_ngrams("title", w=kept), "id")).drop("__w")


def to_articles(items: DataFrame) -> DataFrame:
    """Stored form of analysed items: keys, date, parties, both cluster ids from the title, not clustered yet."""
    party = text.parties("title")
    key = text.slug("title")
    none = F.lit(None).cast("array<string>")
    columns = set(items.columns)
    optional = lambda c, default: F.col(c) if c in columns else default
    dates = [c for c in ("published", "updated", "created", "date") if c in columns]
    return items.select(
        "id", "title", "summary", "body", "author", "feed", optional("feedlink", F.lit(None).cast("string")).alias("feedlink"), "link",
        text.slug("feed").alias("feedkey"), "category", text.slug("category").alias("categorykey"), optional("entity", none).alias("entity"), optional("entitykey", none).alias("entitykey"),
        "ngram", party["plaintiff"].alias("plaintiff"), party["defendant"].alias("defendant"), text.feed_date(*dates).alias("date"), F.lit(False).alias("clustered"),
        key.alias("clusterid"), key.alias("mahoutclusterid"),
    )


def process_items(items: DataFrame, feeds: DataFrame, existing: DataFrame, stemmed: bool = True) -> DataFrame:
    """All feeds in one plan: feed attributes, analysis, new ones only, stored form."""
    rows = copy_missing(items, feeds, "feed", ["name", "category"])
    rows = analyse(rows, stemmed)
    return to_articles(new_items(rows, existing, ["feed", "seq"]))


def upsert(stored: DataFrame, changed: DataFrame, version: str) -> DataFrame:
    """stored with the rows of changed in place of those with the same id; of several the greatest version wins, and of
    several with that the greatest row by its columns from left to right."""
    rest = [c for c in changed.columns if c not in ("id", version)]
    newest = changed.groupBy("id").agg(F.max(F.struct(version, *rest)).alias("x")).select("id", "x.*").select(*[c for c in stored.columns])
    return stored.join(newest.select("id"), "id", "left_anti").select(*stored.columns).unionByName(newest)


def quarantine(items: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the bad ones aside."""
    return items.filter(~F.coalesce(bad, F.lit(True))), items.filter(F.coalesce(bad, F.lit(True)))
