"""Filtered, faceted and grouped search; more-like-this, suggestions, spelling, pinning."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.querystring import Compiler, parse
from . import facets, features
from .store import write_table


@dataclass
class Request:
    """A typed search request. Filters are exact and add no score; query is a query string."""

    query: str = ""
    topic: str | None = None
    source: str | None = None
    category: str | None = None
    filters: tuple[Column, ...] = ()
    rows: int = 10
    start: int = 0


def term_filters(request: Request) -> Column:
    out = F.lit(True)
    if request.topic is not None:
        out = out & F.coalesce(F.array_contains("entitykey", request.topic), F.lit(False))
    if request.source is not None:
        out = out & F.coalesce(F.col("feedkey") == request.source, F.lit(False))
    if request.category is not None:
        out = out & F.coalesce(F.col("categorykey") == request.category, F.lit(False))
    for f in request.filters:
        out = out & f
    return out


def matching(docs: DataFrame, request: Request, compiler: Compiler | None = None) -> DataFrame:
    """docs that pass all filters and the query, with score."""
    compiler = compiler or Compiler()
    node = parse(request.query)
    return docs.filter(term_filters(request) & compiler.matches(node)).withColumn("score", compiler.score(node))


def explain(docs: DataFrame, request: Request, compiler: Compiler | None = None) -> DataFrame:
    """(id, score, parts) of the documents that match: what each clause of the query that matched has added, in the
    query's order."""
    compiler = compiler or Compiler()
    found = matching(docs, request, compiler)
    said = F.array(*[F.struct(F.lit(name).alias("clause"), value.alias("added")) for name, value in compiler.explained(parse(request.query))])
    return found.select("id", "score", F.filter(said, lambda x: x["added"] > 0).alias("parts"))


def ranked(docs: DataFrame, request: Request, compiler: Compiler | None = None) -> DataFrame:
    """One page: best score first, then id."""
    found = matching(docs, request, compiler).orderBy(F.desc("score"), "id")
    return (found.offset(request.start) if request.start else found).limit(request.rows)


def weighted_fields(terms: list[str], weights: dict[str, float]) -> Column:
    """The best field's score: the number of terms it holds times its weight."""
    each = []
    for name, weight in weights.items():
        padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
        hits = [F.when(padded.contains(f" {t.lower()} "), 1).otherwise(0) for t in terms]
        each.append(sum(hits[1:], hits[0]) * F.lit(weight))
    return F.greatest(*each) if len(each) > 1 else each[0]


def boosted(score: Column, by: str) -> Column:
    return score + F.coalesce(F.col(by).cast("double"), F.lit(0.0))


def bounding_box(lat: str, lon: str, point: tuple[float, float], km: float = 10.0) -> Column:
    """Within km north, south, east and west of a point."""
    y, x = point
    high = km / 111.19
    wide = F.lit(high) / F.cos(F.radians(F.lit(y)))
    return F.col(lat).between(y - high, y + high) & F.col(lon).between(F.lit(x) - wide, F.lit(x) + wide)


def sidebar(values: DataFrame, own_key: bool = False) -> DataFrame:
    """(name, key) of facet values; entities are their own key."""
    return values.select(F.col("value").alias("name"), (F.col("value") if own_key else text.slug("value")).alias("key"))


def search(docs: DataFrame, request: Request, cluster: str | None = None, groups: int = 10, limit: int = 100) -> dict[str, DataFrame]:
    """results (grouped if cluster names a field), entities of the results, and the three lists for all documents."""
    found = matching(docs, request)
    order = [F.desc("score"), F.asc("id")]
    results = facets.group_by_cluster(found, cluster, "score", groups) if cluster else found.orderBy(*order).offset(request.start).limit(request.rows)
    return {
        "results": results, "entities": sidebar(facets.field_facet(found, "entity", limit=limit), True),
        "topics": sidebar(facets.field_facet(docs, "entity", limit=limit)), "sources": sidebar(facets.field_facet(docs, "feed", limit=limit)),
        "categories": sidebar(facets.field_facet(docs, "category", limit=limit)),
    }


def search_clusters(docs: DataFrame, request: Request, cluster: str = "clusterid", top: int = 10, groups: int = 10) -> DataFrame:
    """Groups of the query's largest clusters, largest first: a facet picks the clusters, a semi-join their documents."""
    found = matching(docs, request)
    largest = facets.top_clusters(found, cluster, top).select(cluster)  # `top` rows
    inside = found.join(F.broadcast(largest), cluster, "left_semi")
    return facets.by_size(facets.group_by_cluster(inside, cluster, "score", groups))


def more_like_this(docs: DataFrame, column: str, seed: str, rows: int = 10, terms: int = 25) -> tuple[DataFrame, DataFrame]:
    """(id, score) of the documents like one, and the terms (feature, weight) that they were found by: of the features of
    docs (id and an array column) those of the seed that weigh most.

    Only the seed's features are looked for in the other documents, in one pass, and counted; no other is weighed.
    """
    own = features.exploded(docs.filter(F.col("id") == seed), "feature", column).select("feature")  # those of one document
    met = write_table(features.exploded(docs, "feature", column).select("id", "feature").join(F.broadcast(own), "feature"), "met")
    weight = features.idf(F.lit(docs.count()), F.col("df"))
    interesting = met.groupBy("feature").agg(F.count("*").alias("df")).select("feature", weight.alias("weight")).orderBy(F.desc("weight"), "feature").limit(terms)
    scored = met.filter(F.col("id") != seed).join(F.broadcast(interesting), "feature").groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(rows), interesting


def more_like_vectors(docs: DataFrame, v: DataFrame, seed: str, rows: int = 10, terms: int = 25) -> tuple[DataFrame, DataFrame]:
    """The same from vectors (id, feature, weight) that are there already."""
    interesting = v.filter(F.col("id") == seed).orderBy(F.desc("weight"), "feature").limit(terms).select("feature", "weight")
    hits = v.filter(F.col("id") != seed).select("id", "feature").join(F.broadcast(interesting), "feature")
    scored = hits.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("score"))
    return scored.join(docs.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(rows), interesting


def suggest(docs: DataFrame, prefix: str, column: str = "entity", limit: int = 100, as_pattern: bool = False) -> DataFrame:
    """(id, label, value) of the terms that begin with prefix, in order; the prefix is a pattern only if asked."""
    pattern = "^(?:" + (prefix if as_pattern else re.escape(prefix)) + ".*)$"
    terms = docs.select(F.explode(column).alias("term")).filter(F.col("term").rlike(pattern)).distinct().orderBy("term").limit(limit)
    return terms.select(F.col("term").alias("id"), F.col("term").alias("label"), F.concat(F.lit('"'), "term", F.lit('"')).alias("value"))


def spell(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestion): the dictionary's nearest term (term, df) by edit distance, then frequency, then spelling.

    A term is cut into most + 1 parts; of a word within `most` edits at least one part is left as it is and moved by at
    most that (Li et al., 2011). So a term is filed under each of its parts, a word looks for them where they may be, and
    they meet by equality: a few rows for each term, however long it is.
    """
    count = most + 1
    # the parts of a term of n letters: the first ones are the shorter ones
    size = lambda n, i: F.floor((n + i) / count).cast("int")
    start = lambda n, i: sum((size(n, j) for j in range(i)), F.lit(1))
    cut = lambda text, at, n: F.substring(text, at, n)
    length = F.length("term")
    filed = F.array(*[F.struct(length.alias("n"), F.lit(i).alias("i"), cut(F.col("term"), start(length, i), size(length, i)).alias("part")) for i in range(count)])
    looked = [
        F.struct(n.alias("n"), F.lit(i).alias("i"), cut(F.col("word"), start(n, i) + move, size(n, i)).alias("part"))
        for n in (F.length("word") + d for d in range(-most, most + 1)) for i in range(count) for move in range(-most, most + 1)
    ]
    left = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.array(*looked))).alias("key")).filter("key.n > 0")
    right = dictionary.select("term", "df", F.explode(filed).alias("key"))
    near = F.levenshtein("word", "term", most)
    pairs = left.join(right, "key").select("word", "term", "df").distinct().withColumn("d", near).filter(F.col("d").between(1, most))
    best = pairs.groupBy("word").agg(F.min(F.struct("d", (-F.col("df")).alias("n"), "term")).alias("x"))
    return best.select("word", F.col("x.term").alias("suggestion"), F.col("x.d").alias("distance"))


def elevate(results: DataFrame, rules: DataFrame, query: str) -> DataFrame:
    """results with the query's pinned documents first, in their order, and its excluded ones left out."""
    own = rules.filter(F.col("query") == query)
    pinned = own.filter(~F.col("exclude")).groupBy(F.col("doc_id").alias("__d")).agg(F.min("pos").alias("pin"))
    out = results.join(own.filter("exclude").select(F.col("doc_id").alias("id")), "id", "left_anti")
    return out.join(pinned, out["id"] == F.col("__d"), "left").drop("__d").orderBy(F.asc_nulls_last("pin"), F.desc("score"), "id")


def analysis(docs: DataFrame, column: str) -> DataFrame:
    """(id, stage, tokens): what each step of the analysis makes of a text."""
    from ..functions.stemmer import stem_words

    # each step works on what the one before it made
    staged = docs.select("id", text.words(column).alias("words"), text.feature_words(column).alias("features")).withColumn("stems", stem_words()("features"))
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("tokens")) for n in ("words", "features", "stems")])
    return staged.select("id", F.explode(rows).alias("x")).select("id", "x.*")
