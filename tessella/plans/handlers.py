"""Named queries of a stored collection, by the names that callers use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering, facets, features, search
from ..operators import similarity as sim


class Collection:
    """Stored articles with their n-gram vectors, computed once when first asked for."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self._vectors: DataFrame | None = None

    @property
    def vectors(self) -> DataFrame:
        if self._vectors is None:
            rows = features.exploded(self.docs, "ngram", "ngram").unionByName(features.exploded(self.docs, "entity", "entity"))
            self._vectors = features.vectors(rows, features.doc_frequency(rows), self.docs.count())
        return self._vectors


def _clustered(column: str) -> Callable:
    return lambda c, r: search.search(c.docs, r, column)


def _search_result_clusters(c: Collection, r: search.Request) -> DataFrame:
    from ..functions.text import feature_words

    wide = search.Request(r.query, r.topic, r.source, r.category, r.filters, rows=100)
    page = search.ranked(c.docs, wide)
    return clustering.result_clusters(page, clustering.phrase_clusters(page, feature_words("title")))


#: name -> function of the collection and the request (or its one argument).
HANDLERS: dict[str, Callable] = {
    "/getids": lambda c, _=None: c.docs.select("id").distinct(),
    "/unclustered": lambda c, _=None: c.docs.filter(~F.coalesce("clustered", F.lit(False))),
    "/totalcount": lambda c, _=None: c.docs.agg(F.count("*").alias("n")),
    "/ngramcount": lambda c, _=None: facets.field_facet(c.docs, "ngram"),
    "/entitycount": lambda c, _=None: facets.field_facet(c.docs, "entity"),
    "/fetchsimilardocs": lambda c, rows=10: sim.candidates(c.docs, c.vectors, rows),
    "/entities": lambda c, r: facets.field_facet(search.matching(c.docs, r), "entity", limit=100),
    "/feeds": lambda c, r: facets.field_facet(search.matching(c.docs, r), "feed", limit=100),
    "/categories": lambda c, r: facets.field_facet(search.matching(c.docs, r), "category", limit=100),
    "/searchclusters": lambda c, r: facets.top_clusters(search.matching(c.docs, r), "clusterid"),
    "/searchclustered": _clustered("clusterid"),
    "/searchmahoutclusters": lambda c, r: facets.top_clusters(search.matching(c.docs, r), "mahoutclusterid"),
    "/searchmahoutclustered": _clustered("mahoutclusterid"),
    "/searchunclustered": lambda c, r: search.search(c.docs, r),
    "/searchcarrotclustered": _search_result_clusters,
    "/mlt": lambda c, seed: search.more_like_vectors(c.docs, c.vectors, seed),
    "/terms": lambda c, prefix: search.suggest(c.docs, prefix),
}


def handler(collection: Collection, name: str) -> Callable:
    return lambda *a: HANDLERS[name](collection, *a)


def ping(collection: Collection, wanted: tuple[str, ...] = ("id", "title", "clusterid")) -> bool:
    """Whether a canned query can be answered: the collection can be read, has the fields that the others ask for, and is
    not empty."""
    try:
        return not collection.docs.select(*wanted).limit(1).isEmpty()
    except PySparkException:
        return False
