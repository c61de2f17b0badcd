"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FEEDS = _struct(feed=_S, rss=_S, name=_S, category=_S)
RAW_ITEMS = _struct(
    feed=_S, seq=T.LongType(), link=_S, title=_S, summary=_S, description=_S, author=_S, category=_S, published=_S, updated=_S, created=_S, date=_S
)
ARTICLES = _struct(
    id=_S, title=_S, summary=_S, body=_S, author=_S, feed=_S, feedlink=_S, link=_S, feedkey=_S, category=_S, categorykey=_S, entity=_A, entitykey=_A, ngram=_A,
    plaintiff=_S, defendant=_S, date=T.TimestampType(), clustered=T.BooleanType(), clusterid=_S, mahoutclusterid=_S,
)
FEATURES = _struct(id=_S, kind=_S, feature=_S, weight=T.DoubleType())
ELEVATE = _struct(query=_S, doc_id=_S, pos=T.IntegerType(), exclude=T.BooleanType())
SYNONYMS = _struct(src=_S, dst=_A)
