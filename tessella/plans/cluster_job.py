"""The batch job: frequencies, new documents, batch clusters, nearest clusters, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering, features


def run(stored: DataFrame, batch: DataFrame | None = None, **settings) -> DataFrame:
    """stored with new cluster ids for documents that are not clustered yet; batch: (id, cluster) of another method.

    Candidates are all stored documents, and all read the stored ids, so the result does not depend on any order.
    """
    rows = features.exploded(stored, "ngram", "ngram").unionByName(features.exploded(stored, "entity", "entity"))
    v = features.vectors(rows, features.doc_frequency(rows), stored.count())
    new = stored.filter(~F.coalesce("clustered", F.lit(False))).select("id")
    if batch is not None:
        stored = clustering.join_clusters(stored, batch)
    found = clustering.nearest_cluster(stored, v, **settings).join(new, "id", "left_semi").withColumnRenamed("clusterid", "__new")
    out = stored.join(found, "id", "left")
    return out.withColumns({"clusterid": F.coalesce("__new", "clusterid"), "clustered": F.col("clustered") | F.col("__new").isNotNull()}).select(*stored.columns)
