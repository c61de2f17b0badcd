"""Cluster assignment by nearest document, batch clustering, and clustering of a result page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similarity as sim
from .ingest import first_rows
from .store import write_table


def nearest_cluster(docs: DataFrame, v: DataFrame, least: float = sim.THRESHOLD, rows: int = 10, both_parties: bool = True) -> DataFrame:
    """(id, clusterid): the stored cluster of the first candidate, in order of relevance, that is similar enough, else
    the document's own. One step from the stored ids to new ones; labels do not spread further."""
    v = write_table(v, "vectors")
    full = sim.candidates(docs, v, rows, both_parties=both_parties)
    size = sim.magnitudes(v)
    full = full.join(size.select(F.col("id").alias("a"), F.col("size").alias("sa")), "a", "left").join(size.select(F.col("id").alias("b"), F.col("size").alias("sb")), "b", "left")
    party = [c for c in ("title", "plaintiff", "defendant") if c in docs.columns]
    missing = [F.lit(None).cast("string").alias(c) for c in ("plaintiff", "defendant", "title") if c not in party]
    # only equality is asked of titles and parties, which may be long
    side = lambda name: docs.select("id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in party], *missing).alias(name)
    full = full.join(side("x"), F.col("a") == F.col("x.id")).join(side("y"), F.col("b") == F.col("y.id"))
    near = full.withColumn("similarity", sim.rule_similarity("x", "y", F.try_divide("dot", F.col("sa") * F.col("sb")))).filter(F.col("similarity") >= least)
    first = near.groupBy(F.col("a").alias("id")).agg(F.min_by("b", "rank").alias("b"))
    first = first.join(docs.select(F.col("id").alias("b"), F.col("clusterid").alias("found")), "b").select("id", "found")
    return docs.select("id", "clusterid").join(first, "id", "left").select("id", F.coalesce("found", "clusterid").alias("clusterid"))


def assign(docs: DataFrame, v: DataFrame, order: tuple[str, ...] = (), **settings) -> DataFrame:
    """docs, of several rows with one id the first by the columns in order (then by the others), with new cluster ids and
    marked as clustered."""
    own = first_rows(docs, "id", list(order))
    found = nearest_cluster(own, v, **settings).withColumnRenamed("clusterid", "__new")
    return own.join(found, "id").withColumns({"clusterid": F.col("__new"), "clustered": F.lit(True)}).select(*docs.columns)


def join_clusters(docs: DataFrame, assigned: DataFrame, column: str = "mahoutclusterid") -> DataFrame:
    """docs with a batch clustering's id, or their own id where it has none."""
    side = assigned.groupBy("id").agg(F.min("cluster").alias("__cluster"))
    return docs.join(side, "id", "left").withColumn(column, F.coalesce("__cluster", "id")).drop("__cluster")


# -- dense and sparse k-means ------------------------------------------------------------------------------------------


def kmeans(points: DataFrame, k: int, column: str = "embedding", rounds: int = 10, tolerance: float = 0.1, seed: int = 7, cosine: bool = False) -> DataFrame:
    """points with cluster, by the library's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.withColumn("__x", array_to_vector(F.col(column).cast("array<double>")))
    model = KMeans(featuresCol="__x", predictionCol="cluster", k=k, maxIter=rounds, tol=tolerance, seed=seed, distanceMeasure="cosine" if cosine else "euclidean").fit(rows)
    return model.transform(rows).drop("__x")


def default_k(n: int) -> int:
    return max(100, n // 100)


def sparse_kmeans(v: DataFrame, centres: DataFrame, rounds: int = 10, cosine: bool = True, dense: bool = False) -> DataFrame:
    """(id, cluster) by Lloyd's steps from given centres (cluster, feature, weight) over vectors (id, feature, weight).

    Distances need only shared features: |x - c|^2 = |x|^2 + |c|^2 - 2 x.c, so a step is a join on features and two
    aggregations. Ties go to the lowest cluster; a document that shares nothing with any centre goes to the shortest
    one. Centres of clusters that lose all members stay empty and attract nobody. Stops when no assignment changes. With
    dense, every vector and centre has a row for each feature, zeros included, so all of them meet. Distances are compared
    to 12 digits.
    """
    assigned = None
    x2 = v.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("x2"))
    for _ in range(rounds):
        c2 = centres.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("weight")).alias("c2"))
        base = c2.agg(F.min(F.struct("c2", "cluster")).alias("m")).select("m.*")
        dots = v.join(centres.select("cluster", "feature", F.col("weight").alias("cw")), "feature").groupBy("id", "cluster").agg(F.sum(F.col("weight") * F.col("cw")).alias("dot"))
        gap = dots.join(c2, "cluster").join(x2, "id")
        far = F.round(1 - F.coalesce(F.try_divide("dot", F.sqrt("c2") * F.sqrt("x2")), F.lit(0.0)), 12) if cosine else F.col("x2") + F.col("c2") - 2 * F.col("dot")
        near = gap.groupBy("id").agg(F.min(F.struct(far.alias("d"), F.col("cluster"))).alias("m")).select("id", F.col("m.d").alias("d"), F.col("m.cluster").alias("near"))
        alone = F.lit(1.0) if cosine else F.col("x2") + F.col("c2")
        new = x2.join(near, "id", "left").crossJoin(F.broadcast(base)).select("id", F.when(F.lit(dense) | (F.col("d") <= alone), F.col("near")).otherwise(F.col("cluster")).alias("cluster"))
        new = write_table(new, "assigned")
        if assigned is not None and assigned.exceptAll(new).isEmpty():
            return new
        assigned = new
        size = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
        centres = v.join(assigned, "id").groupBy("cluster", "feature").agg(F.sum("weight").alias("s")).join(size, "cluster").select("cluster", "feature", (F.col("s") / F.col("n")).alias("weight"))
    return assigned


def literal_centres(v: DataFrame, k: int, seed: int = 7, more_than: float = 3.0) -> DataFrame:
    """(cluster, feature, weight): centres drawn evenly between each feature's least and greatest weight, of features
    whose greatest is above more_than. IDF weights are constant, so all centres coincide; kept for comparison only."""
    span = v.groupBy("feature").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).filter(F.col("hi") > more_than)
    drawn = span.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return drawn.select("cluster", "feature", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.rand(seed)).alias("weight"))


# -- canopies ----------------------------------------------------------------------------------------------------------


def canopy_centres(points: np.ndarray, t1: float, t2: float) -> np.ndarray:
    """Rows that start a canopy, in order: a point within t2 of an earlier centre starts none. Cosine distance."""
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    centres: list[int] = []
    for i in range(len(unit)):
        if not centres or (1 - unit[centres] @ unit[i]).min() >= t2:
            centres.append(i)
    return np.array(centres, int)


def canopy(points: DataFrame, t1: float, t2: float, column: str = "embedding", key: str = "vec_id", most: int = 20_000, compat: bool = False) -> DataFrame:
    """(key, canopy) of all points within t1 of a centre, after McCallum, Nigam and Ungar (2000).

    The pass is sequential by nature: it runs in the order of key over a bounded, hashed sample (all points, up to
    about `most`) and gives centres; the points that are not within t2 of one are sampled in turn, until none is left.
    Then all points are assigned in parallel, in Arrow batches. A zero vector is near nothing and in no canopy. t1 below
    t2 leaves points in no canopy and is refused unless compat.
    """
    if t1 < t2 and not compat:
        raise ValueError("t1 must be at least t2")
    points = points.filter(F.col(column).isNotNull())
    context, left = points.sparkSession.sparkContext, points.select(key, column)
    names, centres = [], []

    def distances(frame: pd.DataFrame, starts: np.ndarray) -> np.ndarray:
        unit = starts / np.maximum(np.linalg.norm(starts, axis=1, keepdims=True), 1e-12)
        y = np.stack(frame[column].to_list()).astype(float) if len(frame) else np.zeros((0, unit.shape[1]))
        return 1 - (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)) @ unit.T

    def far(shared):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame[(distances(frame, shared.value) >= t2).all(axis=1)]

        return run

    while total := left.count():
        drawn = F.pmod(F.xxhash64(key, *([F.lit(len(names))] if names else [])), F.lit(1 << 20)) < max(1, int(min(1.0, most / total) * (1 << 20)))
        sample = left.filter(drawn).orderBy(key).toArrow()
        x = np.array(sample[column].to_pylist(), float)
        at = canopy_centres(x, t1, t2) if len(x) else np.zeros(0, int)
        names.append(np.array(sample[key].to_pylist())[at] if len(at) else np.zeros(0))
        centres.append(x[at])
        if total <= most:
            break
        left = left.filter(~drawn)
        left = write_table(left.mapInPandas(far(context.broadcast(x[at])), left.schema) if len(at) else left, "far")
    some = [i for i, x in enumerate(centres) if len(x)]
    shared = context.broadcast((np.concatenate([names[i] for i in some]), np.concatenate([centres[i] for i in some])) if some else (np.zeros(0), np.zeros((0, 1))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, starts = shared.value
        for frame in frames:
            row, col = np.nonzero(distances(frame, starts) < t1)
            yield pd.DataFrame({key: frame[key].to_numpy()[row], "canopy": keys[col]})

    schema = T.StructType([T.StructField(key, points.schema[key].dataType), T.StructField("canopy", points.schema[key].dataType)])
    return points.select(key, column).mapInPandas(run, schema)


#: Bytes of centres up to which they are broadcast.
CENTRES = 64 << 20


def dense_kmeans(points: DataFrame, centres: DataFrame, column: str = "embedding", key: str = "vec_id", rounds: int = 10) -> DataFrame:
    """(key, cluster) by Lloyd's steps with cosine distance from given centres (cluster, vector), as sparse_kmeans(): ties
    go to the lowest cluster, and centres that lose all members stay where they are and attract nobody.

    Points are multiplied with all centres batch by batch, and a batch gives sums by cluster, so a round moves a few
    numbers for each batch and cluster. Centres of more than CENTRES bytes are joined feature by feature instead. Stops
    when no assignment changes. A point or a centre of length 0 is at distance 1 of all. Both ways give the same clusters.
    """
    points = points.select(F.col(key), F.col(column).cast("array<double>").alias("x")).filter("x is not null")
    centres = write_table(centres.select("cluster", F.col("vector").cast("array<double>").alias("vector")), "centres")
    size = centres.agg(F.count("*"), F.max(F.size("vector"))).first()
    if size[0] * (size[1] or 0) * 8 > CENTRES:
        long = lambda df, name, x: df.select(F.col(name), F.posexplode(x).alias("feature", "weight"))
        return sparse_kmeans(long(points, key, "x").withColumnRenamed(key, "id"), long(centres, "cluster", "vector"), rounds, dense=True).withColumnRenamed("id", key)
    names = T.StructType([T.StructField(key, points.schema[key].dataType), T.StructField("cluster", centres.schema["cluster"].dataType)])
    assigned = None
    for _ in range(rounds):
        have = centres.orderBy("cluster").toArrow()  # of a checked size
        shared = points.sparkSession.sparkContext.broadcast((np.array(have["cluster"].to_pylist()), np.array(have["vector"].to_pylist(), float)))

        def unit(x: np.ndarray) -> np.ndarray:
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        def nearest(frame: pd.DataFrame, shared=shared) -> tuple[np.ndarray, np.ndarray]:
            x = np.stack(frame["x"].to_list())
            return x, np.round(1 - unit(x) @ unit(shared.value[1]).T, 12).argmin(1)

        def label(frames: Iterator[pd.DataFrame], nearest=nearest, shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({key: frame[key], "cluster": shared.value[0][nearest(frame)[1]]})

        def add_up(frames: Iterator[pd.DataFrame], nearest=nearest, shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x, at = nearest(frame)
                    some, back, n = np.unique(at, return_inverse=True, return_counts=True)
                    sums = np.zeros((len(some), x.shape[1]))
                    np.add.at(sums, back, x)
                    yield pd.DataFrame({"cluster": shared.value[0][some], "n": n, "sums": list(sums)})

        new = write_table(points.mapInPandas(label, names), "assigned")
        if assigned is not None and assigned.exceptAll(new).isEmpty():
            return new
        assigned = new
        parts = points.mapInPandas(add_up, T.StructType([names["cluster"], *T.StructType.fromDDL("n long, sums array<double>")]))
        each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
        moved = each.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector"))
        centres = write_table(moved, "centres")
    return assigned


def canopy_kmeans(points: DataFrame, t1: float = 0.75, t2: float = 0.7, column: str = "embedding", key: str = "vec_id", rounds: int = 10) -> DataFrame:
    """(key, cluster): k-means whose first centres are the canopies' centres."""
    members = canopy(points, t1, t2, column, key)
    first = points.join(members.select(F.col("canopy").alias(key)).distinct(), key, "left_semi")
    return dense_kmeans(points, first.select(F.col(key).alias("cluster"), F.col(column).alias("vector")), column, key, rounds)


def batch_clusters(points: DataFrame, method: str = "canopy+kmeans", key: str = "vec_id", column: str = "embedding", **settings) -> DataFrame:
    """(id, cluster) by canopies and k-means, canopies alone (the first of a point's), or k-means alone (default_k() of the
    points unless k is given)."""
    if method == "canopy+kmeans":
        out = canopy_kmeans(points, key=key, column=column, **settings).select(F.col(key).alias("id"), "cluster")
    elif method == "canopy":
        out = canopy(points, settings.get("t1", 0.8), settings.get("t2", 0.7), column, key).groupBy(F.col(key).alias("id")).agg(F.min("canopy").alias("cluster"))
    elif method == "kmeans":
        out = kmeans(points, settings.get("k") or default_k(points.count()), column, settings.get("rounds", 10), settings.get("tolerance", 0.1)).select(F.col(key).alias("id"), "cluster")
    else:
        raise ValueError(f"unknown method {method}")
    return out.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("mahout"), F.col("cluster").cast("string")).alias("cluster"))


# -- suffix-tree style clustering of a result page -----------------------------------------------------------------------


def phrase_clusters(page: DataFrame, words: Column, base: int = 20, overlap: float = 0.5, most_words: int = 4, labels: int = 3) -> DataFrame:
    """(cluster, label, docs, score) of a page of results, after Zamir and Etzioni (1998).

    Phrases of one to most_words words in at least two documents are base clusters, scored by documents times length;
    the best `base` of them merge where each holds more than `overlap` of the other. page is a page: a bounded number
    of rows; so are the base clusters.
    """
    from ..functions.text import ngrams

    phrases = page.select("id", F.explode(F.array_distinct(ngrams(words, 1, most_words))).alias("phrase"))
    length = F.size(F.split("phrase", " "))
    of = phrases.groupBy("phrase").agg(F.sort_array(F.collect_set("id")).alias("docs")).filter(F.size("docs") >= 2)
    scored = of.withColumn("score", F.size("docs") * F.when(length == 1, 0.5).otherwise(length))
    best = scored.orderBy(F.desc("score"), "phrase").limit(base).collect()  # at most `base` rows
    groups = list(range(len(best)))

    def root(i: int) -> int:
        while groups[i] != i:
            i = groups[i]
        return i

    for i, a in enumerate(best):
        for j in range(i):
            both = len(set(a.docs) & set(best[j].docs))
            if both > overlap * len(a.docs) and both > overlap * len(best[j].docs):
                first, second = sorted((root(i), root(j)))
                groups[second] = first
    rows = []
    for r in sorted({root(i) for i in range(len(best))}):
        members = [best[i] for i in range(len(best)) if root(i) == r]
        rows.append((r, " ".join(m.phrase for m in members[:labels]), sorted({d for m in members for d in m.docs}), float(sum(m.score for m in members))))
    return page.sparkSession.createDataFrame(rows, "cluster int, label string, docs array<string>, score double")


def result_clusters(page: DataFrame, clusters: DataFrame, most: int = 8) -> DataFrame:
    """(label, docs) with the documents of each cluster in its order, the first `most`; ids not on the page are left out."""
    each = clusters.select("cluster", "label", F.posexplode("docs").alias("pos", "id")).join(page.select("id", F.struct("*").alias("doc")), "id")
    ordered = each.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy("pos"))).filter(F.col("n") <= most)
    listed = ordered.groupBy("cluster", "label").agg(F.sort_array(F.collect_list(F.struct("n", "doc"))).alias("x"))
    return listed.select("cluster", "label", F.transform("x", lambda x: x["doc"]).alias("docs"))
