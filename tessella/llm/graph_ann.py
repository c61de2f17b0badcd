"""Approximate nearest neighbours by inner product: robust-pruned directed graphs (Subramanya et al., DiskANN, 2019).

Vectors are dealt to shards by their number of components, by their length (a shard's differ by at most the root of two)
and by a hash of their id. A shard's distinct directions get a graph: points are inserted in batches; a greedy beam search
over the graph so far proposes neighbours, and relaxed pruning keeps an edge only if no kept edge's end is nearer to the
candidate by a factor, which leaves diverse edges; freed places go to the nearest of the rest. The beam search that
answers queries goes along the edges by inner product. As lengths in a shard hardly differ, neighbours by direction lead
to it; one graph for vectors of all lengths would lead to the longest ones, whatever the query.

A shard's index is loaded once by a task, which queries then stream past in batches, each batch searched at once. Equal
vectors are one point with a list of ids, so a group of copies costs one place in the graph however large it is. Found
points are scored on the original vectors in double precision, and each query's lists from all shards merge by score,
then id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shuffle_parts, small_batches, write_table

DEGREE, BEAM, RELAX = 32, 72, 1.2
#: Shards that vectors are dealt to at least, and bytes of vectors and edges that a shard holds on average at most.
SHARDS, SHARD_BYTES = 12, 8 << 20


def directions(x: np.ndarray) -> np.ndarray:
    """The rows of x at length 1."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nearest points met, nearest first (-1 where fewer), and their squared distances, or with inner
    -2 times their inner products.

    graph: neighbours by row, -1 where fewer. All queries of the call step together.
    """
    m, n = len(queries), len(points)
    lengths, own = (np.zeros(k, np.float32) if inner else (x * x).sum(1) for k, x in ((n, points), (m, queries)))
    ids = np.full((m, beam), -1, np.int64)
    far = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    far[:, 0] = lengths[start] - 2 * (queries @ points[start]) + own
    met = np.zeros((m, n), bool)
    met[:, start] = True
    live = np.arange(m)
    while len(live):
        open_far = np.where(done[live], np.inf, far[live])
        at = open_far.argmin(1)
        some = np.isfinite(open_far[np.arange(len(live)), at])
        live, at = live[some], at[some]
        if not len(live):
            break
        done[live, at] = True
        near = graph[ids[live, at]]
        fresh = near >= 0
        fresh &= ~met[live[:, None], near]
        rows, cols = np.nonzero(fresh)
        met[live[rows], near[rows, cols]] = True
        d = np.full(near.shape, np.inf, np.float32)
        who = near[rows, cols]
        d[rows, cols] = lengths[who] - 2 * np.einsum("ij,ij->i", points[who], queries[live[rows]]) + own[live[rows]]
        all_far = np.concatenate([far[live], d], 1)
        pick = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        take = lambda a: np.take_along_axis(a, pick, 1)
        ids[live] = take(np.concatenate([ids[live], np.where(fresh, near, -1)], 1))
        done[live] = take(np.concatenate([done[live], ~fresh], 1))
        far[live] = take(all_far)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    return np.where(np.isfinite(far), ids, -1), far


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Neighbours of the points `of` from their candidates (-1: none), diverse ones first, then the nearest others."""
    m, width = candidates.shape
    candidates = np.sort(candidates, 1)
    twice = np.zeros_like(candidates, bool)
    twice[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    bad = (candidates < 0) | twice | (candidates == of[:, None])
    near = points[candidates]
    gap = near - points[of][:, None, :]
    d = np.where(bad, np.inf, np.einsum("ijk,ijk->ij", gap, gap))
    order = np.argsort(d, 1, kind="stable")[:, : max(2 * degree, 48)]
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    lengths = np.einsum("ijk,ijk->ij", near, near)
    rank = np.full(d.shape, np.inf)  # the order in which candidates are kept
    alive = np.isfinite(d)
    rows = np.arange(m)
    for k in range(min(degree, d.shape[1])):
        at = np.where(alive, d, np.inf).argmin(1)
        some = alive[rows, at]
        if not some.any():
            break
        rank[rows[some], at[some]] = k
        kept = near[rows, at]
        between = lengths + lengths[rows, at][:, None] - 2 * np.einsum("ijk,ik->ij", near, kept)
        alive &= ~(some[:, None] & (relax * relax * between <= d))
        alive[rows, at] = False
    # freed places go to the nearest that were pruned
    rank = np.where(np.isfinite(d) & ~np.isfinite(rank), degree + np.arange(d.shape[1]), rank)
    order = np.argsort(rank, 1, kind="stable")[:, :degree]
    out = np.where(np.isfinite(np.take_along_axis(rank, order, 1)), np.take_along_axis(candidates, order, 1), -1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 0) -> tuple[np.ndarray, int]:
    """The graph of the points and its entry, the point nearest to their mean."""
    n = len(points)
    rng = np.random.default_rng(seed)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    if n < 2:
        return graph, start
    order = rng.permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done, size = 1, 8
    while done < n:  # batches double, so early points see few others and late ones many
        batch = order[done : done + size]
        proposed, _ = beam_search(points, graph, start, points[batch], beam)
        # points of one batch do not see each other; some at random stand in
        mates = batch[rng.integers(0, len(batch), (len(batch), 4))]
        graph[batch] = robust_prune(points, batch, np.concatenate([proposed, mates], 1), degree, relax)
        src, dst = np.repeat(batch, degree), graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        place = np.arange(len(dst)) - np.repeat(heads, np.diff(np.append(heads, len(dst))))
        targets = dst[heads]
        for lo in range(0, int(place.max(initial=0)) + 1, degree):  # many new edges into one point come in rounds
            part = (place >= lo) & (place < lo + degree)
            hit = np.unique(dst[part])
            back = np.full((len(hit), degree), -1, np.int64)
            back[np.searchsorted(hit, dst[part]), place[part] - lo] = src[part]
            for a in range(0, len(hit), 512):
                some = hit[a : a + 512]
                graph[some] = robust_prune(points, some, np.concatenate([graph[some], back[a : a + 512]], 1), degree, relax)
        del targets
        done += len(batch)
        size = min(2 * size, 512)
    return graph, start


_KEY = "width int, band int, part int"
_INDEX = f"{_KEY}, vectors binary, graph binary, entry int, ends binary, ids binary"


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, their number (width) and twice the binary logarithm of their length (band), without null ids
    and vectors that take no part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    # the largest component sets the scale, so that no square is too large or too small
    top = F.array_max(F.transform("embedding", lambda v: F.abs(v)))
    length = F.log2("top") + F.log2(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + (v / F.col("top")) * (v / F.col("top")))) / 2
    return rows.withColumn("top", top).select("vec_id", "embedding", F.size("embedding").alias("width"), F.floor(2 * length).cast("int").alias("band"))


def _stack(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)]).reshape(-1, width)


def shards_of(usable: DataFrame, shards: int = SHARDS, shard_bytes: int = SHARD_BYTES, degree: int = DEGREE) -> DataFrame:
    """(width, band, parts): into how many shards the vectors of a width and band are dealt."""
    counted = usable.groupBy("width", "band").agg(F.count("*").alias("n"))
    share = F.ceil(F.col("n") * shards / F.sum("n").over(Window.partitionBy("width")))  # a row for each length
    size = F.ceil(F.col("n") * (8 * F.col("width") + 4 * degree) / shard_bytes)
    return counted.select("width", "band", F.greatest(share, size).cast("int").alias("parts"))


def index(usable: DataFrame, dealt: DataFrame, **settings) -> DataFrame:
    """One row for each shard: distinct vectors, their graph, and the ids of each."""

    def make(table: pa.Table) -> pa.Table:
        key = [table[n][0].as_py() for n in ("width", "band", "part")]
        x, ids = _stack(table["embedding"], key[0]), table["vec_id"].to_numpy()
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
        again = np.concatenate([[False], (ids[1:] == ids[:-1]) & ~new[1:]])
        group = (np.cumsum(new) - 1)[~again]
        x, ids = x[new], ids[~again]
        graph, entry = build(directions(x), **settings)
        ends = np.cumsum(np.bincount(group, minlength=len(x)))
        values = [*key, x.tobytes(), graph.astype(np.int32).tobytes(), entry, ends.tobytes(), ids.tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=["width", "band", "part", "vectors", "graph", "entry", "ends", "ids"])

    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    rows = usable.join(dealt, ["width", "band"]).select("width", "band", part.alias("part"), "vec_id", "embedding")
    return rows.groupBy("width", "band", "part").applyInArrow(make, _INDEX)


class Shard:
    """A shard's index, ready to be searched."""

    def __init__(self, row: dict):
        self.x = np.frombuffer(row["vectors"]).reshape(-1, row["width"])
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(len(self.x), -1).astype(np.int64)
        self.ends, self.of, self.entry = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["ids"], np.int64), row["entry"]
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.points = (self.x / np.abs(self.x).max()).astype(np.float32)


def search_shard(shard: Shard, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each query the k best ids of a shard, without the query's own, and their inner products."""
    x, starts, ends, of, points = shard.x, shard.starts, shard.ends, shard.of, shard.points
    out_ids, out_scores = [], []
    block = max(1, min(512, (64 << 20) // len(x)))
    for a in range(0, len(queries), block):
        q = queries[a : a + block]
        # a query's length does not change the order
        found, _ = beam_search(points, shard.graph, shard.entry, directions(q), max(beam, k + 1), True)
        for own, vector, hit in zip(ids[a : a + block], q, found):
            hit = hit[hit >= 0]
            scores = x[hit] @ vector
            # a point's ids rise; more than k + 1 of equal score can't be among the k best
            each = [of[starts[h] : min(ends[h], starts[h] + k + 1)] for h in hit]
            of_all = np.concatenate(each)
            score = np.repeat(scores, [len(e) for e in each])
            keep = of_all != own
            of_all, score = of_all[keep], score[keep]
            best = np.lexsort((of_all, -score))[:k]
            out_ids.append(of_all[best])
            out_scores.append(score[best])
    return out_ids, out_scores


def search(vectors: DataFrame, is_query, k: int = 20, beam: int = BEAM, shards: int = SHARDS, shard_bytes: int = SHARD_BYTES, **settings) -> DataFrame:
    """query_id, rank, vec_id, score: of each row that is_query (a condition on vec_id) holds for, the k nearest found
    among all other rows of as many components by inner product, best first, ties to the smaller vec_id.

    Null ids and vectors that are null, zero or hold null or non-finite components take no part. Rows repeated with one id
    and vector count once; if a query's id comes with several vectors, the least of them is searched. Fewer than k
    candidates give fewer rows. Other columns play no part, whatever their names. A task holds one shard's index and a
    batch of queries; indexes move once, queries once to each shard.
    """
    small_batches(vectors.sparkSession)
    usable = write_table(_usable(vectors), "vectors")
    dealt = write_table(shards_of(usable, shards, shard_bytes, settings.get("degree", DEGREE)), "shards")
    built = write_table(index(usable, dealt, **settings), "index")
    one = usable.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = one.withColumn("width", F.size("embedding")).join(built.select("width", "band", "part"), "width")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("vectors", "binary"), ("graph", "binary"), ("entry", "int"), ("ends", "binary"), ("ids", "binary"))]
    stream = built.select("*", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"))
    stream = stream.unionByName(asked.select("width", "band", "part", *empty, "vec_id", "embedding"))
    tasks = max(shuffle_parts(vectors.sparkSession), 4 * built.count())
    # a shard's rows come together, its index first
    stream = stream.repartition(tasks, "width", "band", "part").sortWithinPartitions("width", "band", "part", F.asc_nulls_first("vec_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("best", pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64())])))])
        shard = None
        for batch in batches:
            heads = np.flatnonzero(batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)).tolist()
            for lo, hi in zip([0, *heads], [*heads, len(batch)]):
                if lo == hi:
                    continue
                if lo in heads:
                    shard = Shard({n: batch.column(n)[lo].as_py() for n in ("width", "vectors", "graph", "entry", "ends", "ids")})
                    lo += 1
                ids, x = batch.column("vec_id")[lo:hi].to_numpy(zero_copy_only=False), batch.column("embedding")[lo:hi]
                if lo == hi:
                    continue
                found, scores = search_shard(shard, ids, _stack(pa.chunked_array([x]), shard.x.shape[1]), k, beam)
                best = [[{"less": -s, "vec_id": i} for s, i in zip(b.tolist(), a.tolist())] for a, b in zip(found, scores)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, schema.field("best").type)], schema=schema)

    lists = stream.mapInArrow(run, "query_id long, best array<struct<less:double,vec_id:long>>")
    merged = lists.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))


def report(vectors: DataFrame, every: int = 20) -> DataFrame:
    """search() for the rows whose vec_id is divisible by `every`."""
    return search(vectors, F.col("vec_id") % every == 0)
