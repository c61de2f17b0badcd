"""SimHash near-duplicates: fingerprints, a grid join on segment popcounts, and components.

Embedding. A 64-bit fingerprint is cut into 32 segments of 2 bits; its vector holds each segment's number of ones. Two
fingerprints that differ in d bits are at Manhattan distance at most d. For d = 3 the 16 coordinates of one half are at
distance 0 or 1. The vectors of a half are cells of a grid; a fingerprint is filed in its own cell and looks into its own
and into those one step up in one coordinate (a step down is the other fingerprint's step up). So every pair within 3
bits meets in a cell of one half, and the bits themselves decide.

A half's vector has 24 bits of entropy. From MANY fingerprints on, a cell is split by a quarter of the other half: as that
half holds at most 3 differing bits, one of its four quarters is equal, so each fingerprint is filed under all four. Both
ways find the same pairs; the second makes four times the rows and a 256th of the candidates. Only distinct fingerprints
are filed: a group of copies, however large, is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fields, fresh, pieces, small_batches, text_bytes, write_table
from .components import components

SEED = 42
_HALF = 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of words, lower-cased A-Z, space-joined, repeats included; of a shorter text, of all
    its words; of a text without words, nothing."""
    from xxhash import xxh64_intdigest

    split = text.lower().split()
    if not split:
        return np.zeros(0, "<u8")
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], "<u8")
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(split) - words + 1].tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; of none, 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the text's fingerprint as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(shingle_hashes(x, words)) for x in text_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, fields(docs, ["doc_id"], "fp long"))


#: Distinct fingerprints from which on cells are split.
MANY = 1 << 22


def _cells(distinct: DataFrame, split: bool) -> DataFrame:
    """A row for each fingerprint, half (with split: and quarter of the other half) and cell that it looks into; step is 0
    for its own cell."""
    bits = lambda half, i: F.bit_count(F.shiftright("fp", half * 2 * _HALF + 2 * i).bitwiseAND(F.lit(3)))
    looked = []
    for half in range(2):
        own = sum((bits(half, i).cast("long") * 3**i for i in range(_HALF)), F.lit(half * 3**_HALF).cast("long"))
        ups = [F.when(bits(half, i) < 2, F.lit(3**i).cast("long")) for i in range(_HALF)]
        # a quarter's number and its 8 bits, above all cells
        quarters = [F.shiftright("fp", (1 - half) * 32 + 8 * q).bitwiseAND(F.lit(255)) + 256 * q for q in range(4)] if split else [F.lit(0).cast("long")]
        looked += [F.struct((own + q * (2 * 3**_HALF)).alias("own"), F.array(F.lit(0).cast("long"), *ups).alias("steps")) for q in quarters]
    halves = distinct.select("fp", F.explode(F.array(*looked)).alias("x")).select("fp", "x.own", F.explode(F.filter("x.steps", lambda s: s.isNotNull())).alias("step"))
    return halves.select("fp", (F.col("own") + F.col("step")).alias("cell"), "step")


def near_pairs(distinct: DataFrame, split: bool | None = None) -> DataFrame:
    """Pairs (a, b) of the distinct values of fp that differ in 3 bits or fewer; a pair may come more than once."""
    cells = _cells(distinct, distinct.count() >= MANY if split is None else split)
    looks = cells.select(F.col("fp").alias("a"), "cell", "step")
    filed = cells.filter("step = 0").select(F.col("fp").alias("b"), "cell")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3) & ((F.col("step") > 0) | (F.col("a") < F.col("b")))
    return looks.join(filed, (looks["cell"] == filed["cell"]) & near).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of 3 differing bits or fewer.

    Null and empty texts have fingerprint 0, which links like any other. Repeated rows come out as often as they went
    in; a row without a doc_id links like any other and gets the component's id (null if none of it has one). Other columns
    play no part, whatever their names.
    """
    prints = write_table(fingerprints(docs, words), "fingerprints")
    groups = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    found = components(near_pairs(groups.select("fp")).select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = write_table(groups.join(found, groups["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "placed")
    least = write_table(placed.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("component_id")), "least")
    known = placed.join(least, F.col("component") == F.col("c")).select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs, words).select("doc_id", hexed.alias("fingerprint"), "component_id")


# -- near copies by the similarity of shingle sets ---------------------------------------------------------------------

#: Minimum hashes of a text's shingles, each of which files it in a bucket.
MINIMA = 8
_ODD = (np.random.default_rng(42).integers(1, 1 << 62, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Bytes of a shingle's hash by which sets are compared.
WIDTH = 5


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row: a number, a hash of its word sequence, fingerprint, minimum hashes, sorted shingle hashes and how many."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        rid = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            texts = text_bytes(batch.column("text"))
            content, fp, minima, shingles = [], [], [], []
            for text in texts:
                h = shingle_hashes(text, words)
                distinct = np.unique(h)
                content.append(xxh3_128_digest(b" ".join(text.lower().split())))
                fp.append(fingerprint(h))
                minima.append([int((distinct * odd).min().view(np.int64)) for odd in _ODD] if len(h) else [])
                shingles.append(_packed(distinct))
            rids = np.arange(rid, rid + len(texts))
            rid += len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array(rids), pa.array(content, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)),
                    pa.array(minima, pa.list_(pa.int64())), pa.array(shingles, pa.binary()), pa.array([len(x) // WIDTH for x in shingles], pa.int64()),
                ],
                names=["doc_id", "mark", "rid", "content", "fp", "minima", "shingles", "size"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", _mark().alias("mark"), "text")
    return rows.mapInArrow(run, fields(rows, ["doc_id", "mark"], "rid long, content binary, fp long, minima array<long>, shingles binary, size long"))


def _packed(hashes: np.ndarray) -> bytes:
    """Distinct values of the hashes' upper WIDTH bytes, rising."""
    high = np.unique(hashes >> np.uint64(64 - 8 * WIDTH)).astype("<u8")
    return high.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<i8").ravel()


def _mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def _similar(both, a, b, similarity: float):
    """Whether sets of a and b entries that share `both` have at least this Jaccard similarity."""
    return both >= similarity * (a + b - both) - 1e-9


def similar_links(rows: DataFrame, nodes: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between rows of nodes (rid, fp) whose shingle sets (of rows) have at least this Jaccard similarity: most
    of those that join what is similar, for bucket_links() to start from.

    Candidates are pairs within 3 bits by the grid, rows of one fingerprint, and, as texts of similarity 0.8 may differ
    in 16 of 64 bits, rows that share a minimum hash (shared: of shared_minima()). In each bucket every row meets one
    hub, a different one in each kind of bucket, never all others; sets too different in size to be similar drop out, and
    the sets decide. First rows are a table, so the joins on them can split a hot fingerprint.
    """
    of_fp = write_table(nodes.groupBy("fp").agg(F.min("rid").alias("first")), "prints")
    first = lambda fp, name: of_fp.select(F.col("fp").alias(fp), F.col("first").alias(name))
    close = near_pairs(of_fp.select("fp")).join(first("a", "u"), "a").join(first("b", "v"), "b").select("u", "v")
    same = nodes.select("rid", "fp").join(of_fp, "fp").filter("rid <> first").select(F.col("rid").alias("u"), F.col("first").alias("v"))
    near = F.least("size", "hub_size") >= similarity * F.greatest("size", "hub_size")
    met = shared.filter((F.col("rid") != F.col("hub")) & near).select(F.col("rid").alias("u"), F.col("hub").alias("v"))
    pairs = write_table(close.unionByName(same).unionByName(met).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    both = _sets(rows, pairs.select(F.explode(F.array("u", "v")).alias("rid")))
    sets = lambda name, c: both.select(F.col("rid").alias(name), F.col("shingles").alias(c))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                small, large = sorted((len(a), len(b)))
                keep.append(small >= similarity * large and bool(_similar(len(np.intersect1d(_unpacked(a), _unpacked(b), assume_unique=True)), small // WIDTH, large // WIDTH, similarity)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(sets("u", "x"), "u").join(sets("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(verify, "u long, v long")


def shared_minima(nodes: DataFrame) -> DataFrame:
    """(rid, size, kind, least, hub, hub_size): each row of nodes (rid, minima, size) in each bucket of a minimum hash that
    it shares with others, and the bucket's hub. Most buckets hold one row and go no further. Hubs are a table, so the
    join on them can split a hot bucket."""
    filed = nodes.select("rid", "size", F.posexplode("minima").alias("kind", "least"))
    hub = F.min(F.struct(F.xxhash64("rid", "kind").alias("h"), F.col("rid").alias("hub"), F.col("size").alias("hub_size"))).alias("x")
    hubs = filed.groupBy("kind", "least").agg(hub, F.count("*").alias("n")).filter("n > 1")
    hubs = write_table(hubs.select(F.col("kind").alias("k"), F.col("least").alias("l"), "x.hub", "x.hub_size"), "hubs")
    return filed.join(hubs, (F.col("kind") == F.col("k")) & (F.col("least") == F.col("l"))).select("rid", "size", "kind", "least", "hub", "hub_size")


#: Most rows whose numbers are broadcast to pick their sets out; the sets of more meet in a shuffle with all others.
FEW = 1 << 20


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, shingles) of the wanted rows (rid); of all, where too many are wanted to say which."""
    wanted = wanted.distinct()
    sets = rows.select("rid", "shingles")
    return sets.join(F.broadcast(wanted), "rid", "left_semi") if wanted.limit(FEW + 1).count() <= FEW else sets


#: Entries of shingle sets in a block of a bucket, of which a task holds two.
BLOCK = 1 << 20
#: Most entries that are put last in the order of prefixes, and so the size of a broadcast (8 bytes each), and of how many
#: rows about the frequent entries are looked for.
COMMON, LOOKED = 1 << 20, 20_000


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _prefix(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Of how many first entries, in one order for all sets, similar sets must share one (Chaudhuri et al., 2006)."""
    return np.maximum(sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)


def joined_labels(labels: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between labels that join what all pairs of the sets of at least this similarity join; rows of one label
    are joined already.

    A search from row to row: each row reached meets those not yet reached that share an entry of its prefix, the
    entries that the fewest sets have, and their sets decide. What all sets share is in no prefix, so a passage that is
    in all texts costs nothing.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, entry, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((entry, often[entry], row))
    entry, begins = entry[order], np.cumsum(sizes) - sizes
    short = _prefix(sizes, similarity)
    heads = entry[_ranges(begins, short)]
    by_entry = np.argsort(heads, kind="stable")
    holders = np.repeat(np.arange(len(sets)), short)[by_entry]
    bounds = np.searchsorted(heads[by_entry], np.arange(len(values) + 1))
    names, label = np.unique(labels, return_inverse=True)
    by_label = np.argsort(label, kind="stable")
    groups = np.searchsorted(label[by_label], np.arange(len(names) + 1))
    waiting, own, links = np.ones(len(sets), bool), np.zeros(len(values), bool), []
    for first in range(len(names)):
        queue = by_label[groups[first] : groups[first + 1]].tolist()
        if not waiting[queue[0]]:
            continue
        waiting[queue] = False
        while queue:
            a = queue.pop()
            at = entry[begins[a] : begins[a] + short[a]]
            met = np.unique(holders[_ranges(bounds[at], bounds[at + 1] - bounds[at])])
            met = met[waiting[met] & (np.minimum(sizes[met], sizes[a]) >= similarity * np.maximum(sizes[met], sizes[a]) - 1e-9)]
            own[entry[begins[a] : begins[a] + sizes[a]]] = True
            for lo in range(0, len(met), 4096):
                some = met[lo : lo + 4096]
                both = np.add.reduceat(own[entry[_ranges(begins[some], sizes[some])]].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                for b in some[_similar(both, sizes[some], sizes[a], similarity)].tolist():
                    if waiting[b]:
                        links.append((int(labels[a]), int(labels[b])))
                        group = by_label[groups[label[b]] : groups[label[b] + 1]]
                        waiting[group] = False
                        queue += group.tolist()
            own[entry[begins[a] : begins[a] + sizes[a]]] = False
    return links


def _open_buckets(filed: DataFrame, block: int) -> DataFrame:
    """(k, l, blocks) of the buckets (kind, least) of filed rows that hold several labels, and into how many blocks their
    sets are dealt. Of buckets with the same rows one is enough."""
    mark = lambda seed: F.bit_xor(F.xxhash64("rid", F.lit(seed)))
    found = filed.groupBy("kind", "least").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("size").alias("size"), F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y")).filter("lo < hi")
    found = found.groupBy("n", "x", "y").agg(F.min(F.struct("kind", "least")).alias("at"), F.max("size").alias("size"))
    return write_table(found.select(F.col("at.kind").alias("k"), F.col("at.least").alias("l"), F.ceil(F.col("size") / block).cast("int").alias("blocks")), "buckets")


def _within(filed: DataFrame, buckets: DataFrame) -> DataFrame:
    return filed.join(buckets, (F.col("kind") == F.col("k")) & (F.col("least") == F.col("l")))


def _near_in_size(filed: DataFrame, similarity: float) -> DataFrame:
    """Rows (k, l, size) without those that no other of their bucket is near enough to in size to be similar. Of a bucket
    in order of size it is enough to look at the row before and the one after."""
    order = Window.partitionBy("k", "l").orderBy("size", "rid")
    near = F.col("size") >= similarity * F.lead("size").over(order) - 1e-9
    near = F.coalesce(near, F.lit(False)) | F.coalesce(F.lag("size").over(order) >= similarity * F.col("size") - 1e-9, F.lit(False))
    return filed.withColumn("near", near).filter("near").drop("near")


def _compared(rows: DataFrame, filed: DataFrame, buckets: DataFrame, similarity: float, small: bool = False) -> DataFrame:
    """Links (u, v) between labels by comparing what is filed in each bucket; a bucket of several blocks is dealt into
    them, and each two of them meet in a task. Of small buckets, which are a block each, sets that are near no other in
    size stay where they are."""
    mine = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    held = _within(filed, buckets)
    dealt = (_near_in_size(held, similarity) if small else held).select("rid", "label", "k", "l", "blocks", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = write_table(dealt.filter("blocks = 1 or mine <> other").select("rid", "label", "k", "l", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")), "dealt")

    def join(table: pa.Table) -> pa.Table:
        links = joined_labels(np.array(table["label"]), [_unpacked(x.as_buffer()) for x in table["shingles"]], similarity)
        return pa.table({name: pa.array([x[i] for x in links], pa.int64()) for i, name in enumerate("uv")})

    return dealt.join(_sets(rows, dealt.select("rid")), "rid").groupBy("k", "l", "a", "b").applyInArrow(join, "u long, v long")


def _prefix_filings(sets: DataFrame, similarity: float, common: int = COMMON) -> DataFrame:
    """(rid, label, size, kind, least): rows of sets (rid, label, size, shingles) filed under each entry of their prefix
    that others have in theirs.

    In the order of prefixes frequent entries come last, as many as `common` at most. They are those that several of some
    rows have; which they are changes the cost only, as any order that is the same for all sets is exact.
    """
    context = sets.sparkSession.sparkContext

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.unique(np.concatenate([_unpacked(x) for x in b.column("shingles").to_pylist()]), return_counts=True) for b in batches if len(b)]
        if held:
            values, back = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values[n > 1]), pa.array(n[n > 1])], names=["e", "n"])

    share = min(1.0, LOOKED / max(1, sets.count()))
    some = sets.filter(F.pmod(F.xxhash64("rid", F.lit("looked")), F.lit(1 << 20)) < int(share * (1 << 20))).select("shingles").repartition(4)
    often = some.mapInArrow(tally, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "e").limit(common)
    shared = context.broadcast(np.sort(np.array(often.select("e").toArrow()["e"], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            held, counts = [], []
            for data in batch.column("shingles").to_pylist():
                x = _unpacked(data)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
                    x = np.concatenate([x[~late], x[late]])
                held.append(x[: _prefix(np.array([len(x)]), similarity)[0]])
                counts.append(len(held[-1]))
            again = pa.array(np.repeat(np.arange(len(batch)), counts))
            names = ["rid", "label", "size"]
            entries = pa.array(np.concatenate([np.zeros(0, np.int64), *held]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(again) for n in names), entries], names=[*names, "least"])

    filed = write_table(sets.mapInArrow(run, "rid long, label long, size long, least long"), "filed")
    # most entries are one row's alone
    several = write_table(filed.groupBy("least").agg(F.count("*").alias("n")).filter("n > 1").select("least"), "several")
    return filed.join(several, "least").select("rid", "label", "size", F.lit(0).alias("kind"), "least")


def bucket_links(rows: DataFrame, filed: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the labels of rows that share a minimum hash (filed: rid, label, size, kind, least) and have at
    least this similarity, enough of them to join all such rows. rows has the sets (rid, shingles).

    Buckets of one label are settled. Others of up to `block` entries are compared in a task each. What is in larger
    buckets, as of a passage that very many texts hold, is filed anew by prefixes, which leave such passages out, and
    compared in those buckets; only texts that consist of common passages are then still many to a bucket.
    """
    buckets = _open_buckets(filed, block)
    small = _compared(rows, filed, buckets.filter("blocks = 1"), similarity, small=True)
    large = buckets.filter("blocks > 1")
    if large.isEmpty():
        return small
    hot = write_table(_within(filed, large).select("rid", "label", "size").distinct(), "hot")
    few = hot.limit(FEW + 1).count() <= FEW
    sets = write_table(rows.select("rid", "shingles").join(F.broadcast(hot) if few else hot, "rid"), "sets")
    again = write_table(_prefix_filings(sets, similarity), "filed")
    return small.unionByName(_compared(sets, again, _open_buckets(again, block), similarity))


def not_met(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(rid, label, size, kind, least): rows in their buckets (of shared_minima()) without the buckets' hubs, which all others
    of the bucket have met, so what a hub is similar to has its label (rid, label) already."""
    return shared.filter("rid <> hub").select("rid", "size", "kind", "least").join(labels, "rid").select("rid", "label", "size", "kind", "least")


def similar_components(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of all nodes: links to hubs first, then all that they leave open within buckets."""
    shared = write_table(shared_minima(nodes), "shared")
    first = components(similar_links(rows, nodes, shared, similarity))
    labels = write_table(nodes.select("rid").join(first, nodes["rid"] == first["node"], "left").select("rid", F.coalesce("component", "rid").alias("label")), "labels")
    filed = write_table(not_met(shared, labels), "filed")
    found = components(bucket_links(rows, filed, similarity))
    return labels.join(found, labels["label"] == found["node"], "left").select(F.col("rid").alias("node"), F.coalesce("component", "label").alias("component"))


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without all but one (of the smallest doc_id) of each group of near copies: texts
    joined by shared word sequences or by shingle sets of at least this Jaccard similarity.

    Texts without words, null ones too, are one group. Repeated rows are copies; a null doc_id comes after all others.
    Shingles are compared by 40 bits of their hashes: two different ones are taken for one in 1 of 10**12 comparisons.
    """
    rows = write_table(_sketches(docs, words), "sketches")
    groups = write_table(rows.groupBy("content").agg(F.min("rid").alias("node")), "contents")
    # what is small of a row goes to its group's first; the sets stay
    nodes = write_table(rows.select("rid", "fp", "minima", "size").join(groups.select(F.col("node").alias("rid")), "rid", "left_semi"), "nodes")
    found = similar_components(rows, nodes, similarity)
    label = groups.join(found, "node", "left").select("content", F.coalesce("component", "node").alias("component"))
    placed = write_table(rows.select("doc_id", "mark", "rid", "content").join(label, "content").select("doc_id", "mark", "rid", "component"), "placed")
    best = placed.groupBy(F.col("component").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("best")).select("c", F.col("best.rid").alias("best"))
    kept = placed.join(write_table(best, "best"), F.col("component") == F.col("c")).withColumn("kept", F.col("rid") == F.col("best"))
    marks = write_table(kept.groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "marks")
    own, its_id, its_mark = (fresh(docs, n) for n in ("__mark", "__id", "__its_mark"))
    on = lambda m: docs["doc_id"].eqNullSafe(m[its_id]) & (F.col(own) == m[its_mark])
    # as many ids and marks as can be broadcast leave the texts where they are; else both are spread evenly, so a part's
    # set of them is hashed and its texts stream past it unsorted
    few = marks.filter("not kept or n > 1").limit(FEW + 1).count() <= FEW
    named = lambda m: m.select(F.col("doc_id").alias(its_id), F.col("mark").alias(its_mark)).hint("broadcast" if few else "shuffle_hash")
    marked = docs.withColumn(own, _mark())
    gone, twice = named(marks.filter("not kept")), named(marks.filter("kept and n > 1"))
    if twice.isEmpty():
        return marked.join(gone, on(gone), "left_anti").drop(own)
    # rows that are repeated as they are: one of each stays
    also = named(marks.filter("not kept or n > 1"))
    single = marked.join(also, on(also), "left_anti")
    return single.unionByName(marked.join(twice, on(twice), "left_semi").dropDuplicates(["doc_id", own])).drop(own)
