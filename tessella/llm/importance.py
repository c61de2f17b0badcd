"""Importance resampling towards a target: hashed n-gram postings by bucket, gains beside their bucket, draws by score."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, carried, fields, fresh, pieces, shuffle_parts, small_batches, text_bytes, write_table

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Ranges of buckets, each a posting list of its own; features whose buckets a worker remembers.
RANGES, REMEMBERED = 16, 1 << 19
_buckets: dict[int, dict[bytes, int]] = {}


def bucket_counts(text: bytes, size: int, buckets: int) -> tuple[int, dict[int, int]]:
    """A text's number of words, and how often features (runs of 1 to size words, space-joined) fall in each bucket."""
    known = _buckets.setdefault(buckets, {})
    words = _WORD.findall(text.translate(LOWER))
    found = Counter(words)
    for n in range(2, size + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    if len(known) > REMEMBERED:
        known.clear()
    out: dict[int, int] = {}
    for feature, n in found.items():
        at = known.get(feature)
        if at is None:
            at = known[feature] = zlib.crc32(feature) % buckets
        out[at] = out.get(at, 0) + n
    return len(words), out


def noise(seed: int, key: str) -> int:
    """The Gumbel draw of a document, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _posted(size: int, buckets: int, salts: int, seed: int, kept: list[str], text: str):
    """The function that turns texts into rows of three kinds: 0 a document (its words and noise), 1 the postings of a
    batch in a range of buckets, 2 a batch's counts by bucket."""

    def row(names: list[str], **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(n, t) for f, t in names], names=[f for f, _ in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            types = [*((k, batch.schema.field(k).type) for k in kept), *_POSTED]
            got = [bucket_counts(x, size, buckets) for x in text_bytes(batch.column(text))]
            docs = np.repeat(np.arange(len(got)), [len(c) for _, c in got])
            at = np.fromiter((b for _, c in got for b in c), np.int64, len(docs))
            n = np.fromiter((v for _, c in got for v in c.values()), np.int64, len(docs))
            totals = np.bincount(at, n, buckets).astype(np.int64)
            yield row(types, kind=pa.array([2], pa.int32()), body=pa.array([zlib.compress(totals.tobytes(), 1)]))
            keys = batch.column("__doc").to_numpy()
            salt = zlib.crc32(keys[:1].tobytes()) % salts
            order = np.argsort(at % RANGES, kind="stable")
            cuts = np.searchsorted((at % RANGES)[order], np.arange(RANGES + 1))
            held = [(r, order[cuts[r] : cuts[r + 1]]) for r in range(RANGES) if cuts[r] < cuts[r + 1]]
            if held:
                bodies = [zlib.compress(b"".join((keys[docs[o]].tobytes(), n[o].tobytes(), at[o].tobytes())), 1) for _, o in held]
                yield row(types, kind=pa.array([1] * len(held), pa.int32()), range=pa.array([r for r, _ in held], pa.int32()), salt=pa.array([salt] * len(held), pa.int32()), body=pa.array(bodies))
            draws = [noise(seed, x) for x in batch.column("__name").to_pylist()]
            yield row(
                types, kind=pa.array([0] * len(keys), pa.int32()), __doc=batch.column("__doc"), __words=pa.array([w for w, _ in got], pa.int64()), __noise=pa.array(draws, pa.int64()),
                **{k: batch.column(k) for k in kept},
            )

    return run


_POSTED = [("kind", pa.int32()), ("range", pa.int32()), ("salt", pa.int32()), ("body", pa.binary()), ("__doc", pa.int64()), ("__words", pa.int64()), ("__noise", pa.int64())]
_POSTED_DDL = "kind int, range int, salt int, body binary, __doc long, __words long, __noise long"


def _summed(posted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of the buckets that hold features: each task adds what it reads, so a bucket costs a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(body), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    return posted.filter("kind = 2").select("body").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, s, t, all_s, all_t) of every bucket that either corpus fills, from both corpora's (bucket, n)."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = write_table(both, "counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    return both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.lit(all_s or 0).cast("long").alias("all_s"), F.lit(all_t or 0).cast("long").alias("all_t"))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    """A bucket's log ratio of add-one shares, in thousandths, rounded down."""
    return math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))


def _contributed(buckets: int):
    """Goes through rows in order of (range, salt), a range's counts before its postings; emits (doc, weight, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = None, np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                if (row["range"], row["salt"]) != key:
                    key = row["range"], row["salt"]
                    table[:] = 0
                if row["bucket"] is not None:
                    table[row["bucket"]] = gain(row["s"], row["t"], row["all_s"], row["all_t"], buckets)
                    continue
                docs, counts, at = np.frombuffer(zlib.decompress(row["body"]), np.int64).reshape(3, -1)
                order = np.argsort(docs, kind="stable")
                docs, first = np.unique(docs[order], return_index=True)
                weight, features = np.add.reduceat((table[at] * counts)[order], first), np.add.reduceat(counts[order], first)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(weight), pa.array(features)], names=["__doc", "weight", "n_features"])

    return run


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' numbers from 1 in an order over the whole table: ranges of the order are sorted each in a task
    of its own, and only the ranges' sizes, a row each, are added up."""
    parts = shuffle_parts(df.sparkSession)
    part, at = fresh(df, "__part"), fresh(df, "__at")
    cut = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = write_table(cut.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(at)), "ranked")
    sizes = {r[0]: r[1] for r in cut.groupBy(part).count().collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    first = df.sparkSession.createDataFrame(offsets, f"{part} int, __first long")
    return cut.join(F.broadcast(first), part).select(*[c for c in df.columns], (F.col("__first") + F.col(at) + 1).alias(name))


def resample(
    docs: DataFrame, target: DataFrame, size: int = 1, buckets: int = 10000, seed: int = 2024, percent: int = 10, least_words: int = 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row of docs: the columns in keep (doc_id), n_features, weight, score, and rank (1 for the highest score) of the
    floor(percent * N / 100) drawn of the N rows of least_words words or more; others have a null rank.

    weight adds the gains of a text's features. score adds a Gumbel draw that the seed and doc_id fix, so the rows of
    highest score are a sample without replacement whose odds are the weights. Null and empty texts have no features and
    weigh 0. Ties go to the smaller doc_id; a null one draws as the empty text does and comes last. Repeated rows are rows
    of their own. An empty docs gives no rows, an empty target the gains of no counts. Columns that are not kept play no
    part, whatever their names.

    Postings are packed by batch and range of buckets and shuffled by (range, salt); beside them comes the range's counts in
    both corpora, once a salt. So a bucket that all documents hold is dealt to as many tasks as there are salts, and a task
    holds the counts of a range and the postings of one batch. What a range adds to a document is summed there before
    the reduce by document. The driver sees one number for each task of the sort.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = ["doc_id"] if keep is None else keep
    salts = max(8, shuffle_parts(spark) // RANGES)
    df, kept, text = carried(docs.withColumn(own := fresh(docs, "__own"), F.col("doc_id")), [*keep, own])
    df = df.withColumn("__doc", F.monotonically_increasing_id()).withColumn("__name", F.coalesce(F.col(kept[-1]).cast("string"), F.lit("")))
    posted = write_table(df.mapInArrow(_posted(size, buckets, salts, seed, kept, text), fields(df, kept, _POSTED_DDL)), "postings")
    wanted = target.select(F.monotonically_increasing_id().alias("__doc"), F.lit("").alias("__name"), F.col("text").alias("__text"))
    wanted = wanted.mapInArrow(_posted(size, buckets, salts, seed, [], "__text"), _POSTED_DDL)
    counts = gains(_summed(posted, buckets), _summed(wanted, buckets))
    counts = counts.withColumn("range", (F.col("bucket") % RANGES).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    postings = posted.filter("kind = 1").select("range", "salt", "body")
    met = postings.unionByName(counts, allowMissingColumns=True).repartition(shuffle_parts(spark), "range", "salt")
    met = met.sortWithinPartitions("range", "salt", F.col("bucket").isNull())
    parts = met.mapInArrow(_contributed(buckets), "__doc long, weight long, n_features long")
    base = posted.filter("kind = 0").select("__doc", *kept, "__words", "__noise")
    weights = parts.groupBy("__doc").agg(F.sum("weight").alias("weight"), F.sum("n_features").alias("n_features"))
    weights = base.join(weights, "__doc", "left").withColumn("weight", F.coalesce("weight", F.lit(0))).withColumn("n_features", F.coalesce("n_features", F.lit(0)))
    scored = write_table(weights.withColumn("score", F.col("weight") + F.col("__noise")), "scores")
    enough = F.col("__words") >= least_words
    n = scored.filter(enough).count() * percent // 100
    order = ranked(scored.filter(enough), [F.desc("score"), F.asc_nulls_last(kept[-1]), F.asc("__doc")], "rank").filter(F.col("rank") <= n)
    rest = scored.join(order.select("__doc"), "__doc", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    names = [F.col(k).alias(c) for k, c in zip(kept, keep)]
    return order.unionByName(rest).select(*names, "n_features", "weight", "score", "rank")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """resample() of documents towards the benchmark: doc_id, n_features, weight, score, rank."""
    return resample(docs, target)


def oracle(buckets: int = 10000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> str:
    """The SQL twin. crc32 is folded over the bytes of each distinct word, by a table that its polynomial makes."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::UBIGINT AS c FROM range(0, 256) r(i) UNION ALL SELECT i, k + 1, {step} FROM bits WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
        dw AS MATERIALIZED (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY ALL),
        bw AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest({words}) AS word FROM benchmark) GROUP BY ALL),
        keyed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::UBIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % {buckets} AS bucket
            FROM (SELECT word FROM dw UNION SELECT word FROM bw), tab),
        s AS (SELECT bucket, sum(n) AS s FROM dw JOIN keyed USING (word) GROUP BY bucket),
        t AS (SELECT bucket, sum(n) AS t FROM bw JOIN keyed USING (word) GROUP BY bucket),
        totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM bw)::DOUBLE AS all_t),
        gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {buckets}) / ((s + 1)::DOUBLE * (all_t + {buckets}))))::BIGINT AS g
            FROM s LEFT JOIN t USING (bucket), totals),
        weights AS (SELECT rid, sum(n * g)::BIGINT AS weight FROM dw JOIN keyed USING (word) JOIN gain USING (bucket) GROUP BY rid),
        scored AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
            FROM d LEFT JOIN weights USING (rid)),
        places AS (SELECT *, n_features >= {least_words} AS enough, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= {least_words}) OVER () AS most FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= most * {percent} // 100 THEN place END AS rank FROM places"""
