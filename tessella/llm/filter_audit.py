"""How filters overlap in every order: exact duplicates by partition refinement, then counts by mask of failed filters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import carried, fields, pieces, remove_table, small_batches, text_bytes, write_table

#: Bytes of the first block that is hashed; each next block is as long as all before it.
BLOCK = 512
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
_UPPER = bytes(range(0x41, 0x5B))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_NOT_MARK = bytes(b for b in range(256) if b not in b"#$%&*|")


def failures(text: bytes, points: int, least_words: int = 50, distinct: int = 65, capitals: int = 5) -> int:
    """Bits of the filters that a text fails by itself: 1 A few words, 2 B repeats, 4 C capitals, 8 D marks."""
    words = text.split()
    return (
        (len(words) < least_words) + 2 * (100 * len(set(words)) < distinct * len(words))
        + 4 * (100 * len(text.translate(None, _NOT_UPPER)) > capitals * points) + 8 * bool(text.translate(None, _NOT_MARK))
    )


def block_hashes(text: bytes) -> list[int]:
    """Signed 64-bit hashes of a text's blocks in order, without the last one's padding; an empty text has none."""
    out, start, size = [], 0, BLOCK
    while start < len(text):
        out.append(xxhash.xxh64_intdigest(text[start : start + size]))
        start, size = start + size, start + size
    return np.array(out, np.uint64).view(np.int64).tolist()


def _looked(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = text_bytes(batch.column(text))
            points = [len(x) if x.isascii() else len(x.decode()) for x in texts]
            out = [
                pa.array([failures(x, n) for x, n in zip(texts, points)], pa.int32()), pa.array(points, pa.int64()),
                pa.array([block_hashes(x) for x in texts], pa.list_(pa.int64())),
            ]
            kept = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *out], names=[*kept, "__mask", "__points", "__blocks"])

    return run


def look(docs: DataFrame, part: str = "source") -> DataFrame:
    """One pass over the texts, written to the shared folder: doc_id, part, hash (of the text), mask, points, blocks."""
    small_batches(docs.sparkSession)
    df, (own, of), text = carried(docs, ["doc_id", part])
    df = df.select(F.col(own).alias("doc_id"), F.coalesce(F.col(of).cast("string"), F.lit("")).alias("part"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), text)
    kept = ["doc_id", "part", "hash"]
    seen = df.mapInArrow(_looked(text), fields(df, kept, "__mask int, __points long, __blocks array<long>"))
    return write_table(seen.select(*kept, *(F.col(f"__{c}").alias(c) for c in ("mask", "points", "blocks"))), "looked")


def refine(rows: DataFrame) -> DataFrame:
    """Rows of (points, blocks) that may have equals: a class is first a length, then is split by one block's hash after
    another, and classes of a single row are dropped each time. Adds the column `class`.

    Each round counts its classes by partial sums, into a table of its own, and keeps rows by a semi-join that can split a
    class of very many copies among tasks. Rounds end when no row has a further block: they are as many as the doublings of the longest text.
    """
    rows = rows.withColumn("class", F.xxhash64("points"))
    depth, before = 0, None
    while True:
        shared = write_table(rows.groupBy("class").count().filter("count > 1").select("class"), "shared")
        kept = write_table(rows.join(shared, "class", "left_semi"), "classes")
        remove_table(shared)
        if before is not None:
            remove_table(before)
        more = F.size("blocks") > depth
        if not kept.filter(more).limit(1).count():
            return kept
        rows = kept.withColumn("class", F.when(more, F.xxhash64("class", F.get("blocks", F.lit(depth)))).otherwise(F.col("class")))
        depth, before = depth + 1, kept


def duplicates(docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(doc_id, hash) of the rows whose text equals that of a smaller doc_id, each once; hash is the text's xxhash64.

    Rows that agree in length and in all block hashes are compared in full with the text of the smallest doc_id among
    them. Those that differ from it after all (a clash of hashes) are compared among themselves, until none is left. Null
    texts are empty ones. A row without doc_id is neither smaller than another nor a duplicate; repeated rows are
    duplicates only of a smaller doc_id.
    """
    own = look(docs.withColumn("__part", F.lit("")), "__part") if seen is None else seen
    classes = refine(own.filter("doc_id is not null").select("doc_id", "hash", "points", "blocks").distinct())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    # texts move whatever the size, so that a larger input takes in proportion what a small one takes
    left = write_table(texts.join(classes.select("doc_id", "hash", "class").hint("merge"), ["doc_id", "hash"]), "suspects")
    remove_table(classes, *([own] if seen is None else []))
    found = None
    while left.limit(1).count():
        # in a table of its own, so that the join can split a class of very many rows
        first = write_table(left.groupBy("class").agg(F.min(F.struct("doc_id", "text")).alias("first")), "first")
        met = left.join(first, "class").withColumn("same", F.col("text") == F.col("first.text"))
        met = met.withColumn("later", F.col("doc_id") > F.col("first.doc_id")).withColumn("text", F.when(~F.col("same"), F.col("text")))
        met = write_table(met.drop("first"), "compared")
        same = met.filter("same and later").select("doc_id", "hash")
        found = same if found is None else found.unionByName(same)
        remove_table(left, first)
        left = write_table(met.filter("not same").select("doc_id", "hash", "text", "class"), "suspects")
    return left.select("doc_id", "hash") if found is None else found.distinct()


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and by the set of filters they fail, at most 32 sets a part."""
    seen = look(docs, part)
    twice = duplicates(docs, seen).withColumn("again", F.lit(16))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("bad"))
    every = seen.join(twice, ["doc_id", "hash"], "left").join(marks, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.groupBy("part", (F.col("mask") + zero("again")).alias("mask")).agg(F.count("*").alias("n"), F.sum(zero("good")).alias("good"), F.sum(zero("bad")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each of five filters does at each place of every order, per part: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    A: under 50 words; B: under 65 % of the words distinct; C: over 5 % capitals; D: holds one of #$%&*|; E: the text of a
    smaller doc_id. Null and empty texts fail A only (and E, where there is a smaller one); a null part is the empty one;
    repeated rows count each; a doc_id with several labels has each mark that any of them has; an empty docs gives no
    rows. Other columns play no part. All orders are counted from the at most 32 sets of failed filters of a part.
    """
    sets = masks(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))
    bits = F.create_map(*[F.lit(x) for i, a in enumerate(LETTERS) for x in (a, 1 << i)])
    bit = lambda c: F.element_at(bits, c)
    rows = sets.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    letters = F.split("filter_order", "")
    rows = rows.withColumn("own", bit(F.get(letters, F.col("step") - 1)))
    rows = rows.withColumn("past", F.aggregate(F.slice(letters, 1, F.col("step") - 1), F.lit(0), lambda a, c: a + bit(c)))

    def added(test, value: str = "n", share=None):
        one = lambda m: m[value] if share is None else m[value] * share(m)
        return F.aggregate(F.filter("sets", test), F.lit(0).cast("long"), lambda a, m: a + one(m))

    fails = lambda m: m["mask"].bitwiseAND(F.col("own")) != 0
    gone = lambda m: m["mask"].bitwiseAND(F.col("past")) != 0
    taken = lambda m: fails(m) & ~gone(m)
    # of the filters that a document fails, each comes first in an equal share of the orders
    share = lambda m: (F.lit(len(ORDERS)) / F.bit_count(m["mask"])).cast("long")
    return rows.select(
        "part", "filter_order", "step", added(lambda m: ~fails(m) & ~gone(m)).alias("kept"), added(taken).alias("removed"),
        added(lambda m: fails(m) & gone(m)).alias("redundant"), added(lambda m: m["mask"] == F.col("own")).alias("unique_fails"),
        added(taken, "good").alias("good_lost"), added(taken, "toxic").alias("toxic_lost"), added(fails, "n", share).alias("shapley"),
    )


ORACLE = """WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
    l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
    f AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
         'D': regexp_matches(t, '[#$%&*|]'), 'E': first < d.doc_id} AS fails FROM d LEFT JOIN l USING (doc_id)),
    x AS MATERIALIZED (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
    abc AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM abc a, abc b, abc c, abc d, abc e
        WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
    steps AS (SELECT o, step, substring(o, step, 1) AS c, substring(o, 1, step - 1) AS past FROM orders, range(1, 6) r(step)),
    y AS (SELECT part, o, step, c, n, good, toxic, struct_extract(fails, 'A') AND contains(past, 'A') OR struct_extract(fails, 'B') AND contains(past, 'B')
            OR fails['C'] AND contains(past, 'C') OR fails['D'] AND contains(past, 'D') OR fails['E'] AND contains(past, 'E') AS gone,
        CASE c WHEN 'A' THEN fails['A'] WHEN 'B' THEN fails['B'] WHEN 'C' THEN fails['C'] WHEN 'D' THEN fails['D'] ELSE fails['E'] END AS own,
        fails['A']::INT + fails['B']::INT + fails['C']::INT + fails['D']::INT + fails['E']::INT AS many FROM x, steps),
    z AS (SELECT part, o AS filter_order, step::INT AS step, c, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
        FROM y GROUP BY part, o, step, c)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM z"""


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)
