"""Repeated passages, filter overlaps and importance resampling against brute force, on odd input too."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import filter_audit, importance, suffix_dedup
from tessella.llm._common import write_table

ODD = [
    (900001, None), (900002, ""), (900003, " \t\n"), (900004, "One word"), (900004, "One word"), (900005, "a" * 3000), (900006, "naïve Ünïcode 日本 😀 x"),
    (None, "no id here"), (None, "no id here"), (900008, "x\x00y\x00" * 200), (900009, "WORD WORD " * 60), (900010, "tie $ tie % tie"),
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang")
    odd = spark.createDataFrame([(i, t, None if i is None else "odd", "en") for i, t in ODD], "doc_id long, text string, source string, lang string")
    return write_table(real.unionByName(odd).repartition(3), "docs")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]


# -- repeated passages -------------------------------------------------------------------------------------------------


def brute_spans(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])])
    return out


def test_merged_transforms():
    random.seed(5)
    for _ in range(60):
        length, letters = random.choice([2, 3, 5, 8, 20]), random.choice([b"ab", b"abc", bytes(range(256)), b"\0\x01"])
        texts = list({bytes(random.choices(letters, k=random.randint(0, 60))) for _ in range(random.randint(1, 12))})
        seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        for shard in (10, 50, 1000):
            assert [x.tolist() for x in suffix_dedup.repeated(texts, length, shard)] == want


def test_interleave_and_common_prefixes():
    """The merge orders all rows as one sort of all rotations would, and its common prefixes are those of neighbours."""
    random.seed(6)
    texts = list({bytes(random.choices(b"ab", k=random.randint(5, 30))) for _ in range(9)})
    shards = [texts[:3], texts[3:5], texts[5:]]
    made = [suffix_dedup.transform(x) for x in shards]
    order, shared = suffix_dedup.merge([last for last, _ in made], 12)
    rings = [b"".join(bytes([c + 1 for c in t]) + b"\0" for t in x) for x in shards]
    rotations = [(ring[p:] + ring[:p])[:12] for ring, (_, places) in zip(rings, made) for p in places.tolist()]
    got = [rotations[i] for i in order.tolist()]
    assert got == sorted(rotations)
    for a, b, n in zip(got, got[1:], shared[1:].tolist()):
        real = next((i for i in range(12) if a[i] != b[i]), 12)
        assert n <= real and (n == 12) == (real == 12)


@pytest.mark.parametrize("length,hot", [(200, 1 << 11), (200, 1), (40, 2)])
def test_repeated_passages(spark, docs, rows, length, hot, monkeypatch):
    random.seed(length)
    words = [w for _, t, _ in rows for w in t.split()][:3000]
    passage = " ".join(random.choices(words, k=80))
    more = [(800000 + i, " ".join(random.choices(words, k=30)) + " " + passage + " " + " ".join(random.choices(words, k=30))) for i in range(40)]
    more += [(810000, passage[5:]), (810001, passage + passage[:90]), (810002, "x" + passage[10:300] + "y")]
    own = docs.filter("doc_id % 3 = 0 or doc_id >= 900000 or doc_id is null").select("doc_id", "text")
    every = own.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumns({"bid": suffix_dedup.F.lit(1), "body": suffix_dedup.F.lit("clash"), "n_bytes": suffix_dedup.F.lit(2)})
    every = write_table(every.repartition(4), "every")
    given = [(r.doc_id, (r.text or "").encode()) for r in every.collect()]
    spans = brute_spans([t for _, t in given], length)
    want = collections.Counter()
    for (i, t), s in zip(given, spans):
        kept = b"".join(t[a:b] for a, b in zip([0, *(e for _, e in s)], [*(b for b, _ in s), len(t)]))
        want[i, len(t), sum(e - b for b, e in s), tuple(s), kept] += 1
    got = suffix_dedup.dedupe(every, length, hot=hot).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, tuple((x.start, x.end) for x in r.spans), bytes(r.kept)) for r in got) == want
    assert sum(1 for (i, *_), s in zip(given, spans) if i and 800000 <= i < 810003 and s) >= 42
    digest = suffix_dedup.dedupe(every, length, digest=True, hot=hot).collect()
    assert collections.Counter((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in digest) == collections.Counter((i, n, len(s), hashlib.sha256(k).hexdigest()) for (i, _, n, s, k), c in want.items() for _ in range(c))


def test_repeated_passages_of_a_long_text(spark):
    random.seed(1)
    long = "".join(random.choices("abcdefgh ", k=400_000))
    rows = [(1, long), (2, "z" * 250_000), (3, "q" + long[100_000:100_250]), (4, "unlike all others")]
    got = {r.doc_id: (r.n_removed, [(x.start, x.end) for x in r.spans]) for r in suffix_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (250, [(100_000, 100_250)]), 2: (250_000, [(0, 250_000)]), 3: (250, [(1, 251)]), 4: (0, [])}
    assert suffix_dedup.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -- filter overlaps ---------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    fails = []
    for i, t, part in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append((part, {k for k, v in f.items() if v}, *labels.get(i, (0, 0))))
    out, removed = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, c in enumerate(order, 1):
            past = set(order[: step - 1])
            for part in {p for p, *_ in fails}:
                own = [x for x in fails if x[0] == part]
                taken = [x for x in own if c in x[1] and not x[1] & past]
                removed[part, c] += len(taken)
                out[part, order, step] = [
                    sum(not x[1] & past and c not in x[1] for x in own), len(taken), sum(c in x[1] and bool(x[1] & past) for x in own), sum(x[1] == {c} for x in own), sum(x[2] for x in taken), sum(x[3] for x in taken),
                ]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, sf, docs, rows):
    more = [(1000, 1, 0), (1000, 0, 1), (None, 1, 1), (900009, 1, 1), (900004, 0, 1)]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").unionByName(spark.createDataFrame(more, "doc_id long, quality int, toxic int"))
    marks = collections.defaultdict(lambda: (0, 0))
    for r in labels.collect():
        if r.doc_id is not None:
            marks[r.doc_id] = (max(marks[r.doc_id][0], int(r.quality == 1)), max(marks[r.doc_id][1], int(r.toxic == 1)))
    given = docs.withColumn("mask", filter_audit.F.lit(7)).withColumn("hash", filter_audit.F.lit("clash"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(given, labels).collect()}
    assert got == brute_audit(rows, marks)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


def test_duplicates_by_partition_refinement(spark, monkeypatch):
    random.seed(2)
    base = ["".join(random.choices("ab", k=n)) for n in (0, 1, 511, 512, 513, 2000, 9000)]
    rows = [(i, random.choice(base)) for i in range(300)] + [(3, "again"), (3, "again"), (4, "again"), (None, "again"), (None, None), (7, None), (5, base[-1][:-1] + "c"), (6, base[-1][:-1] + "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = {(i, t or "") for i, t in rows if i is not None and first[t or ""] < i}
    hashed = df.select("doc_id", filter_audit.F.coalesce("text", filter_audit.F.lit("")).alias("text")).withColumn("hash", filter_audit.F.xxhash64("text"))
    found = lambda: {(r.doc_id, r.text) for r in hashed.join(filter_audit.duplicates(df), ["doc_id", "hash"]).collect()}
    assert found() == want
    # with hashes that all clash, full texts still decide
    monkeypatch.setattr(filter_audit, "refine", lambda rows: write_table(rows.withColumn("class", filter_audit.F.lit(1).cast("long")), "classes"))
    assert found() == want


# -- importance resampling ---------------------------------------------------------------------------------------------


def brute_resample(rows, target, size, buckets, percent, least):
    def features(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t).encode())
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, size + 1) for i in range(len(w) - n + 1)]

    own, other = [features(t) for _, t, _ in rows], [features(t) for t in target]
    s, t = collections.Counter(b for _, f in own for b in f), collections.Counter(b for _, f in other for b in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (i, _, _), (words, f) in zip(rows, own):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = order[: len(order) * percent // 100]
    return out, drawn


@pytest.mark.parametrize("size,buckets,percent,least", [(1, 10000, 10, 20), (2, 64, 50, 2)])
def test_importance_resampling(spark, sf, docs, rows, size, buckets, percent, least):
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, "", "One word!"]
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    every, drawn = brute_resample(rows, [t or "" for t in bench], size, buckets, percent, least)
    given = docs.withColumn("rank", importance.F.lit("clash")).withColumn("kind", importance.F.lit(1)).withColumn("bucket", importance.F.lit(1))
    got = importance.resample(given, target, size, buckets, 2024, percent, least).collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == collections.Counter(x[:4] for x in every)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(x[0], x[3]) for x in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_importance_of_nothing(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).collect() == []
    got = importance.resample(docs.filter("doc_id = 900002 or doc_id = 900001"), none).collect()
    assert [(r.n_features, r.weight, r["rank"]) for r in got] == [(0, 0, None)] * 2
    assert importance.resample(docs, none, keep=["source"]).columns == ["source", "n_features", "weight", "score", "rank"]
