"""Language-model scores, quality, toxicity, nearest neighbours, URL filter, preference pairs and the pipeline."""

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import _common, _labels, graph_ann, lm_scoring, preference, quality_gam, simhash, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900001, None), (900002, ""), (900003, " \t\n"), (900004, "One one"), (900004, "One one"), (900006, "naïve Ünï 日本 😀 x"), (None, "no id")]
    return real.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_language_model(docs, rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = {t: [*re.findall("[^\x20\x09-\x0d]+", lower(t)), None] for _, t in rows}
    out = lambda d: d is not None and fold(d, 5) == 1
    seen = collections.Counter(w for d, t in rows if not out(d) for w in tokens[t])
    n, v = sum(seen.values()), len(seen)
    want = collections.Counter()
    for d, t in rows:
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[t])
        want[d, out(d), len(tokens[t]), sum(seen[w] > 0 for w in tokens[t]), n, round(base, 5)] += 1
    for head in (lm_scoring.HEAD, 50):
        got = lm_scoring.score(docs, lm_scoring.fold("doc_id", 5) == 1, head=head).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(-math.inf < r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.report(docs.limit(0)).count() == 0
    alone = docs.filter("doc_id = 900006")
    assert lm_scoring.score(alone, lm_scoring.F.lit(True)).first().train_tokens == 0


def by_hand(rows, held_out, weights_of=None):
    """Scores from exact counts, quantised as the filter quantises them, and weights fitted token by token."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = [[None, *re.findall("[^\x20\x09-\x0d]+", lower(t)), None] for _, t in rows]
    train = [t for (d, _), t in zip(rows, tokens) if not held_out(d)]
    one, two = collections.Counter(w for t in train for w in t[1:]), collections.Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    level = lambda c, k: 1 + math.floor(math.log(c) / math.log((1.25, 1.6)[k]) + 1e-9) if c else 0

    def value(c, k):
        if not c:
            return 0.0
        base, x = (1.25, 1.6)[k], level(c, k)
        low = math.ceil(base ** (x - 1) - 1e-9)
        return math.sqrt(low * max(low, math.ceil(base**x - 1e-9) - 1))

    def parts(a, b, less):
        c, both, total = (max(value(x, k) - less, 0) for x, k in ((one[b], 0), (two[a, b], 1), (one[a], 0)))
        at = level(round(total), 0) if less else level(one[a], 0)
        return (c + 0.5) / (n + 0.5 * (v + 1)), min(1.0, both / total) if total > 0 else 0.0, at

    seen = [parts(a, b, 1.0) for t in train for a, b in zip(t, t[1:])]
    w = collections.defaultdict(lambda: 0.3)
    size = collections.Counter(at for *_, at in seen)
    for _ in range(30):
        total = collections.Counter()
        for p, q, at in seen:
            total[at] += w[at] * q / max(w[at] * q + (1 - w[at]) * p, 1e-300)
        w = collections.defaultdict(lambda: 0.3, {at: (total[at] + 0.6) / (size[at] + 2.0) for at in range(256)})
    w = {at: min(max(x, 0.0), 0.99) if at else 0.0 for at, x in w.items()}
    out = []
    for t in tokens:
        each = [parts(a, b, 0.0) for a, b in zip(t, t[1:])]
        out.append(sum(math.log10(w[at] * q + (1 - w[at]) * p) for p, q, at in each))
    return out


def test_language_model_scores(spark, docs, rows):
    out = lambda d: d is not None and fold(d, 5) == 1
    want = by_hand(rows, out)
    exact = sorted((str(d), len(t), round(s, 4)) for (d, t), s in zip(rows, want))
    given = {str(d): (s, len(re.findall("[^\x20\x09-\x0d]+", t)) + 1) for (d, t), s in zip(rows, want)}
    sized = docs.withColumn("n_known", F.lit("clash")).withColumn("rid", F.lit(1))
    first = None
    for settings in ({}, {"filter_bytes": 20_000}, {"filter_bytes": 0}, {"filter_bytes": 300_000, "head": 300}):
        got = lm_scoring.score(sized, lm_scoring.fold("doc_id", 5) == 1, **settings).collect()
        gaps = [abs(r.score - given[str(r.doc_id)][0]) / r.n_tokens for r in got]
        # false hits of the filter are all that parts them
        assert sum(gaps) / len(gaps) < 0.01 and max(gaps) < 2, settings
        # and they are the same however much of it is broadcast
        now = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.score, r.base_score) for r in got)
        first = first or now
        assert [x[:3] for x in now] == [x[:3] for x in first]
        assert all(a[3:] == pytest.approx(b[3:], abs=1e-9, rel=0) for a, b in zip(now, first)), settings
    # and with bits to spare nothing does
    few = [(d, t) for d, t in rows if d is None or d % 4 == 0 or d > 900_000]
    want = sorted((str(d), round(s, 6)) for (d, _), s in zip(few, by_hand(few, out)))
    some = docs.filter("doc_id is null or doc_id % 4 = 0 or doc_id > 900000")
    for settings in ({}, {"filter_bytes": 2_000_000}):
        got = lm_scoring.score(some, lm_scoring.fold("doc_id", 5) == 1, per_level=2000, **settings).collect()
        assert [(i, pytest.approx(s, abs=2e-6)) for i, s in want] == sorted((str(r.doc_id), round(r.score, 6)) for r in got)


def test_what_is_asked_is_a_row_for_a_block_and_range(spark):
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), (F.col("id") * 7 + i) % 90) for i in range(20)]).alias("text"))
    rows = texts.withColumn("held_out", F.col("doc_id") % 5 == 1)
    model, table = lm_scoring.learn(rows.filter("not held_out"), filter_bytes=0)
    first = lm_scoring.write_table(lm_scoring._first_pass(rows.coalesce(2), spark.sparkContext.broadcast(model), 1000), "first")
    blocks = first.select("block").distinct().count()
    assert 8 <= blocks <= 12 and model.parts == 32
    asked = lm_scoring._asked(first, "pairs", model.parts)
    said = [lm_scoring._said(x, table, k) for k, x in ((1, lm_scoring._asked(first, "asked", model.parts)), (2, asked))]
    # not one for each of 400 texts and each range that it asks
    assert asked.count() <= blocks * model.parts and said[1].count() <= blocks * model.parts
    got = {r.rid: r for r in lm_scoring._filled(first, said[0].unionByName(said[1])).collect()}
    assert len(got) == 400 and not any(lm_scoring.ASK in r.word + r.both for r in got.values())
    whole, _ = lm_scoring.learn(rows.filter("not held_out"))
    for r in lm_scoring._first_pass(rows.coalesce(2), spark.sparkContext.broadcast(whole)).collect():
        held = got[r.rid]
        assert (r.doc_id, r.word, r.n_tokens) == (held.doc_id, held.word, held.n_tokens)
        assert all(a == b for w, a, b in zip(bytes([1]) + r.word, r.both, held.both) if w)  # a word before that is unknown


def test_words_of_long_texts(monkeypatch):
    texts = [b"Ab  cd" * 50, b"", b"x" * 900, b" a b ", b"w1 w2\tw3\n" * 40]
    want = _common.word_hashes(texts)
    monkeypatch.setattr(_common, "CHUNK", 100)
    got = _common.word_hashes(texts)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and want[1].tolist() == [len(t.split()) for t in texts]


def test_filter_keeps_levels():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    c = rng.integers(1, 300, len(h))
    data = lm_scoring.region(h, c, 1)
    level = lm_scoring.probed(h, data, 0, len(data))
    assert (level >= lm_scoring.levels_of(c, 1)).all() and (level == lm_scoring.levels_of(c, 1)).mean() > 0.95
    assert (lm_scoring.probed(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), data, 0, len(data)) > 0).mean() < 0.03
    some, said = lm_scoring._frequent(h, c, data, 700)
    assert len(some) == 700 and (np.diff(some.astype(object)) > 0).all() and min(c[np.isin(h, some)]) >= max(c[~np.isin(h, some)])
    assert (said == lm_scoring.probed(some, data, 0, len(data))).all()


def accuracy(spark, got, label, parts, remainder):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id], r.score) for r in got if r.doc_id in labels and fold(r.doc_id, parts) == remainder]
    assert held and all(r.held_out == (r.doc_id is not None and fold(r.doc_id, parts) == remainder) for r in got)
    return sum(p == y for p, y, _ in held) / len(held)


def test_quality(spark, docs, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_gam.report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert accuracy(spark, got, "quality", 5, 0) > 0.97
    assert quality_gam.report(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1)], "doc_id long, quality int")
    assert quality_gam.report(docs, odd).count() == len(rows)
    clash = docs.selectExpr("doc_id", "text", "1 score", "'x' `__text`")
    assert set(quality_gam.keep_good(clash, labels).columns) == {"doc_id", "text", "score", "__text"}


def test_quality_features_and_scores_by_hand(spark, docs, rows):
    def features(t):
        raw = t.encode()
        if not raw:
            return [0.0] * len(quality_gam.FEATURES)
        share = lambda f: sum(map(f, raw)) / len(raw)
        among = lambda chars: share(lambda b: b in chars)
        words = raw.lower().split()
        n, lines = max(1, len(words)), [x for x in raw.split(b"\n") if x.strip()]
        spaces = sum(b in b" \t\n\r" for b in raw)
        return [
            math.log1p(len(raw)), math.log1p(len(words)), (len(raw) - spaces) / n, math.log1p(max(map(len, words), default=0)),
            share(lambda b: 65 <= b <= 90), among(b"0123456789"), among(b"#$%&*+/<=>@[\\]^_`{}~"), among(b"|"), among(b".,;:"), among(b"!?"), spaces / len(raw),
            share(lambda b: b >= 128), share(lambda b: (b < 32 and b not in b"\t\n\r") or b == 127),
            sum(a == b for a, b in zip(words, words[1:])) / n, max((words.count(w) for w in set(words)), default=0) / n, len(set(words)) / n**0.8,
            1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(raw) / max(1, len(lines))), sum(len(w) <= 2 for w in words) / n,
        ]

    texts = [t for _, t in rows[:40]] + ["", " \n", "a a B\n\nx!|x\x01\x7f é", "One, TWO; 33 #"]
    assert np.allclose(quality_gam.matrix([t.encode() for t in texts]), [features(t) for t in texts])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_gam.train(docs, labels)
    for n in (2, 32):
        other = quality_gam.train(docs.repartition(n), labels.repartition(n))
        assert all((a == b).all() for a, b in zip(model.tables, other.tables)) and model.intercept == other.intercept
    want = []
    for t in texts:
        x = features(t)
        at = [sum(edge <= v for edge in edges) for edges, v in zip(model.edges, x)]
        margin = model.intercept + sum(table[i] for table, i in zip(model.tables, at)) + sum(table[at[j], at[k]] for j, k, table in model.pairs)
        want.append(1 / (1 + math.exp(-margin)))
    assert len(model.pairs) == 6 and np.allclose(model.score(quality_gam.matrix([t.encode() for t in texts])), want, atol=1e-9)
    long = spark.createDataFrame([("long", "A quiet sentence stands here. " * 100_000, 1)], "doc_id string, text string, score int")
    assert 0 <= quality_gam.report(long, labels).first().score <= 1 and quality_gam.keep_good(long, labels.limit(0)).collect() == long.collect()


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    plain, paired = quality_gam.fit(x, y, pairs=0), quality_gam.fit(x, y, pairs=1)
    right = lambda m: ((m.score(x) > 0.5) == y).mean()
    assert right(plain) < 0.7 and right(paired) > 0.95


def test_toxicity(spark, docs, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert accuracy(spark, got, "toxic", 3, 1) > 0.94  # 260 labelled rows, some of them wrong
    assert toxicity.report(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.report(docs.limit(0), labels).count() == 0
    model = toxicity.train(docs, labels)
    assert model.score([b"you 1d10t clown", b"a fine day", b""]).round().tolist() == [1, 0, 0]
    # the same entries and scores however rows lie
    for n in (2, 16, 64):
        other = toxicity.train(docs.repartition(n), labels.repartition(n))
        assert other.names == model.names and (other.weights == model.weights).all() and other.bias == model.bias
    odd = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("score"), F.lit("x").alias("y"))
    long = spark.createDataFrame([("long", "idiot moron " + "word " * 400_000, 1, "y")], odd.schema)
    assert {r.doc_id: r.predicted for r in toxicity.report(odd.unionByName(long), labels).collect()}["long"] == 1


def test_sample_of_labels_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40 if i < 400 else 7, f"t{i % 40 if i < 400 else 999 - i}") for i in range(900)] + [(None, "x"), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (50, 1)] * 2 + [(5, 9)], "doc_id long, toxic int")
    whole = _labels.labelled(docs, labels, "toxic", 3, 1).collect()
    want = {i for i in [*range(40), 50] if fold(i, 3) != 1} - {3, 50}
    least = {7: min(["t7", *(f"t{999 - i}" for i in range(400, 900))])}
    assert sorted((r.text, r.y) for r in whole) == sorted((least.get(i, f"t{i}"), i % 2) for i in want)
    few = [_labels.labelled(docs.repartition(n), labels.repartition(n), "toxic", 3, 1, 10).collect() for n in (1, 9)]
    assert len(few[0]) <= 10 and sorted(few[0]) == sorted(few[1])


def test_mined_entries_and_votes(docs, rows):
    texts = [t for _, t in rows[:300]]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def words(text):
        found = set(re.findall("[^\x00-\x23\x25-\x2f\x32\x36\x38\x39\x3a-\x3f\x41-\x60\x7b-\x7f]+", lower(text)))
        return {w.encode() for w in found} | {w.translate(str.maketrans("013457@$", "oieastas")).encode() for w in found}

    def entries(text):
        w = words(text)
        return w | {x[:n] + b"*" for x in w for n in (4, 5, 6) if len(x) > n}

    for t in [*texts, "1d10T $h!t ABC9x", ""]:
        assert toxicity.entries(t.encode()) == entries(t), t
    toxic = [i % 7 == 0 for i in range(len(texts))]
    count = lambda y: collections.Counter(e for t, x in zip(texts, toxic) if x == y for e in entries(t))
    got = toxicity.mine(count(True), count(False), sum(toxic), len(texts) - sum(toxic))
    share = lambda e, y: sum(e in entries(t) for t, x in zip(texts, toxic) if x == y)
    for e in got[len(toxicity.SEEDS) :]:
        assert share(e, True) >= 4 and share(e, True) / sum(toxic) >= 12 * (share(e, False) + 0.5) / (len(texts) - sum(toxic))
    names = [b"idiot", b"clow*"]
    cases = {
        "": [0, 0, -1, 0, -1, -1, 0, -1], "You IDIOT!!!! clowns": [1, 1, 0, 1, 0, 1, 1, 0], "IDIOT CLOWNS YOU ALL": [1, 1, 0, 1, 1, -1, 1, 0],
        "an idiot walks along the road": [1, 0, 0, 0, -1, -1, 0, 0], "a quiet, even road? yes": [0, 0, -1, 0, -1, 0, 0, 0],
    }
    assert {t: toxicity.votes(t.encode(), names) for t in cases} == cases


def test_label_model_sees_accuracy_and_correlation():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.4
    vote = lambda p: np.where(rng.random(6000) < p, np.where(y, 1, -1), np.where(y, -1, 1))
    a, b, c, d = vote(0.9), vote(0.8), vote(0.75), vote(0.6)
    v = np.stack([a, b, c, d, np.where(rng.random(6000) < 0.97, d, -d)], 1)
    model = toxicity.label_model(v, (v.sum(1) > 0).astype(float), pull=0.0)
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.88
    assert model.parents[4] == 3 or model.parents[3] == 4
    found = model.accuracy(v)
    assert found[0] > found[1] > found[3]
    # labels anchor the model but do not decide: a fifth of them wrong changes little
    wrong = np.where(rng.random(6000) < 0.2, ~y, y)
    assert ((toxicity.label_model(v, wrong.astype(float)).posterior(v) > 0.5) == y).mean() > 0.88


def test_posteriors():
    rng = np.random.default_rng(4)
    v = rng.integers(-1, 2, (400, 4))
    v[:, 2] = np.where(rng.random(400) < 0.9, v[:, 1], v[:, 2])
    model = toxicity.label_model(v, (v[:, 0] > 0).astype(float))
    assert max(model.parents) >= 0
    for row, p in zip(v, model.posterior(v)):
        both = []
        for y in (0, 1):
            x = model.share if y else 1 - model.share
            for j, k in enumerate(model.parents):
                x *= model.tables[y, j, row[k] + 1 if k >= 0 else 0, row[j] + 1]
            both.append(x)
        assert math.isclose(p, both[1] / sum(both), rel_tol=1e-6)
    assert np.allclose(model.tables.sum(3), 1)


def brute(vectors, is_query, k):
    fine = {}
    for i, x in vectors:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x):
            fine.setdefault(i, []).append(np.array(x, np.float32).astype(float))
    out = {}
    for q in (i for i in fine if is_query(i)):
        best = sorted((-float(x @ fine[q][0]), i) for i, xs in fine.items() if i != q for x in xs)[:k]
        out[q] = [(i, round(-s, 9)) for s, i in best]
    return out


def test_neighbours(spark):
    real = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = [(r.vec_id, r.embedding) for r in real.collect()]
    want = brute(given, lambda i: i % 20 == 0, 20)
    got = collections.defaultdict(list)
    for r in graph_ann.report(real).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.95


def test_neighbours_odd(spark):
    x = [(i, [float(i % 5), 1.0, 0.5]) for i in range(60)]
    x += [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (7, [2.0, 1.0, 0.5]), (120, [3.0, 3.0, -4.0])]
    x += [(105, []), (106, [float("inf"), 1.0, 1.0]), (107, [1e-30, 0.0, 0.0]), (108, [1e30, -1e30, 1e30])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>").withColumn("score", graph_ann.F.lit(1)).withColumn("band", graph_ann.F.lit("x"))
    want = brute([v for i, v in enumerate(x) if i != 65], lambda i: i % 20 == 0, 20)
    got = lambda df: {q: [(r.vec_id, round(r.score, 9)) for r in rs] for q, rs in itertools.groupby(graph_ann.report(df).orderBy("query_id", "rank").collect(), lambda r: r.query_id)}
    assert got(df) == want
    # vectors of another number of components are searched among themselves
    two = [(200 + i, [1.0, float(i)]) for i in range(30)]
    both = df.unionByName(spark.createDataFrame(two, "vec_id long, embedding array<float>").withColumn("score", graph_ann.F.lit(1)).withColumn("band", graph_ann.F.lit("x")))
    assert got(both) == want | brute(two, lambda i: i % 20 == 0, 20)
    assert graph_ann.report(df.limit(0)).count() == 0
    assert len(graph_ann.report(df.filter("vec_id in (20, 21)")).collect()) == 1


@pytest.mark.parametrize("kind", ["unit", "clustered", "log-normal", "outliers", "copies"])
def test_neighbours_of_uneven_lengths(spark, kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "clustered":
        x = x[rng.integers(0, 30, 3000)] + 0.05 * x
    if kind == "log-normal":
        x *= np.exp(rng.normal(size=(3000, 1)))
    if kind == "outliers":
        x[:3] *= np.array([[1e4], [1e8], [1e-6]])
    if kind == "copies":
        x[rng.random(3000) < 0.4] = x[5]
    given = list(enumerate(x.astype(np.float32).tolist()))
    want = brute(given, lambda i: i % 20 == 0, 20)
    got = collections.defaultdict(dict)
    for r in graph_ann.report(spark.createDataFrame(given, "vec_id long, embedding array<float>")).collect():
        got[r.query_id][r.rank] = r.score
    # by score, as copies tie; each rank as good as the best
    hit = [sum(got[q].get(k + 1, -math.inf) >= s - 1e-6 * abs(s) for k, (_, s) in enumerate(want[q])) / 20 for q in want]
    assert np.mean(hit) > 0.95


def test_recall_within_a_shard():
    # as many vectors as a shard holds, with little structure: the hardest case; and with the lengths that a shard has
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 64))
    for scale in (1 / np.linalg.norm(x, axis=1, keepdims=True), 1.0, np.exp2(0.5 * rng.random((6000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)):
        y = x * scale
        graph, entry = graph_ann.build(graph_ann.directions(y))
        found, _ = graph_ann.beam_search(y.astype(np.float32), graph, entry, graph_ann.directions(y[:100]), graph_ann.BEAM, True)
        best = np.argsort(-y @ y[:100].T, axis=0)[:20].T
        assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(found, best)]) > 0.93


def test_url_filter(spark):
    pages = [
        (1, "http://Good.Example.ORG/en/7?x", '<a href="http://mid.example.net/a">m</a>'), (2, "https://mid.example.net/", '<A HREF=//far.example.net>f</A><a href="/in">i</a>'),
        (3, "http://far.example.net#x", None), (4, "http://links.example.net/x", "<a class=y href='http://bad.example.com/de/1'>b</a>"), (5, "http://bad.example.com/de/2", ""),
        (6, None, None), (7, "no scheme", "<a href='http://x.y/'>"), (8, "http://example.org/es/1", ""), (9, "http://example.org/en/12", ""), (10, "http://example.org", ""),
        (11, "http://bad.example.com/fr/", ""), (12, "a://b://org/", ""), (1, "http://Good.Example.ORG/en/7?x", '<a href="http://mid.example.net/a">m</a>'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[1] == ("good.example.org", "/en/7", "org/", "allow") and got[2][2:] == (None, "allow")
    assert got[4] == ("links.example.net", "/x", None, "block") and got[5][2:] == ("com/de/", "block")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[10] == ("example.org", "", None, "block")
    assert got[8][2:] == ("example.org/es/", "block") and got[9][2:] == ("example.org/en/1", "block") and got[11][2:] == ("com/fr/", "allow")
    assert got[12][0] == "b:"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    said = con.execute(url_filter.oracle()).fetchall()
    assert sorted(map(str, said)) == sorted(str(tuple(r)) for r in url_filter.judge(df).collect())
    assert url_filter.judge(df.limit(0)).count() == 0
    clash = df.selectExpr("concat('p', page_id) page_id", "concat(url, repeat('x', 200000)) url", "html", "1 host", "2 trust", "'x' verdict")
    assert url_filter.judge(clash).count() == len(pages)


def test_distrust_goes_up_a_long_chain(spark):
    chain = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">x</a>') for i in range(12)]
    chain.append((12, "http://h12.net/bad/", ""))
    df = spark.createDataFrame(chain, "page_id long, url string, html string")
    got = url_filter.judge(df, (("block", "h12.net", "/bad/"),)).collect()
    assert {r.verdict for r in got} == {"block"} and len(got) == 13


def test_preference(spark):
    say = lambda *x: [(0, i, r, t) for i, (r, t) in enumerate(x)]
    a = say(("system", "s"), ("user", "u"), ("assistant", "yes"), ("user", None))
    b = say(("system", "s"), ("user", "u"), ("assistant", "no😀"))
    chosen = [*a, a[0], (1, 0, "user", "only"), (2, None, None, "x"), (None, 0, "user", "lost")] + [(3, i, "user" if i < 150 else "assistant", str(i)) for i in range(200)] + [(4, 0, "assistant", "x" * 2_000_000)]
    rejected = [*b, (2, None, None, "x"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a")] + [(3, i, "user" if i < 150 else "assistant", str(i) if i < 150 else "z") for i in range(299)]
    frame = lambda x: spark.createDataFrame(x, "pair_id long, turn long, role string, text string")
    clash = frame(chosen).selectExpr("*", "1 block", "'x' shared", "'y' side")
    got = {r.pair_id: r for r in preference.format_pairs(clash, frame(rejected)).collect()}
    first = got[0]
    assert first.prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
    assert first.chosen == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    cut = lambda text, mask: [text[int(x.split(":")[0]) : int(x.split(":")[1])] for x in mask.split(",")]
    assert cut(first.chosen, first.chosen_mask) == ["yes"] and cut(first.rejected, first.rejected_mask) == ["no😀"]
    assert got[1].prompt == "" and got[1].rejected == "" and "only" in got[1].chosen
    assert got[2].prompt == "<|im_start|>\nx<|im_end|>\n" and cut(got[2].rejected, got[2].rejected_mask) == ["a", "b"]
    # one row, whatever the number of turns, and masks over the whole completion
    say = lambda x: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in x)
    assert got[3].prompt == say(("user", i) for i in range(150))
    assert got[3].chosen == say(("assistant", i) for i in range(150, 200)) and cut(got[3].chosen, got[3].chosen_mask) == [str(i) for i in range(150, 200)]
    assert cut(got[3].rejected, got[3].rejected_mask) == ["z"] * 149
    assert len(got[4].chosen) > 2_000_000 and got[4].prompt == "" and cut(got[4].chosen, got[4].chosen_mask) == ["x" * 2_000_000]
    assert sorted(got) == [0, 1, 2, 3, 4]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [(2 * r[0] + odd if r[0] is not None else None, *r[1:]) for odd, side in enumerate((chosen, rejected)) for r in side])
    said = con.execute(preference.ORACLE)
    names = [d[0] for d in said.description]
    assert sorted(map(str, (dict(zip(names, x)) for x in said.fetchall()))) == sorted(str(r.asDict()) for r in got.values())
    assert preference.format_pairs(frame([]), frame([])).count() == 0


def test_near_dedup(spark, docs, rows):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t.lower())

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    first = {}
    for d, t in rows:
        first.setdefault(" ".join(words(t)), t)
    texts = list(first)
    sets = [shingles(first[t]) for t in texts]
    holders = collections.defaultdict(list)
    above = list(range(len(texts)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                above[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    number = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        r = root(number[" ".join(words(t))])
        least[r] = min(least.get(r, (2, 0)), (d is None, d or 0))
    want = {(None if none else d) for none, d in least.values()}
    got = simhash.near_dedup(docs).collect()
    assert len(got) == len(least) and {r.doc_id for r in got} == want
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def joined(texts, similarity=0.8):
    """The first number of each text's group, by brute force over five-word shingles."""
    sets = [set(zip(*(x.split()[i:] for i in range(5)))) for x in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and len(a & b) >= similarity * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_near_dedup_joins_within_buckets(spark):
    # copies like their original but not each other, and like pairs around a passage that all share
    dice = random.Random(5)
    word = lambda: f"w{dice.randrange(10**6)}"

    def edited(words, n):
        out = list(words)
        for at in dice.sample(range(len(out)), n):
            out[at] = word()
        return out

    texts = []
    for _ in range(3):
        first = [word() for _ in range(300)]
        texts += [first, *(edited(first, 4) for _ in range(60))]
    passage = [word() for _ in range(80)]
    for _ in range(60):
        own = [word() for _ in range(60)]
        texts += [passage + own, passage + edited(own, 2)]
    texts = [" ".join(x) for x in texts]
    want = sorted(set(joined(texts)))
    assert len(want) < 80
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == want
    # buckets beyond a block: by prefixes, and those in blocks if all entries come in any order
    rows = simhash._sketches(df, 5).cache()
    labels = rows.select("rid", F.col("rid").alias("label"), "size", F.posexplode("minima").alias("kind", "least"))
    of = {r.rid: r.doc_id for r in rows.collect()}
    filings = lambda common: simhash._prefix_filings(rows.select("rid", F.col("rid").alias("label"), "size", "shingles"), 0.8, common)
    every = lambda common, block: simhash._compared(rows, filings(common), simhash._open_buckets(filings(common), block), 0.8)
    for found in (simhash.bucket_links(rows, labels, 0.8, 4000), every(1 << 20, 1 << 20), every(4, 3000)):
        group = {i: i for i in range(len(texts))}
        for u, v in found.collect():
            low, high = sorted((group[of[u]], group[of[v]]))
            group = {k: low if g == high else g for k, g in group.items()}
        assert sorted(set(group.values())) == want


def test_what_needs_no_second_comparison_stays(spark):
    # buckets of two are met by their hub, and of three and more the hub has met all others
    nodes = spark.createDataFrame([(1, 10, [5, 7]), (2, 11, [5, 8]), (3, 40, [6, 8]), (4, 12, [9, 8])], "rid long, size long, minima array<long>")
    labels = nodes.select("rid", F.col("rid").alias("label"))
    filed = simhash.not_met(simhash.shared_minima(nodes), labels)
    assert {(r.kind, r.least): r["n"] for r in filed.groupBy("kind", "least").agg(F.count("*").alias("n")).collect()} == {(0, 5): 1, (1, 8): 2}
    assert [(r.k, r.l) for r in simhash._open_buckets(filed, 1 << 20).collect()] == [(1, 8)]
    held = spark.createDataFrame([(1, 10, 1), (2, 13, 1), (3, 16, 1), (4, 30, 1), (5, 100, 2), (6, 80, 2), (7, 8, 3), (8, 11, 3)], "rid long, size long, l long").withColumn("k", F.lit(0))
    assert sorted(r.rid for r in simhash._near_in_size(held, 0.8).collect()) == [2, 3, 5, 6]


def test_near_dedup_within_a_passage_of_all(spark, monkeypatch):
    # pairs of similarity 0.84 that share 600 words with all others, to which they have 0.48
    dice = random.Random(8)
    word = lambda: f"w{dice.randrange(10**6)}"
    passage, texts = [word() for _ in range(600)], []
    for _ in range(200):
        own = [word() for _ in range(330)]
        cut = dice.randrange(0, 250)
        texts += [passage + own, passage + own[:cut] + [word() for _ in range(75)] + own[cut + 75 :]]
    texts = [" ".join(x) for x in texts]
    assert sorted(set(joined(texts[:60]))) == list(range(0, 60, 2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == list(range(0, 400, 2))
    monkeypatch.setattr(simhash, "FEW", 1)
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == list(range(0, 400, 2))


def test_near_dedup_keeps_columns_and_repeated_rows(spark):
    odd = spark.createDataFrame([("b", "One two", 1), ("a", "one  TWO", 2), ("a", "one  TWO", 2), (None, None, 3), ("c", "", 4), ("d", "x " * 300_000, 5)], "doc_id string, text string, __mark int")
    odd = odd.withColumns({"__id": F.lit("x"), "rid": F.lit(1), "a b": F.struct(F.lit(1).alias("c d"))})
    got = simhash.near_dedup(odd)
    assert got.columns == odd.columns and sorted((r.doc_id, r["__mark"]) for r in got.collect()) == [("a", 2), ("c", 4), ("d", 5)]


def test_near_dedup_counts_a_shingle_once(spark):
    # the same shingle sets, and fingerprints (which count repeats) far apart
    dice = random.Random(6)
    texts = []
    while len(texts) < 20:
        words = [f"w{dice.randrange(10**6)}" for _ in range(212)]
        pair = [" ".join(words[:200] + words[200:] * n) for n in (2, 101)]
        a, b = (simhash.fingerprint(simhash.shingle_hashes(x.encode(), 5)) for x in pair)
        if (a ^ b).bit_count() > 22:
            texts += pair
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == list(range(0, 20, 2))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.schema.names == docs.schema.names, name
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "ids"] and 0 < out.count() == kept.count() < docs.count()


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tessella.llm import quality_gam
    from tessella.llm.queries import bpe_path

    from .test_text_ops import spans_of

    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(9001, None), (9002, ""), (9003, " \t"), (9004, "One two three."), (9004, "One two three."), (9005, "word " * 60_000), (9006, "password=abcdefghijklmnop"), (None, "No id at all here.")]
    more = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as bigint) n_chars")
    docs = real.unionByName(more).withColumns({"score": F.lit("clash"), "__mark": F.lit(1), "a b": F.struct(F.lit(1).alias("c d"))})
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.schema.names == docs.schema.names, name
    assert corpus_pipeline.STAGES[1][1](spark, docs.limit(0), sf).count() == corpus_pipeline.STAGES[0][1](spark, docs.limit(0), sf).count() == 0
    # quality by the model's own tables, the rest by hand
    model = quality_gam.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r, s in zip(rows, model.score(quality_gam.matrix([(t or "").encode() for _, t in rows]))) if s >= 0.3]
    split = [re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) for _, t in rows]
    sets = [set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set() for w in split]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and (split[i] == split[j] or (a and b and len(a & b) >= 0.8 * len(a | b))):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    rows = [min((rows[i] for i in range(len(rows)) if group[i] == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in sorted(set(group))]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    rows = [(d, t) for d, t in rows if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))]
    library = Tokenizer.from_file(bpe_path())
    want = collections.Counter()
    for d, t in rows:
        t, out, at = t or "", [], 0
        for a, _, b in spans_of(t):
            if a >= at or not out:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        want[d, tuple(library.encode("".join(out) + t[at:], add_special_tokens=False).ids)] += 1
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == want
