"""Ingest, vectors, clusters, facets, search, streams and the registry."""

import math
import os
import random
import re
import time
from xml.etree import ElementTree

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import registry, schema
from tessella.operators import clustering, facets, features, ingest, search
from tessella.operators import similarity as sim
from tessella.plans import cluster_job, handlers
from tessella.sources import feeds
from tessella.streaming import ingest as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return int(x) if isinstance(x, np.integer) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    said = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in said.description]
    assert sorted(names) == sorted(got.columns)
    rows = [{c: plain(v) for c, v in zip(names, r)} for r in said.fetchall()]
    want = sorted(str(sorted(r.items())) for r in rows)
    assert sorted(str(sorted((k, plain(v)) for k, v in r.asDict().items())) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def items(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.RAW_ITEMS) for r in rows], schema.RAW_ITEMS)


def test_process_items(spark):
    raw = items(
        spark,
        [
            {"feed": "f", "seq": 2, "link": "http://x/1", "title": "Later copy"},
            {"feed": "f", "seq": 1, "link": "http://x/1", "title": "Court denies NASA appeals v. Jones", "summary": "<b>a</b> &lt;", "published": "2020-01-02"},
            {"feed": "f", "seq": 3, "title": "No link", "category": "own"}, {"feed": "f", "seq": 4, "link": "http://x/old", "title": "Old"},
        ],
    )
    defs = spark.createDataFrame([("f", "http://r", "Feed", "law")], schema.FEEDS)
    stored = spark.createDataFrame([("x/old",)], "id string")
    got = {r.id: r for r in ingest.process_items(raw, defs, stored).collect()}
    assert set(got) == {"x/1", "Nolink"}
    first = got["x/1"]
    assert (first.summary, first.category, first.plaintiff, first.defendant) == ("a <", "law", "Court denies NASA appeals", "Jones")
    assert "nasa" in first.ngram and "court deni" in first.ngram and first.clustered is False and first.clusterid == "CourtdeniesNASAappealsvJones"
    assert str(first.date) == "2020-01-02 00:00:00" and got["Nolink"].category == "own" and got["Nolink"].ngram == ["Nolink"]
    assert ingest.process_items(raw.limit(0), defs, stored).count() == 0


def test_read_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>T</title><link>http://x/1</link><pubDate>Tue, 03 Jun 2008 11:05:30 GMT</pubDate></item></channel></rss>")
    row = feeds.read_rss(spark, str(tmp_path), "f").first()
    assert (row.feed, row.title, row.link, row.published) == ("f", "T", "http://x/1", "Tue, 03 Jun 2008 11:05:30 GMT")


def test_read_rss_of_many_files(spark, tmp_path):
    for f in (3, 0, 7, 1, 6, 2, 5, 4):
        text = "".join(f"<item><title>{f}.{i}</title><link>http://x/{f}/{i}</link></item>" for i in range(3 + f))
        (tmp_path / f"f{f}.xml").write_text(f"<rss><channel>{text}</channel></rss>")
    got = feeds.read_rss(spark, str(tmp_path), "f")
    assert got.schema["seq"].dataType.simpleString() == "bigint"
    assert [r.title for r in got.orderBy("seq").collect()] == [f"{f}.{i}" for f in range(8) for i in range(3 + f)]
    defs = spark.createDataFrame([("f", "http://r", "Feed", "law")], schema.FEEDS)
    assert ingest.process_items(got, defs, spark.createDataFrame([], "id string")).count() == sum(3 + f for f in range(8))


def test_rich_files_and_quarantine(spark, tmp_path):
    (tmp_path / "a.txt").write_text("naïve")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    row = feeds.extract_rich(files).first()
    assert row.text == "naïve" and row.path.endswith("a.txt") and "ignored_length" in row.asDict()


def test_spell_by_brute_force(spark):
    dice = random.Random(2)
    make = lambda: "".join(dice.choice("abc") for _ in range(dice.randrange(1, 9)))
    terms, asked = sorted({make() for _ in range(120)}), sorted({make() for _ in range(40)})
    terms += ["x" * 20_000, "né😀", "n"]
    asked += ["x" * 19_999 + "y", "x" * 50, "ne😀", ""]

    def distance(a, b):
        if abs(len(a) - len(b)) > 2:
            return 9
        row = list(range(len(b) + 1)) if len(a) < 100 else None
        if row is None:
            return sum(x != y for x, y in zip(a, b))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for most in (2, 1):
        for w in asked:
            near = [(d, -(i % 3), t) for i, t in enumerate(terms) if 1 <= (d := distance(w, t)) <= most]
            if near:
                want[w] = min(near)
        frame = spark.createDataFrame([(t, i % 3) for i, t in enumerate(terms)], "term string, df long")
        got = {r.word: (r.distance, r.suggestion) for r in search.spell(spark.createDataFrame([(w,) for w in asked], "word string"), frame, most).collect()}
        assert got == {w: (d, t) for w, (d, _, t) in want.items()}, most
        want.clear()


def test_number_ranges_on_text_fields(spark, sf):
    df = spark.createDataFrame([("5", 5), ("12", 12), ("abc", 7), ("-3.5", None), (None, 9), ("1e1", 10)], "t string, n long")
    held = lambda q: sorted(str(r.t) for r in df.filter(search.Compiler(default="t").matches(search.parse(q))).collect())
    assert held("t:[5 TO 11]") == ["1e1", "5"] and held("t:[* TO 0]") == ["-3.5"] and held("n:[7 TO 10]") == ["1e1", "5"][:1] + ["None", "abc"]
    assert held("-t:[5 TO 11]") == ["-3.5", "12", "None", "abc"] and held("t:[a TO b]") == ["abc"]
    part = spark.read.parquet(f"{sf}/part.parquet").filter(search.Compiler().matches(search.parse("p_size:[10 TO 20]")))
    assert "GreaterThanOrEqual(p_size,10)" in part._jdf.queryExecution().executedPlan().toString()


def test_highlight_takes_the_best_fragment(spark):
    from tessella.functions import text

    body = "The end of " + "one long road " * 20 + "where the dog met The other dog, thesis aside. " + "x " * 200
    row = spark.createDataFrame([(body, "short name"), ("nothing", "short name"), (None, None)], "t string, n string")
    got = [r.x for r in row.select(text.highlight("t", ["the", "dog"], fragment=60).alias("x")).collect()]
    assert got[0].count("<em>") == 4 and "<em>The</em> other" in got[0] and "<em>the</em>sis" not in got[0] and len(got[0].replace("<em>", "").replace("</em>", "")) <= 90
    assert got[1:] == [None, None]
    assert [r.x for r in row.select(text.highlight("t", ["the"], alternate="n").alias("x")).collect()][1:] == ["short name", None]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from tessella.operators import store

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    at = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        store.shared_dir(at("spark://host:7077"))
    assert store.shared_dir(at("local[2]"))


def test_cluster_lines(spark, tmp_path):
    lines = spark.createDataFrame([("7,d1,d2\n",), ("8,d3,",)], "line string")
    assert sorted(map(tuple, feeds.parse_cluster_lines(lines).collect())) == [("d1", "mahout7"), ("d2", "mahout7"), ("d3", "mahout8")]
    feeds.write_cluster_lines(feeds.parse_cluster_lines(lines), str(tmp_path / "out"))
    assert feeds.read_cluster_lines(spark, str(tmp_path / "out")).count() == 3
    many = spark.range(500).selectExpr("cast(id as string) id", "if(id < 400, 'a', 'b') cluster")
    feeds.write_cluster_lines(many, str(tmp_path / "many"), 50)
    assert spark.read.text(str(tmp_path / "many")).count() > 6
    assert sorted(map(tuple, feeds.read_cluster_lines(spark, str(tmp_path / "many")).collect())) == sorted((str(i), "mahouta" if i < 400 else "mahoutb") for i in range(500))


def test_result_feed_and_writers(spark, tmp_path):
    docs = spark.createDataFrame([("1", "T", "S", None)], "id string, title string, summary string, date timestamp")
    assert "<title>T</title>" in feeds.result_feed(docs).first().xml and "<entry>" in feeds.result_feed(docs, "atom").first().xml
    two = spark.createDataFrame([("2", "<b> & c", "S", "2020-01-02 03:04:05", 1, ["x", "y"]), ("1", None, "late", "2021-01-01 00:00:00", 2, [])], "id string, title string, summary string, date string, place int, tags array<string>")
    two = two.withColumn("date", F.to_timestamp("date"))
    atom = ElementTree.fromstring(feeds.result_page(two, "atom", "place", "All", "/q").first().xml)
    n = "{http://www.w3.org/2005/Atom}"
    assert atom.find(f"{n}updated").text == "2020-01-02T03:04:05Z" and [e.find(f"{n}id").text for e in atom.iter(f"{n}entry")] == ["tag:2", "tag:1"]
    rss = ElementTree.fromstring(feeds.result_page(two, "rss", "place", "All", "/q").first().xml)
    assert rss.find("channel/title").text == "All" and [e.findtext("title") for e in rss.iter("item")] == ["<b> & c", None]
    html = feeds.result_page(two, "html", "place", "All").first().xml
    assert "<h1>All (2 documents)</h1>" in html and "<ul><li>x</li><li>y</li></ul>" in html
    for kind in ("json", "csv", "xml", "parquet"):
        feeds.write_results(docs.select("id", "title"), str(tmp_path / kind), kind)
        options = {"header": True} if kind == "csv" else {"rowTag": "doc"} if kind == "xml" else {}
        assert feeds.read_documents(spark, str(tmp_path / kind), kind, "id string, title string", **options).first().title == "T"


def test_idf_and_cosine(spark):
    assert spark.range(1).select(features.idf(F.lit(10), F.lit(3)).alias("x")).first().x == pytest.approx(math.log(4))
    assert spark.range(1).select(features.idf(F.lit(10), F.lit(None).cast("long")).alias("x")).first().x == pytest.approx(math.log(6))
    v = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("b", "y", 1.0), ("c", "z", 1.0), ("d", "y", 1.0)], "id string, feature string, weight double")
    want = {("a", "b"): 0.707107, ("b", "d"): 0.707107}
    for hot in (sim.HOT, 1):
        assert {(r.a, r.b): round(r.similarity, 6) for r in sim.cosine_pairs(v, hot=hot).collect()} == want
    both = features.vectors(spark.createDataFrame([("a", "entity", "x"), ("a", "ngram", "x")], "id string, kind string, feature string"), spark.createDataFrame([("ngram", "x", 1), ("entity", "x", 5)], "kind string, feature string, df long"), 10)
    assert [round(r.weight, 6) for r in both.collect()] == [round(math.log(11), 6)]


def test_hot_features_change_nothing(spark, sf):
    v = registry._vectors(registry._articles(spark, sf)).cache()
    pairs = lambda hot, least: {(r.a, r.b, round(r.similarity, 6)) for r in sim.cosine_pairs(v, least, hot).collect()}
    for least in (0.175, 0.6):
        assert pairs(3, least) == pairs(10**9, least) and pairs(3, least)


def stored(spark):
    rows = [("1", "red fox runs", ["red fox", "fox runs"], None), ("2", "red fox sleeps", ["red fox", "fox sleeps"], None), ("3", "other", ["blue cat"], "P"), ("4", "another", [], "P"), ("5", "alone", [], None)]
    df = spark.createDataFrame(rows, "id string, title string, ngram array<string>, plaintiff string")
    none = F.array().cast("array<string>")
    return df.withColumns({"entity": none, "entitykey": none, "defendant": F.lit(None).cast("string"), "feed": F.lit("f"), "feedkey": F.lit("f"), "category": F.lit("c"), "categorykey": F.lit("c"), "clustered": F.lit(False), "clusterid": F.concat(F.lit("k"), "id"), "mahoutclusterid": F.col("id")})


def test_cluster_job(spark):
    got = {r.id: r.clusterid for r in cluster_job.run(stored(spark)).collect()}
    assert got == {"1": "k2", "2": "k1", "3": "k4", "4": "k3", "5": "k5"}  # one step: labels swap
    assert cluster_job.run(stored(spark)).filter("not clustered").count() == 0
    batch = spark.createDataFrame([("1", "mahout9")], "id string, cluster string")
    assert {r.id: r.mahoutclusterid for r in cluster_job.run(stored(spark), batch).collect()}["1"] == "mahout9"


def test_candidates_by_party(spark):
    rows = [(f"{i:02}", "P", "D" if i % 3 else "E", [f"w{i // 4}"]) for i in range(24)] + [("x", None, "D", ["w0"]), ("y", None, None, ["none"])]
    docs = spark.createDataFrame(rows, "id string, plaintiff string, defendant string, ngram array<string>")
    v = docs.select("id", F.explode("ngram").alias("feature"), F.lit(2.0).alias("weight"))
    score = lambda a, b: 4.0 * (a[3] == b[3]) + 10.0 * (a[1] is not None and a[1] == b[1]) + 10.0 * (a[2] is not None and a[2] == b[2])
    want = {a[0]: sorted(((b[0], score(a, b)) for b in rows if b[0] != a[0] and score(a, b)), key=lambda x: (-x[1], x[0]))[:5] for a in rows}
    for tiers in (sim.TIERS, (1, 2)):
        got = {}
        for r in sim.candidates(docs, v, 5, tiers=tiers).orderBy("a", "rank").collect():
            got.setdefault(r.a, []).append((r.b, r.score))
        assert got == {k: x for k, x in want.items() if x}


def test_frequent_features_change_no_candidates(spark):
    dice = random.Random(4)
    rare = lambda: [f"r{dice.randrange(60)}" for _ in range(dice.randrange(0, 6))]
    rows = [(f"d{i:03}", sorted({*rare(), *(f"h{k}" for k in range(4) if dice.random() < 0.7)}), dice.choice([None, "p", "q"])) for i in range(150)]
    docs = spark.createDataFrame(rows, "id string, ngram array<string>, plaintiff string")
    one = docs.select("id", F.explode("ngram").alias("feature"))
    v = one.join(one.groupBy("feature").agg(F.count("*").alias("df")), "feature").select("id", "feature", features.idf(F.lit(150), F.col("df")).alias("weight")).cache()
    weight = {r.feature: r.weight for r in v.select("feature", "weight").distinct().collect()}
    for named in ([], ["plaintiff"]):
        want = {}
        for a in rows:
            each = []
            for b in rows:
                both, party = set(a[1]) & set(b[1]), bool(named and a[2] and a[2] == b[2])
                if a[0] != b[0] and (both or party):
                    each.append((-round(sum(weight[f] ** 2 for f in both) + 10.0 * party, 6), b[0], round(sum(weight[f] ** 2 for f in both), 5)))
            want[a[0]] = [(b, -s, dot) for s, b, dot in sorted(each)[:4]]
        for tiers in ((), (3,), (2, 8, 40)):
            got = {}
            for r in sim.candidates(docs.select("id", *named), v, 4, tiers=tiers).orderBy("a", "rank").collect():
                got.setdefault(r.a, []).append((r.b, round(r.score, 6), round(r.dot, 5)))
            assert got == {k: x for k, x in want.items() if x}, (named, tiers)


def test_blocks_give_the_same_pairs_and_candidates(spark, monkeypatch):
    from tessella.operators import products

    monkeypatch.setattr(products, "BLOCK", 100)
    monkeypatch.setattr(products, "HELD", 50)
    dice = random.Random(6)
    rows = [(f"d{i:03}", sorted({f"r{dice.randrange(40)}" for _ in range(dice.randrange(0, 5))} | {f"h{dice.randrange(3)}"} - {"h2"}), dice.choice([None, "p", "q"])) for i in range(120)]
    rows += [(f"e{i:03}", ["h0", "r1"], "p") for i in range(30)]  # copies
    docs = spark.createDataFrame(rows, "id string, ngram array<string>, plaintiff string")
    one = docs.select("id", F.explode("ngram").alias("feature"))
    v = one.join(one.groupBy("feature").agg(F.count("*").alias("df")), "feature").select("id", "feature", features.idf(F.lit(150), F.col("df")).alias("weight")).cache()
    for asked in (docs.select("id"), docs.select("id", "plaintiff")):
        want = [tuple(r) for r in sim.candidates(asked, v, 4, tiers=()).select("a", "b", F.round("score", 6), F.round("dot", 6), "rank").collect()]
        assert sorted(tuple(r) for r in sim.candidates(asked, v, 4).select("a", "b", F.round("score", 6), F.round("dot", 6), "rank").collect()) == sorted(want)
        some = sim.candidates(asked, v, 4, asked=docs.filter("id like '%0'")).collect()
        assert {(r.a, r.b) for r in some} == {(a, b) for a, b, *_ in want if a.endswith("0")}
    for least in (0.175, 0.6):
        links, first = {}, {}
        for r in sim.cosine_pairs(v, least).collect():
            for a in (r.a, r.b):
                links[a] = links.get(a, 0) + 1
        for i, f, _ in rows:
            first.setdefault(tuple(f) or i, i)
        assert {r.id: (r["class"], r.links) for r in sim.cosine_links(docs, v, least).collect()} == {i: (first[tuple(f) or i], links.get(i, 0)) for i, f, _ in rows}


def test_assign_takes_the_first_of_an_id(spark):
    docs = stored(spark).withColumn("n", F.lit(2))
    twice = docs.unionByName(docs.withColumn("n", F.lit(1)).withColumn("clusterid", F.lit("first"))).unionByName(docs.withColumn("n", F.lit(3)))
    v = docs.select("id", F.explode("ngram").alias("feature"), F.lit(2.0).alias("weight"))
    got = {r.id: (r.n, r.clusterid, r.clustered) for r in clustering.assign(twice, v, ("n",)).collect()}
    assert got == {str(i): (1, "first", True) for i in range(1, 6)}


def test_handlers(spark):
    c = handlers.Collection(stored(spark))
    ask = lambda name, *a: handlers.handler(c, name)(*a)
    everything = search.Request()
    assert len(handlers.HANDLERS) == 17 and ask("/getids").count() == 5 and ask("/unclustered").count() == 5 and ask("/totalcount").first().n == 5
    assert ask("/ngramcount").first().value == "red fox" and ask("/feeds", everything).first().n == 5 and ask("/searchclusters", everything).count() == 5
    assert ask("/fetchsimilardocs").count() > 0 and ask("/entities", everything).count() == 0 and ask("/terms", "x").count() == 0
    assert ask("/searchclustered", everything)["results"].count() == 5 and ask("/searchunclustered", search.Request("red"))["results"].count() == 2
    found, terms = ask("/mlt", "1")
    assert [r.id for r in found.collect()] == ["2"] and terms.count() == 2
    assert ask("/searchcarrotclustered", search.Request("red")).count() >= 1
    assert handlers.ping(c) and not handlers.ping(handlers.Collection(stored(spark).limit(0))) and not handlers.ping(handlers.Collection(stored(spark).drop("title")))


def test_groups_by_size(spark):
    rows = [("A", "1", 9), ("B", "2", 8), ("C", "3", 7), ("A", "4", 1), ("A", "5", 1), ("B", "6", 1), ("C", "7", 1), ("C", "8", 1)]
    df = spark.createDataFrame(rows, "c string, id string, score int")
    got = facets.by_size(facets.group_by_cluster(df, "c"))
    assert [r.c for r in got.collect()] == ["C", "A", "B"]


def test_canopy_and_kmeans(spark):
    points = [(i, [1.0, 0.01 * i]) for i in range(5)] + [(10 + i, [0.01 * i, 1.0]) for i in range(5)] + [(99, None)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    assert len({r.canopy for r in clustering.canopy(df, 0.5, 0.3).collect()}) == 2
    with pytest.raises(ValueError):
        clustering.canopy(df, 0.3, 0.5)
    fine = df.filter("embedding is not null")
    for method in ("canopy+kmeans", "canopy", "kmeans"):
        got = clustering.batch_clusters(fine, method, **({"k": 2} if method == "kmeans" else {}))
        parts = {}
        for r in got.collect():
            parts.setdefault(r.cluster, set()).add(int(r.id))
        assert sorted(map(sorted, parts.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]], method
    v = spark.createDataFrame([(str(i), f"f{i % 3}", 4.0) for i in range(9)], "id string, feature string, weight double")
    assert clustering.literal_centres(v, 4).groupBy("feature").agg(F.countDistinct("weight").alias("n")).filter("n > 1").count() == 0
    assert clustering.default_k(50) == 100 and clustering.default_k(50_000) == 500


def test_canopies_hold_all_points(spark):
    # far more points than a sample, each near few others
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 40)))], "vec_id long, embedding array<double>")
    got = clustering.canopy(df, 0.75, 0.7, most=50)
    assert got.select("vec_id").distinct().count() == 600


def test_clusters_of_a_page_of_results(spark):
    from tessella.functions import text

    rows = [(f"r{i}", "red fox runs") for i in range(10)] + [("b1", "blue cat"), ("b2", "blue cat sleeps"), ("b3", "lone")]
    page = spark.createDataFrame(rows, "id string, title string")
    found = clustering.phrase_clusters(page, text.words("title"))
    got = [(r.label.split(" ")[0], r.docs, r.score) for r in found.orderBy(F.desc("score")).collect()]
    # phrases of three, two and one words in ten documents each; then of two and one in two, one of them in both
    assert got[0][1] == sorted(f"r{i}" for i in range(10)) and got[0][2] == 10 * (3 + 2 + 2 + 0.5 * 3)
    assert got[1][1] == ["b1", "b2"] and got[1][2] == 2 * (2 + 0.5 * 2)
    shown = {r.label: [d.id for d in r.docs] for r in clustering.result_clusters(page, found).collect()}
    assert sorted(map(len, shown.values())) == [2, 8] and all(x == sorted(x) for x in shown.values())


def test_canopies_by_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = []
    for i in range(len(x)):
        if all(1 - unit[i] @ unit[c] >= 0.4 for c in centres):
            centres.append(i)
    want = {(i, c) for i in range(len(x)) for c in centres if 1 - unit[i] @ unit[c] < 0.6}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.canopy) for r in clustering.canopy(df.repartition(7), 0.6, 0.4).collect()} == want


def test_dense_kmeans_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(60, 5)) + 4 * rng.normal(size=5) for _ in range(4)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    starts = df.filter("vec_id in (0, 1, 70, 130, 200)").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("vector"))
    centres = {c: x[c] for c in (0, 1, 70, 130, 200)}
    for _ in range(6):
        far = np.array([[1 - v @ c / np.linalg.norm(v) / np.linalg.norm(c) for c in centres.values()] for v in x])
        label = np.array(list(centres))[far.round(12).argmin(1)]
        centres = {c: x[label == c].mean(0) for c in sorted(set(label.tolist()))}
    got = {r.vec_id: r.cluster for r in clustering.dense_kmeans(df, starts, rounds=6).collect()}
    assert got == dict(enumerate(label.tolist()))
    monkeypatch.setattr(clustering, "CENTRES", 0)
    assert {r.vec_id: r.cluster for r in clustering.dense_kmeans(df, starts, rounds=6).collect()} == got


def test_stream_counts_open_windows_and_late_rows(spark, tmp_path):
    rows = [("2020-01-01 00:10:00", 1), ("2020-01-01 05:00:00", 1), ("2020-01-01 05:10:00", 1), ("2020-01-01 00:20:00", 1), ("2020-01-01 04:50:00", 1), ("2020-01-01 06:00:00", 2)]
    for i, r in enumerate(rows):  # a file a batch; the fourth is too late for its window, the fifth is not
        spark.createDataFrame([r], "ts string, k int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    frame = stream.read_items(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files=1)
    got = stream.latest(stream.windowed(frame, "ts", ["k"], "1 hour", "1 hour"), ["start", "k"])
    assert sorted((str(r.start), r.k, r.n) for r in got.collect()) == [("2020-01-01 00:00:00", 1, 1), ("2020-01-01 04:00:00", 1, 1), ("2020-01-01 05:00:00", 1, 2), ("2020-01-01 06:00:00", 2, 1)]


def test_stream_upserts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (1, "2020-01-01 00:00:01"), (2, "2020-01-01 00:00:02")], "id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    items = stream.once(stream.read_items(spark, str(tmp_path / "in"), rows.schema), "id", "ts")
    stream.run_available(items, str(tmp_path / "state"), lambda df, n: seen.extend(r.id for r in df.collect()))
    assert sorted(seen) == [1, 2]


def test_without_the_subpackage():
    import pathlib

    root = pathlib.Path(registry.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_dense_kmeans_is_the_same_however_many_centres_fit(spark, monkeypatch):
    import random

    random.seed(9)
    vector = lambda: [random.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, vector()) for i in range(120)] + [(500, [0.0] * 4), (501, [-1.0, -1.0, -1.0, -1.0]), (502, [1e-3, 0.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centres = spark.createDataFrame([(3, [2.0, 2.0, 2.0, 2.0]), (1, [1.0, 0.5, 1.0, 0.5]), (7, [0.1, 0.0, 0.1, 0.0]), (9, [0.1, 0.0, 0.1, 0.0])], "cluster int, vector array<double>")
    found = lambda n: sorted((r.vec_id, r.cluster) for r in clustering.dense_kmeans(points, centres, rounds=n).collect())
    want = [found(n) for n in (1, 3)]
    monkeypatch.setattr(clustering, "CENTRES", 0)
    assert [found(n) for n in (1, 3)] == want and dict(want[0])[500] == 1


def test_tokens_are_counted_before_patterns(spark):
    from tessella.operators import names, sentences, terms

    docs = spark.createDataFrame([(1, "Dr. No met Dr. No. He left!"), (2, None), (3, "")], "id long, text string")
    for counts in (sentences.token_counts(docs), names.case_counts(docs)):
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert re.match(r"Aggregate \[[ax]#", plan[plan.rindex("Aggregate ") :])  # the lowest one is by tokens as they are written
    counted = {(r.type, r.mark, r.next): r.n for r in sentences.token_counts(docs).collect()}
    assert counted["dr", ".", "no"] == 2 and counted["no", ".", "he"] == 1 and counted["left", "!", None] == 1 and counted["no", "", None] == 1
    table = terms.build(docs.selectExpr("id", "split(lower(text), ' ') w"), pairs=False)
    assert table.terms().count() == 7 and not os.path.exists(f"{table.path}/pairs")  # "" of the empty text is one


def test_frequent_and_rare_features(spark, monkeypatch):
    from tessella.operators.store import write_table

    docs = spark.createDataFrame([(str(i), ["all", f"own{i}", f"pair{i // 2}"]) for i in range(40)], "id string, w array<string>")
    want = {(r.id, r.term, r.tf, r.df) for r in features.term_vectors(docs, "w").collect()}
    assert len(want) == 120 and {(t, d) for _, t, _, d in want if t == "all"} == {("all", 40)}
    rows = write_table(docs.select("id", F.explode("w").alias("feature")), "rows")
    df = write_table(rows.groupBy("feature").agg(F.count("*").alias("df")), "df")
    for most in (2, 10, 1000):  # all but the most frequent ones meet in a shuffle; some; none
        monkeypatch.setattr(features, "MOST_SENT", most)
        assert {(r.id, r.feature, 1, r.df) for r in features.with_frequency(rows, df).collect()} == want


def _exported_by_hand(rows, most_df=0.5):
    docs = {}
    for key, words in rows:
        docs.setdefault(key, []).extend(w for w in words or [] if w is not None)
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = {}
    for key, words in docs.items():
        w = {x: math.sqrt(words.count(x)) * (math.log(len(rows) / (df[x] + 1)) + 1) for x in set(words) if df[x] <= most_df * len(rows)}
        length = math.sqrt(sum(x * x for x in w.values()))
        out |= {(key, x): round(y / length, 8) for x, y in w.items()}
    return out


@pytest.mark.parametrize("sent", [400_000, 40, 1])
def test_export_vectors_by_hand(spark, monkeypatch, sent):
    monkeypatch.setattr(features, "MOST_SENT", sent)
    rng = random.Random(5)
    rows = [(str(i), ["all", *(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(1, 60)))]) for i in range(200)]
    rows += [("7", ["again", "w1", "all"]), (None, ["w2", "w2", None, "é"]), ("none", None), ("empty", []), ("nulls", [None, None])]
    docs = spark.createDataFrame(rows, "id string, w array<string>").repartition(5)
    got = {(r.id, r.feature): round(r.weight, 8) for r in features.export_vectors(docs, "w").collect()}
    want = _exported_by_hand(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-8 for k in want)
    assert features.export_vectors(docs.limit(0), "w").count() == 0
    with pytest.raises(ValueError, match="no features left"):
        features.export_vectors(docs.withColumn("w", F.array(F.lit("all"))), "w")


def test_export_vectors_shuffles_documents_not_their_features(spark, tmp_path):
    docs = spark.range(0, 2000, 1, 4).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: ((F.col("id") * 7 + i * i) % 700).cast("string")).alias("w"))
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = {s.stageId(): s.shuffleWriteRecords() for s in _stages(spark, store)}
    vectors = features.export_vectors(docs, "w")
    vectors.write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    moved = sum(s.shuffleWriteRecords() for s in _stages(spark, store) if s.stageId() not in seen)
    assert n > 60 * 2000 and moved < n / 4  # every row was shuffled three times before


def _stages(spark, store):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    empty = spark.sparkContext._jvm.java.util.ArrayList()
    found = store.stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty)
    return [found.apply(i) for i in range(found.size())]
