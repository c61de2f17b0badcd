"""Golden rows of the text functions."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tessella.functions import markup, stemmer, text
from tessella.plans import frontend
from tessella.plans.querystring import Compiler, QueryError, parse


def one(spark, value, f, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(f(F.col("x")).alias("y")).first().y


def test_slugs(spark):
    assert one(spark, "Café_A-1 b", text.slug) == "CafA1b"
    assert one(spark, " http://a.b/c?x=1&&y:2 ", text.id_slug) == "a.b/c_x=1_y_2"
    assert one(spark, "日本", text.slug) == "" and one(spark, None, text.slug) is None


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Smith v. Jones (10-875) [ORDER]", ("Smith", "Jones")), ("Case: Acme Corp V. Beta LLC", ("Acme Corp", "Beta LLC")), ("(A) v. B (C)", ("(A)", "B (C)")),
        ("A (x) v. B (y)", None), ("A v. B v. C", None), ("A v. B v C", ("A", "B v C")), ("A v B V. C", ("A v B", "C")), ("11-5017 | A v B", ("11-5017 | A", "B")), ("A vs. B", None), ("Case: [ORDER]", None),
    ],
)
def test_parties(spark, title, want):
    got = one(spark, title, text.parties)
    assert (got and tuple(got)) == want


def test_ngrams(spark):
    assert len(one(spark, ["court", "deni", "ibm", "appeal"], lambda c: text.ngrams(c, 2, 4), "x array<string>")) == 6
    assert one(spark, ["one"], lambda c: text.ngrams(c, 2, 4), "x array<string>") == []
    assert one(spark, "The NASA mission", text.short_upper) == ["nasa"]
    assert one(spark, "The NASA and NATO mission", text.short_upper) == [] and one(spark, "the IBM mission", text.short_upper) == []
    assert one(spark, "NASA WINS", text.short_upper) == []
    assert one(spark, ["a"], lambda c: text.with_fallback(c, F.lit("id")), "x array<string>") == ["id"]


def test_words_of_features(spark):
    odd = "The 12 x 3D b2 007 été-1a NASA_ok a1b2c3 9 99x And 1" + "2" * 5000
    assert one(spark, odd, text.feature_words) == ["3d", "b2", "1a", "nasa", "ok", "a1b2c3", "99x"]
    assert one(spark, " a-b ", text.words) == ["a", "b"] and one(spark, "", text.words) == [] and one(spark, None, text.feature_words) is None
    df = spark.createDataFrame([("to be or not",)], "x string")
    plan = df.select(text.with_fallback(text.distinct_ngrams("x"), "x").alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper()  # stop words are looked up, not gone through
    assert plan.count("array_distinct") == 1  # n-grams are made once, not for their number and again for themselves


def test_stems_of_a_batch(spark):
    rows = [(1, ["running", "cats", "cats"]), (2, None), (3, []), (4, ["ponies", "cats"])]
    stem = stemmer.stem_words(frozenset(["running"]))
    df = spark.createDataFrame(rows, "id long, w array<string>").coalesce(1).select("id", stem("w").alias("s"))
    assert {r.id: r.s for r in df.collect()} == {1: ["running", "cat", "cat"], 2: None, 3: [], 4: ["poni", "cat"]}
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString() and stem.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_summary(spark):
    clean = "The court found that the claim was not timely."
    assert one(spark, f"LONDON -- {clean} too short. {clean}", text.clean_summary) == f"{clean} {clean}"
    assert one(spark, "x" * 250, text.clean_summary) == "x" * 200 + "..." and one(spark, "x", text.clean_summary) == "x"
    assert one(spark, "", text.clean_summary) is None and one(spark, None, text.clean_summary) is None
    many = " ".join([clean] * 20)
    assert one(spark, many, text.clean_summary).count(clean) == 400 // len(clean)


def test_folding_and_synonyms(spark):
    assert one(spark, "Æther straße ﬃ Ÿ Łódź naïve", text.fold_ascii) == "AEther strasse ffi Y Łodź naive"
    rules = text.parse_synonyms(["aaa => aab", "b => b bb", "GB,gib", r"a\,a => b\,b", "# no", "pixima => pixma"])
    assert rules["GB"] == ["GB", "gib"] and rules["a,a"] == ["b,b"] and rules["aaa"] == ["aab"]
    assert one(spark, ["GB", "x"], lambda c: text.expand_synonyms(c, rules), "x array<string>") == ["GB", "gib", "x"]


def test_entities(spark):
    assert one(spark, "Smith v. Jones", text.entities) == ["Jones", "Smith"]
    assert one(spark, "the New York court and Acme and Acme", text.entities) == ["New York", "Acme"]
    assert one(spark, "york", lambda c: text.has_affix(c, F.array(F.lit("New York")))) is True
    assert one(spark, "New York", lambda c: text.has_affix(c, F.array(F.lit("new york")))) is False


def test_markup():
    assert markup.html_text("<p>a &amp; b</p><script>var t='</p>'</script><!-- c --><b>d") == "a & bd"
    assert markup.html_text(None) is None and markup.html_text("") == ""


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("conflated", "conflat"),
        ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"), ("hopefulness", "hope"), ("formalize", "formal"),
        ("electrical", "electr"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"), ("is", "is"),
    ],
)
def test_stem(word, want):
    assert stemmer.stem(word) == want


def test_dates(spark):
    date = lambda s: str(one(spark, s, text.feed_date))
    assert date("Tue, 03 Jun 2008 11:05:30 +0200") == "2008-06-03 09:05:30" and date("2008-06-03") == "2008-06-03 00:00:00"
    assert date("2008-06-03T11:05:30Z") == "2008-06-03 11:05:30" and date("soon") == "None"


def test_highlight(spark):
    assert one(spark, "The cat sat", lambda c: text.highlight(c, ["cat"])) == "The <em>cat</em> sat"
    assert one(spark, "concat", lambda c: text.highlight(c, ["cat"])) is None


def test_front_end():
    assert frontend.parse_path("/topic/T/source/S") == {"topic": "T", "source": "S", "category": None}
    assert frontend.parse_path("/topic/T/source")["source"] is None and frontend.parse_path("/category/C/any/S")["source"] == "S"
    assert [b["active"] for b in frontend.breadcrumbs(frontend.parse_path("/topic/T"), "q")] == [False, True]
    assert frontend.parameters({"rows": 5}, {"rows": 10, "q": "*"}, {"fq": "a"}, {"q": "b"}) == {"rows": 5, "q": "b", "fq": ["a"]}
    assert frontend.page(2, 10, 41) == {"start": 10, "rows": 10, "pages": 5}


def test_query_strings(spark):
    rows = [("1", "red fox", "a", ["x"], 5.0), ("2", "red dog", "b", [], 7.0), ("3", None, "a", None, None), ("4", 'say "hi" now', "c", ["y z"], 9.0)]
    df = spark.createDataFrame(rows, "id string, title string, feed string, entity array<string>, price double")
    compiler = Compiler()

    def ids(q):
        node = parse(q)
        return [r.id for r in df.filter(compiler.matches(node)).orderBy("id").collect()]

    assert ids("") == ids("*:*") == ["1", "2", "3", "4"]
    assert ids("red") == ["1", "2"] and ids("red fox") == ["1", "2"] and ids("red AND fox") == ["1"] and ids("+red -fox") == ["2"]
    assert ids('"red fox"') == ["1"] and ids("feed:a OR feed:c") == ["1", "3", "4"] and ids('entity:"y z"') == ["4"]
    assert ids("price:[5 TO 7]") == ["1", "2"] and ids("price:[6 TO *]") == ["2", "4"] and ids("+(red OR say) +feed:a") == ["1"]
    assert ids("NOT red") == ["3", "4"] and ids("red AND (fox OR dog)") == ["1", "2"]
    score = {r.id: r.s for r in df.select("id", compiler.score(parse("red^2 OR fox")).alias("s")).collect()}
    assert score == {"1": 3.0, "2": 2.0, "3": 0.0, "4": 0.0}
    for bad in ("(red", "red)", "AND", "a AND", "()"):
        with pytest.raises(QueryError):
            parse(bad)


def test_pages_are_taken_up_in_pieces(spark):
    pages = ["<p>" + "a&amp;b " * 1200 + "</p>"] * 1500 + [None, "", "<b>" + "c" * (1 << 20), None]
    batch = pa.array(pages)
    tracemalloc.start()
    try:
        got = markup.html_texts(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.slice(1500).to_pylist() == [None, "", "c" * (1 << 20), None] and set(got.slice(0, 1500).to_pylist()) == {"a&b " * 1200}
    assert batch.nbytes > 14 << 20 and peak < 10 << 20  # of markup and texts, only a few MB at a time are strings
    assert markup.html_texts(batch.slice(1499, 2)).to_pylist() == ["a&b " * 1200, None] and len(markup.html_texts(batch.slice(0, 0))) == 0
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    rows = spark.createDataFrame([("<i>x</i>y",), (None,)], "h string").select(markup.strip_html("h").alias("t"))
    assert [r.t for r in rows.collect()] == ["xy", None] and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
