"""Feed items, article tables and documents in other formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schema import RAW_ITEMS


def read_rss(spark: SparkSession, path: str, feed: str, tag: str = "item") -> DataFrame:
    """Items of RSS files (tag "entry" for Atom) that were fetched elsewhere. seq rises in the order of the files' paths,
    and within a file in that of its items."""
    fields = ", ".join(f"{f.name} STRING" for f in RAW_ITEMS if f.name not in ("feed", "seq", "published")) + ", pubDate STRING, published STRING"
    items = spark.read.format("xml").option("rowTag", tag).schema(fields).load(path)
    # a block of a file lies in one partition, where numbers rise
    block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    rows = items.select("*", block.alias("__block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__n"))
    place = F.row_number().over(Window.partitionBy().orderBy("__block"))  # a row for each block of a file
    blocks = rows.select("__block").distinct().withColumn("__place", place)
    rows = rows.join(blocks, "__block").withColumn("seq", F.col("__place").cast("long") * (1 << 33) + F.col("__n"))
    rows = rows.withColumn("feed", F.lit(feed)).withColumn("published", F.coalesce("published", "pubDate"))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in RAW_ITEMS])


def read_documents(spark: SparkSession, path: str, kind: str, schema: str, **options) -> DataFrame:
    """Documents in bulk as parquet, json, csv, xml or orc, with a given schema."""
    if kind not in ("parquet", "json", "csv", "xml", "orc"):
        raise ValueError(f"unknown kind {kind}")
    return spark.read.format(kind).schema(schema).options(**options).load(path)


def extract_rich(files: DataFrame, prefix: str = "ignored_", known: tuple = ("path", "content")) -> DataFrame:
    """Binary files as documents: content as text, lower-case names, unknown fields prefixed."""
    named = [(F.col(c).cast("string").alias("text") if c == "content" else F.col(c).alias(c.lower() if c in known else prefix + c.lower())) for c in files.columns]
    return files.select(*named)


def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as articles: the first sentence is the title, source the feed, lang the category."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title = F.regexp_extract("text", r"^[ \n]*([^.!?\n]*)", 1)
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), title.alias("title"), F.col("text").alias("body"), F.col("source").alias("feed"), text.slug("source").alias("feedkey"),
        F.col("lang").alias("category"), text.slug("lang").alias("categorykey"), "n_chars",
    )


def read_cluster_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_cluster_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_cluster_lines(lines: DataFrame, prefix: str = "mahout") -> DataFrame:
    """(id, cluster) of lines "cluster,doc,doc,...". Line ends are stripped; empty fields are no documents."""
    part = F.split(F.rtrim(F.regexp_replace("line", r"[\r\n]+$", "")), ",")
    rows = lines.select(F.concat(F.lit(prefix), F.trim(part[0])).alias("cluster"), F.explode(F.slice(part, 2, 1 << 30)).alias("id"))
    return rows.filter("id <> ''").select("id", "cluster")


def write_cluster_lines(assigned: DataFrame, path: str, most: int = 10_000) -> None:
    """Members of each cluster as lines of about `most` at most, which read_cluster_lines() puts together again; so a
    cluster of any size is dealt over tasks."""
    parts = assigned.groupBy("cluster").agg(F.ceil(F.count("*") / most).alias("__parts"))
    part = F.pmod(F.xxhash64("id"), F.col("__parts")).alias("__part")
    lines = assigned.join(parts, "cluster").groupBy("cluster", part).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lines.select(F.concat_ws(",", "cluster", "ids").alias("value")).write.text(path)


def xml_text(c: Column) -> Column:
    """A value as text of XML or HTML: characters that XML cannot hold are left out, others stand for themselves."""
    out = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def _element(name: str, c: Column) -> Column:
    """An element with a text; none for a null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), xml_text(c), F.lit(f"</{name}>")), F.lit(""))


def result_feed(docs: DataFrame, kind: str = "rss") -> DataFrame:
    """(id, xml) of each document, as an RSS item, an Atom entry, or (html) a table of all its fields; date is its
    timestamp."""
    link = F.concat(F.lit("?q=id:"), F.col("id"))
    when = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'") if "date" in docs.columns else F.lit(None).cast("string")
    if kind == "rss":
        parts = [F.lit("<item>"), _element("title", F.col("title")), _element("link", link), _element("description", F.col("summary")), _element("pubDate", when), _element("guid", link), F.lit("</item>")]
    elif kind == "atom":
        href = F.concat(F.lit('<link href="'), xml_text(link), F.lit('"/>'))
        parts = [F.lit("<entry>"), _element("title", F.col("title")), href, _element("id", F.concat(F.lit("tag:"), F.col("id"))), _element("summary", F.col("summary")), _element("updated", when), F.lit("</entry>")]
    elif kind == "html":
        row = lambda name, value: F.coalesce(F.concat(F.lit(f"<tr><td>{name}</td><td>"), value, F.lit("</td></tr>")), F.lit(""))
        listed = lambda c: F.concat(F.lit("<ul>"), F.array_join(F.transform(c, lambda x: _element("li", x)), ""), F.lit("</ul>"))
        parts = [F.lit("<table>"), *[row(f.name, listed(F.col(f.name)) if isinstance(f.dataType, T.ArrayType) else xml_text(F.col(f.name))) for f in docs.schema.fields], F.lit("</table>")]
    else:
        raise ValueError(f"unknown kind {kind}")
    return docs.select("id", F.concat(*parts).alias("xml"))


def result_page(docs: DataFrame, kind: str, order: str, title: str = "Results", link: str = "") -> DataFrame:
    """(xml), one row: the whole RSS channel, Atom feed or HTML page of a page of results, in their order. An Atom feed was
    updated when its first document was; a page of HTML says how many documents there are."""
    items = docs.select(order, "id", *(["date"] if "date" in docs.columns else [])).join(result_feed(docs, kind), "id")
    first = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'") if "date" in docs.columns else F.lit(None).cast("string")
    rows = items.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("place"), F.col("id"), first.alias("updated"), "xml"))).alias("x"))
    body, name, at = F.array_join(F.transform("x", lambda x: x["xml"]), ""), F.lit(title), F.lit(link)
    if kind == "rss":
        parts = [F.lit('<rss version="2.0"><channel>'), _element("title", name), _element("link", at), _element("description", name), _element("language", F.lit("en-us")), body, F.lit("</channel></rss>")]
    elif kind == "atom":
        updated = F.try_element_at("x", F.lit(1))["updated"]
        parts = [F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), _element("title", name), F.concat(F.lit('<link rel="self" href="'), xml_text(at), F.lit('"/>')), _element("updated", updated), _element("id", F.concat(F.lit("tag:"), name)), body, F.lit("</feed>")]
    else:
        said = F.concat(name, F.lit(" ("), F.size("x").cast("string"), F.lit(" documents)"))
        parts = [F.lit("<html><head>"), _element("title", said), F.lit("</head><body>"), _element("h1", said), body, F.lit("</body></html>")]
    return rows.select(F.concat(*parts).alias("xml"))


def write_results(df: DataFrame, path: str, kind: str) -> None:
    """Results as xml, json, csv or parquet files."""
    writer = df.write.format(kind)
    (writer.option("rowTag", "doc") if kind == "xml" else writer.option("header", True) if kind == "csv" else writer).save(path)


def first_present(*names: str) -> Column:
    """The first attribute that is present; present but empty wins."""
    return F.coalesce(*[F.col(n) for n in names])
