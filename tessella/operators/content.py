"""Main text of pages: a tree of blocks for each page, scored by text and links, with scores carried to parents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import write_table

#: Elements that hold other blocks, and such as hold a piece of text; all others are part of a line.
HOLDERS = frozenset("html body main article section div td th table ul ol dl blockquote pre nav header footer aside form fieldset figure details".split())
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption figcaption summary br hr option title".split())
#: Elements whose text is no text of the page.
HIDDEN = frozenset("script style noscript template title".split())
#: Names in class and id by which a block is not, or is, part of an article; and elements that never are.
UNLIKELY = r"(^|[\s_-])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|menu|nav\w*|pager|popup|promo\w*|related|share|sidebar|social|sponsor\w*|widget)($|[\s_-])"
LIKELY = r"(^|[\s_-])(article|body|content|entry|main|page|post|story|text)($|[\s_-])"
BARRED = ("nav", "footer", "aside", "form")
#: What an element is worth by its name before its text counts.
WORTH = {"article": 15.0, "main": 10.0, "section": 5.0, "div": 5.0, "td": 3.0, "pre": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "header": -3.0, "th": -5.0}
#: A neighbour of the best element belongs to it from this score and this share of the best one's on.
NEAR, SHARE = 10.0, 0.2


class _Tree(HTMLParser):
    """A page as rows: its holders, numbered in order, with the last number inside each, and its pieces of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = [{"node": 0, "above": None, "last": 0, "tag": "html", "names": ""}]
        self.blocks: list[dict] = []
        self.open, self.count = [("html", 0)], Counter()
        self.parts: list[str] = []
        self.hidden = self.links = self.linked = 0

    def flush(self):
        words = " ".join("".join(self.parts).split())
        if words:
            node = self.open[-1][1]
            self.blocks.append({"node": node, "above": self.nodes[node]["above"], "seq": len(self.blocks), "text": words, "linked": min(self.linked, len(words))})
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.links += tag == "a"
        if tag in HOLDERS or tag in PIECES:
            self.flush()
        if tag in HOLDERS:
            node = len(self.nodes)
            names = " ".join(v.lower() for k, v in attrs if k in ("class", "id") and v)
            self.nodes.append({"node": node, "above": self.open[-1][1], "last": node, "tag": tag, "names": names})
            self.open.append((tag, node))
            self.count[tag] += 1

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN and self.hidden > 0
        self.links -= tag == "a" and self.links > 0
        if tag in HOLDERS or tag in PIECES:
            self.flush()
        while self.count[tag]:
            name, node = self.open.pop()
            self.count[name] -= 1
            self.nodes[node]["last"] = len(self.nodes) - 1
            if name == tag:
                break

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            self.linked += len(data.strip()) if self.links else 0

    def done(self) -> list[dict]:
        self.flush()
        for _, node in self.open:
            self.nodes[node]["last"] = len(self.nodes) - 1
        return [*self.nodes, *self.blocks]


_TYPES = pa.schema([
    ("node", pa.int32()), ("above", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("names", pa.string()), ("seq", pa.int32()), ("text", pa.string()), ("linked", pa.int32()),
])


def block_rows(html: str | None) -> list[dict]:
    """The rows of a page; what cannot be parsed is one piece of text, as it is."""
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except Exception:  # noqa: BLE001  as broken as markup can be
        tree = _Tree()
        tree.parts = [html or ""]
    return tree.done()


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Each page's tree in long form, under `page`, a number of its row, and the key: a row for each holder (node, above, last,
    tag, names) and one for each piece of text (node, above, seq, text, linked: characters within links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column("html").to_pylist()):
                rows = pa.RecordBatch.from_pylist(block_rows(x), schema=_TYPES)
                own = [pa.repeat(batch.column(c)[i], len(rows)) for c in ("page", "key")]
                yield pa.RecordBatch.from_arrays([*own, *rows.columns], names=["page", "key", *_TYPES.names])

    rows = pages.select(F.monotonically_increasing_id().alias("page"), F.col(key).alias("key"), F.col(html).alias("html"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"page long, key {kind}, node int, above int, last int, tag string, names string, seq int, text string, linked int")


def worth(tag: Column, names: Column) -> Column:
    """What a holder is worth by its element and its names."""
    by_tag = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WORTH.items() for x in kv]), tag), F.lit(0.0))
    return by_tag + F.when(names.rlike(UNLIKELY), -25.0).otherwise(0.0) + F.when(names.rlike(LIKELY), 25.0).otherwise(0.0)


def barred(tag: Column, names: Column) -> Column:
    return tag.isin(*BARRED) | (names.rlike(UNLIKELY) & ~names.rlike(LIKELY) & ~tag.isin("html", "body", "article", "main"))


def scored(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page, node, above, last, score) of the holders of text outside barred ones, and these pieces of text.

    A piece is worth 1, 1 for each comma and 1 for each hundred characters up to three, to its holder, and half of
    that to the holder above. A holder's sum and worth shrink by the share of its characters that are in links.
    """
    nodes = tree.filter("seq is null")
    ranges = nodes.filter(barred(F.col("tag"), F.col("names"))).select("page", F.col("node").alias("lo"), F.col("last").alias("hi"))
    text = tree.filter("seq is not null").select("page", "node", "above", "seq", "text", "linked")
    # a barred holder's last number covers all within it; the ranges of a page nest, so the widest so far decides
    marks = text.select("page", F.col("node").alias("at"), "above", "seq", "text", "linked", F.lit(None).cast("int").alias("hi"))
    marks = marks.unionByName(ranges.select("page", F.col("lo").alias("at"), "hi"), allowMissingColumns=True)
    within = F.max("hi").over(Window.partitionBy("page").orderBy("at", F.col("seq").isNotNull(), "seq"))
    free = marks.withColumn("until", within).filter(F.col("seq").isNotNull() & (F.col("until").isNull() | (F.col("until") < F.col("at"))))
    free = free.select("page", F.col("at").alias("node"), "above", "seq", "text", "linked")
    value = F.lit(1.0) + F.regexp_count("text", F.lit(",")) + F.least(F.length("text") / 100, F.lit(3.0))
    shares = F.array(F.struct(F.col("node").alias("of"), value.alias("value")), F.struct(F.col("above").alias("of"), (value / 2).alias("value")))
    each = free.select("page", F.length("text").alias("chars"), "linked", F.explode(shares).alias("s")).filter("s.of is not null")
    sums = each.groupBy("page", F.col("s.of").alias("node")).agg(F.sum("s.value").alias("value"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    whole = sums.join(nodes.select("page", "node", "above", "last", worth(F.col("tag"), F.col("names")).alias("worth")), ["page", "node"])
    score = (F.col("value") + F.col("worth")) * (1 - F.col("linked") / F.col("chars"))
    return whole.select("page", "node", "above", "last", F.round(score, 6).alias("score")), free


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", url: str | None = "url") -> DataFrame:
    """(key, text) of every row: the pieces of text of the page's main content in order, a line each.

    That is the holder of the highest score (the outermost of equals), with those neighbours of it that score at least NEAR
    and SHARE of it. Menus, footers, asides, forms and blocks by an unlikely name are left out before. A page without
    a scored holder, an empty or null one, and a PDF by its url give the empty text. Repeated rows are rows of their own.
    Each page is parsed once, into a written table; the rest is joins and windows by page.
    """
    if url:
        pages = pages.withColumn(html, F.when(F.lower(url).endswith(".pdf"), F.lit("")).otherwise(F.col(html)))
    tree = write_table(blocks(pages, key, html), "blocks")
    holders, free = scored(tree)
    holders = write_table(holders, "holders")
    top = holders.groupBy("page").agg(F.max(F.struct("score", (-F.col("node")).alias("first"), "above", "last")).alias("top"))
    near = (F.col("above") == F.col("top.above")) & (F.col("score") >= F.greatest(F.lit(NEAR), F.col("top.score") * SHARE))
    taken = holders.join(top, "page").filter((F.col("node") == -F.col("top.first")) | near).select("page", F.col("node").alias("lo"), F.col("last").alias("hi"))
    # the ranges taken lie beside each other: the last that begins before a piece is the one it can be in
    rows = free.select("page", F.col("node").alias("at"), "seq", "text").unionByName(taken.select("page", F.col("lo").alias("at"), "hi"), allowMissingColumns=True)
    until = F.last("hi", True).over(Window.partitionBy("page").orderBy("at", F.col("seq").isNotNull(), "seq"))
    inside = rows.withColumn("until", until).filter("seq is not null and at <= until")
    lines = inside.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("lines"))
    every = tree.filter("node = 0 and seq is null").select("page", "key")
    out = every.join(lines, "page", "left").withColumn("text", F.coalesce(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), F.lit("")))
    return out.select(F.col("key").alias(key), "text")
