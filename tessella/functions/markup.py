"""Text of HTML by the standard library's parser, as an Arrow UDF."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import PIECE, small_batches


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    """All text nodes, one after another, entities decoded; scripts, styles and comments are no text. What cannot be
    parsed comes back as it is."""
    if html is None:
        return None
    parser = _Text()
    try:
        parser.feed(html)
        parser.close()
    except Exception:  # noqa: BLE001  as broken as markup can be
        return html
    return "".join(parser.parts)


def page_text(url, html):
    """Text of a page that was fetched elsewhere; a PDF's or a missing page's is empty."""
    return F.when(F.lower(url).endswith(".pdf"), F.lit("")).otherwise(F.coalesce(strip_html(html), F.lit("")))


def html_texts(html: pa.Array) -> pa.Array:
    """The texts of a batch's markup. No more than about PIECE bytes of it, or one page, are Python's at a time; else a batch of
    ten thousand pages would be there several times over in each worker."""
    ends = np.cumsum(pc.binary_length(html).fill_null(0).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(html)]
    texts = [pa.array([html_text(x) for x in html.slice(lo, hi - lo).to_pylist()], html.type) for lo, hi in zip(cuts, cuts[1:])]
    return pa.concat_arrays(texts)


@F.arrow_udf(T.StringType())
def _strip_html(html: pa.Array) -> pa.Array:
    return html_texts(html)


def strip_html(html: Column | str) -> Column:
    """The text of markup. Spark's batches become small ones where it sends larger ones."""
    if spark := SparkSession.getActiveSession():
        small_batches(spark)
    return _strip_html(html)
