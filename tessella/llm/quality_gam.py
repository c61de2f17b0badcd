"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles by shallow trees.

Every feature is cut into quantile bins. Round by round each feature in turn gets a tree of a few leaves fitted to the
gradient's histogram over its bins, and the leaves are added to that feature's lookup table; so no feature hides
another. Then the pairs of features whose best two-way cut lowers the loss most get two-dimensional tables in the same
way. A score is a sum of table entries: one bin lookup and one addition for each feature and pair, over whole batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import carried, fields, pieces, small_batches, text_bytes
from ._labels import MOST_LABELLED, held_out, labelled

#: What a text is measured by; nothing but the text goes in.
FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "pipe", "stop", "mark", "space",
    "beyond_ascii", "control", "words_repeated_next", "top_word", "distinct_words", "lines_repeated", "mean_line", "short_words",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack(
    [
        _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"#$%&*+/<=>@[\\]^_`{}~"), _class(b"|"), _class(b".,;:"), _class(b"!?"),
        _class(b" \t\n\r"), _class(bytes(range(128, 256))), _class(bytes(x for x in range(32) if x not in (9, 10, 13)) + b"\x7f"),
    ],
    axis=1,
)


def measure(text: bytes) -> list[float]:
    """The features of one text; an empty text's are zeros."""
    size = len(text)
    if not size:
        return [0.0] * len(FEATURES)
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES) / size
    words = text.lower().split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = [len(w) for w in counts]
    return [
        np.log1p(size), np.log1p(len(words)), (size - shares[6] * size) / n, np.log1p(max(lengths, default=0)), *shares,
        sum(map(eq, words, words[1:])) / n, max(counts.values(), default=0) / n, len(counts) / n ** 0.8,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(size / max(1, len(lines))), sum(c for w, c in counts.items() if len(w) <= 2) / n,
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([measure(x) for x in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Gam:
    """Bin edges, an intercept, a table for each feature, and tables for pairs of features."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def margin(self, b: np.ndarray) -> np.ndarray:
        total = np.full(len(b), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for j, k, table in self.pairs:
            total += table[b[:, j], b[:, k]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _leaf(g: float | np.ndarray, h: float | np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree of at most so many leaves, grown best split first on histograms of gradients."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    best_of = {}
    while True:
        for lo, hi in parts:
            if (lo, hi) not in best_of:
                gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
                gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge) if hi - lo > 1 else np.zeros(0)
                k = int(gain.argmax()) if len(gain) else 0
                best_of[lo, hi] = (float(gain[k]) if len(gain) else 0.0, lo + k + 1)
        part = max(parts, key=lambda p: best_of[p][0])
        if len(parts) >= leaves or best_of[part][0] <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], best_of[part][1]), (best_of[part][1], part[1])]
    for lo, hi in parts:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum(), ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-dimensional histogram into four blocks: its gain and the blocks' values by bins."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    blocks = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gs, hs = blocks(G), blocks(H)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs)) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    value = [float(_leaf(a[i, j], b[i, j], ridge)) for a, b in zip(gs, hs)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, leaves: int = 3, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 2.0) -> Gam:
    """Fit by Newton boosting on the logistic loss. Without rows the score is 0.5 for all, with one class its share."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(x):
        return Gam([np.zeros(0)] * width, 0.0, [np.zeros(1)] * width)
    model = Gam([np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)])
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(share / (1 - share)))
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    b = model.bins(x)
    margin = model.margin(b)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, sizes[j]), np.bincount(b[:, j], h, sizes[j]), leaves, ridge)
            model.tables[j] += step
            margin += step[b[:, j]]
    flat = lambda j, k, v: np.bincount(b[:, j] * sizes[k] + b[:, k], v, sizes[j] * sizes[k]).reshape(sizes[j], sizes[k])
    g, h = slopes()
    gains = sorted(((_quarters(flat(j, k, g), flat(j, k, h), ridge)[0], j, k) for j in range(width) for k in range(j)), reverse=True)[:pairs]
    model.pairs = [(j, k, np.zeros((sizes[j], sizes[k]))) for _, j, k in gains]
    for _ in range(pair_rounds):
        for j, k, table in model.pairs:
            g, h = slopes()
            step = rate * _quarters(flat(j, k, g), flat(j, k, h), ridge)[1]
            table += step
            margin += step[b[:, j], b[:, k]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, remainder: int = 0, most: int = MOST_LABELLED) -> Gam:
    """Fit on at most `most` labelled documents outside the held-out fold; executors measure them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = matrix(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    rows = labelled(docs, labels, label, parts, remainder, most).mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(len(rows), len(FEATURES))
    y = np.array(rows["y"].to_pylist(), np.float64)
    order = np.lexsort((*x.T, y))  # the same model however the rows arrive
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id), each under the name __keepN, and score, between 0 and 1. Null reads as empty."""
    keep = ["doc_id"] if keep is None else keep
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of bins
    df, kept, text = carried(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = shared.value.score(matrix(text_bytes(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], names=[*kept, "score"])

    return df.mapInArrow(run, fields(df, kept, "score double"))


def report(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted. A row for each row of docs, repeated rows, nulls, empty and very long texts
    included, in the ids' own type; labels without a document, null labels and labels other than 0 and 1 are left out of
    the fit. Without labels all scores are 0.5. Other columns play no part, whatever their names."""
    scored = score(docs, train(docs, labels)).withColumnRenamed("__keep0", "doc_id")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`; nulls, empty texts and repeated rows are scored as
    in report()."""
    scored = score(docs, train(docs, labels), docs.columns).filter(F.col("score") >= least)
    return scored.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(docs.columns)])
