"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters. Each lexicon voter holds one word or word beginning and votes toxic where it occurs; the entries are a short
list of insults and what is far more frequent in toxic than in other documents of the labelled sample. Pattern voters
look at shouting, marks, direct address and at the lack of any entry, and vote either way. A voter may abstain.

Label model. Given the hidden label, voters depend on each other along a tree: each has at most one parent, chosen by
conditional mutual information (Chow and Liu, 1968). Expectation maximisation over the votes on the sample estimates the
share of toxic documents, each voter's accuracy and its correlation with its parent. Labels say where it starts, and so
which of the two hidden classes is the toxic one, and choose the tree; their counts also weigh PULL times the posteriors'
in every round, as an anchor. The posteriors themselves come from the votes alone.

Classifier. A logistic regression over the entries' presence is fitted to the posteriors of all documents of the sample,
so a document is scored by one pass over its words and a sum of weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, fields, pieces, small_batches, text_bytes, write_table
from ._labels import MOST_LABELLED, held_out, labelled

#: Insults that vote whether or not the labelled documents show them.
SEEDS = ("idiot", "moron", "loser", "pathetic", "scum", "worthless", "trash", "clown", "disgusting", "stupid", "imbecile", "dumbass")
#: Lengths in bytes of word beginnings that may become entries.
STEMS = (4, 5, 6)
#: Most entries that are mined, fewest toxic documents of an entry, and the least ratio of its shares.
MOST_ENTRIES, FEWEST, RATIO = 400, 4, 12.0
#: Weight of the labels' counts beside those of the hidden labels' posteriors.
PULL = 1.0
#: Digits and marks that stand for letters in disguised words.
DISGUISE = bytes.maketrans(b"013457@$", b"oieastas")

_LETTERS = LOWER.translate(bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 or b in b"013457@$" else 0x20 for b in range(256)))


def _words(text: bytes) -> set[bytes]:
    words = set(text.translate(_LETTERS).split())
    return words | {w.translate(DISGUISE) for w in words if not w.isalpha()}


def entries(text: bytes) -> set[bytes]:
    """A text's distinct words, lower-cased, with disguises undone beside them, and their beginnings, marked by a star."""
    words = _words(text)
    found = set(words)
    for n in STEMS:
        found |= {w[:n] + b"*" for w in words if len(w) > n}
    return found


@dataclass
class Model:
    """The entries in order, their weights in the classifier, and what the label model estimated."""

    names: list[bytes]
    weights: np.ndarray
    bias: float
    voters: list[str]
    parents: list[int]
    accuracy: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        at = {n: w for n, w in zip(self.names, self.weights.tolist()) if w}
        whole = {n for n in at if not n.endswith(b"*")}
        stems = {n: {x[:-1] for x in at if x.endswith(b"*") and len(x) == n + 1} for n in STEMS}
        margin = []
        for text in texts:
            words = _words(text)
            has = list(words & whole)
            for n, of in stems.items():
                if of:
                    has += [x + b"*" for x in {w[:n] for w in words if len(w) > n} & of]
            margin.append(self.bias + math.fsum(at[x] for x in has))
        return 1 / (1 + np.exp(-np.clip(np.array(margin, np.float64), -30, 30)))


def mine(toxic: Counter, other: Counter, n_toxic: int, n_other: int) -> list[bytes]:
    """Seeds and the entries whose share of toxic documents is RATIO times that of the others, largest ratio first."""
    scored = []
    for name, n in toxic.items():
        if n >= FEWEST:
            ratio = (n / max(1, n_toxic)) / ((other[name] + 0.5) / max(1, n_other))
            if ratio >= RATIO:
                scored.append((-ratio, name))
    mined = [name for _, name in sorted(scored)[:MOST_ENTRIES]]
    return list(dict.fromkeys([*(s.encode() for s in SEEDS), *mined]))


def votes(text: bytes, names: list[bytes]) -> list[int]:
    """Votes of all voters on a text: 1 toxic, -1 not, 0 abstains. Lexicon voters first, then the patterns."""
    has = entries(text)
    lexicon = [1 if n in has else 0 for n in names]
    hits, size = sum(lexicon), max(1, len(text))
    upper = sum(text.count(bytes([c])) for c in range(65, 91)) / size
    marks = text.count(b"!") + text.count(b"?")
    patterns = [
        -1 if not hits else 0,  # no entry at all
        1 if hits >= 2 else 0,
        1 if upper > 0.4 and hits else -1 if upper < 0.1 else 0,  # shouting
        1 if marks > 3 and hits else -1 if not marks else 0,
        1 if hits and has & {b"you", b"your", b"du", b"tu", b"toi", b"vous", b"usted"} else 0,  # direct address
        -1 if size < 20 else 0,
    ]
    return lexicon + patterns


PATTERNS = ("no_entry", "two_entries", "shouting", "marks", "address", "short")


@dataclass
class LabelModel:
    """share of toxic documents; each voter's parent (-1: none); by label, voter, the parent's vote and its own vote (as
    vote + 1) the probability of its own vote, the same for all votes of the parent if there is none."""

    share: float
    parents: list[int]
    tables: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of toxic for each row of votes (-1, 0, 1)."""
        s = (v + 1).astype(np.int8)
        logs = np.tile(np.log([[1 - self.share], [self.share]]), (1, len(s)))
        for j, k in enumerate(self.parents):
            of = s[:, k] if k >= 0 else np.zeros(len(s), np.int8)
            for y in (0, 1):
                logs[y] += np.log(self.tables[y, j])[of, s[:, j]]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))

    def accuracy(self, v: np.ndarray) -> np.ndarray:
        """Each voter's accuracy where it votes, by the posteriors of the rows of votes."""
        p = self.posterior(v)
        return (p @ (v == 1) + (1 - p) @ (v == -1) + 0.5) / ((v != 0).sum(0) + 1.0)


def label_model(v: np.ndarray, anchor: np.ndarray, pull: float = PULL, rounds: int = 50) -> LabelModel:
    """The model of rows of votes, by expectation maximisation. anchor: starting posteriors of the rows, whose counts
    also weigh `pull` times the rows' own in every round; the posteriors themselves come from the votes alone."""
    n, m = v.shape
    s, p, parents = (v + 1).astype(np.int8), anchor.astype(np.float64), None
    fixed = pull * np.stack([1 - p, p])
    for _ in range(rounds):
        w = np.stack([1 - p, p]) + fixed
        single = np.stack([[np.bincount(s[:, j], w[y], 3) for j in range(m)] for y in (0, 1)]) + 0.1  # label, voter, vote
        single /= single.sum(2, keepdims=True)
        parents = _tree(s, w) if parents is None else parents
        tables = np.repeat(single[:, :, None, :], 3, 2)
        for j, k in enumerate(parents):
            for y in (0, 1) if k >= 0 else ():
                joint = np.bincount(s[:, k] * 3 + s[:, j], w[y], 9).reshape(3, 3) + 0.3 * single[y, j]
                tables[y, j] = joint / joint.sum(1, keepdims=True)
        model = LabelModel(float((w[1].sum() + 1) / (w.sum() + 2)), parents, tables)
        new = model.posterior(v)
        moved, p = np.abs(new - p).max(initial=0), new
        if moved < 1e-6:
            break
    return model


def _tree(s: np.ndarray, w: np.ndarray) -> list[int]:
    """Parents along the spanning tree of largest mutual information given the label; weak links are cut."""
    n, m = s.shape
    info = np.zeros((m, m))
    for y in (0, 1):
        total = w[y].sum() + 1e-9
        weight = w[y].astype(np.float32)
        one = np.stack([weight @ (s == a) for a in range(3)]) / total
        for a in range(3):
            mine = (s == a) * weight[:, None]
            for b in range(3):
                joint = mine.T @ (s == b).astype(np.float32) / total
                info += total / max(1, n) * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(np.outer(one[a], one[b]), 1e-300)), 0)
    np.fill_diagonal(info, -1)
    parents, inside = [-1] * m, [0]
    best, via = info[0].copy(), np.zeros(m, int)
    for _ in range(m - 1):
        best[inside] = -2
        j = int(best.argmax())
        parents[j] = int(via[j]) if best[j] > 1e-3 else -1
        inside.append(j)
        closer = info[j] > best
        best, via = np.where(closer, info[j], best), np.where(closer, j, via)
    return parents


def fit_linear(x: np.ndarray, p: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on 0/1 features by gradient steps with momentum."""
    n, m = x.shape
    w, b = np.zeros(m), -2.0
    dw, db = np.zeros(m), 0.0
    weight = 1 / np.maximum(1.0, np.sqrt(x.sum(0) + 1)) if n else np.ones(m)
    for _ in range(rounds if n else 0):
        err = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -30, 30))) - p
        dw = 0.9 * dw - rate * weight * (x.T @ err.astype(x.dtype) / np.sqrt(n) + decay * w)
        db = 0.9 * db - rate * err.mean()
        w, b = w + dw, b + db
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, remainder: int = 1, most: int = MOST_LABELLED) -> Model:
    """Mine entries from at most `most` labelled documents outside the held-out fold, fit the label model on the votes on
    them, and the classifier on the posteriors. The model does not depend on how rows lie in partitions."""
    small_batches(docs.sparkSession)
    sample = write_table(labelled(docs, labels, label, parts, remainder, most), "labelled")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = (Counter(), Counter()), [0, 0]
        for batch in pieces(batches):
            for text, y in zip(text_bytes(batch.column("text")), batch.column("y").to_pylist()):
                counts[y].update(entries(text))
                rows[y] += 1
        names = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_pydict({"name": [b"", *names], **{n: [rows[y], *(counts[y][x] for x in names)] for y, n in enumerate(("other", "toxic"))}}, pa.schema([("name", pa.binary()), ("other", pa.int64()), ("toxic", pa.int64())]))

    # the empty name holds the numbers of documents
    seen = sample.mapInArrow(tally, "name binary, other long, toxic long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    kept = {bytes(r.name): (r.toxic, r.other) for r in seen.filter((F.col("toxic") >= FEWEST) | (F.length("name") == 0)).toArrow().to_pandas().itertuples()}
    n_toxic, n_other = kept.pop(b"", (0, 0))
    names = mine(Counter({k: t for k, (t, _) in kept.items()}), Counter({k: o for k, (_, o) in kept.items()}), n_toxic, n_other)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [bytes(x + 1 for x in votes(t, shared.value)) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("y")], names=["v", "y"])

    rows = sample.mapInArrow(vote, "v binary, y int").toArrow()
    v = np.frombuffer(b"".join(rows["v"].to_pylist()), np.uint8).reshape(-1, len(names) + len(PATTERNS)).astype(np.int8) - np.int8(1)
    y = np.array(rows["y"].to_pylist(), np.int64)
    if not len(v):
        return Model(names, np.zeros(len(names)), -2.0, [], [], np.zeros(0))
    order = np.lexsort((*v.T, y))
    v, y = v[order], y[order]
    fitted = label_model(v, (y == 1).astype(np.float64))
    weights, bias = fit_linear((v[:, : len(names)] == 1).astype(np.float32), fitted.posterior(v))
    called = [n.decode("utf-8", "replace") for n in names] + list(PATTERNS)
    return Model(names, weights, bias, called, fitted.parents, fitted.accuracy(v))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, between 0 and 1, of each row. Null reads as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_ENTRIES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(text_bytes(batch.column("text"))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, fields(docs, ["doc_id"], "score double"))


def report(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. A row for each row of docs, repeated rows, nulls, empty and very long texts
    included, in the ids' own type; other columns play no part. Without labels the score is the same for all."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
