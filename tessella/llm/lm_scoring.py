"""Language-model scoring from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counting. Workers hash the words and bigrams of whole batches at once, sum equal ones, and send sorted runs to ranges of
hash values, of which there are as many as the corpus needs. Each range sums its runs, keeps exact word counts in a table,
and builds its own regions of the filter, one of words and one of bigrams: an n-gram of count c is put in once for each
level 1 to 1 + log_b(c). The regions together are the filter, of one density at any size. They are broadcast if they fit into
FILTER_BYTES, words first; if not, what the filter says of each range's most frequent n-grams is broadcast in their place.

Scoring. An n-gram's count is found by probing its levels upwards until one is missing. A first pass over the texts writes
each token's levels; n-grams that the broadcast does not know are asked in a shuffle, where each range probes the same
region, and their levels are filled in. Rows are asked for in blocks of about BLOCK tokens, so that questions and answers
are a row for each block and range, not for each text and range. Scores do not depend on how much of the filter is broadcast.

Probabilities interpolate bigrams with smoothed words. A token's probability follows from three levels: its own, that of
the word before, and that of both; so the numbers of training tokens by these three say all that expectation maximisation
needs to fit the weights (by the context's level) on the whole corpus, with each token's own occurrence left out.

The base score needs exact counts of all words. The HEAD most frequent ones are broadcast too (a fixed number); the rest
of each document's words meet the table's ranges in the same shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fields, fold, mix, pieces, remove_table, shuffle_parts, slices, small_batches, text_bytes, word_hashes, write_table

#: Of levels, for words and for bigrams.
BASES = (1.25, 1.6)
#: Bits of the filter for each level of an n-gram, and how many of a 64-bit word's bits a level sets.
BITS, PROBES = 12, 5
FILTER_BYTES = 128 << 20
HEAD = 500_000
#: Bytes of training text whose n-grams make a range, on average at most, and ranges for each partition of a shuffle at
#: least: several, as they fall into partitions by their hash.
RANGE_BYTES, RANGES = 32 << 20, 8
#: Tokens that a worker gathers before it sends their sums on.
RUN = 2_000_000
#: Tokens of the rows that are asked and answered as one.
BLOCK = 1_000_000

END = np.uint64(0x5A17C0DE5EED0001)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: A level that is not known yet.
ASK = 255


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens and of the bigrams that end in them; which tokens begin a text; tokens of each text.

    Every text ends in an end token, which also stands before its first word.
    """
    words, counts = word_hashes(texts)
    sizes = counts + 1
    last = np.cumsum(sizes) - 1
    tokens = np.empty(len(words) + len(texts), np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[last] = False
    tokens[inside], tokens[last] = words, END
    firsts = last - counts
    return tokens, mix(before(tokens, firsts, END) * _STEP + tokens), firsts, sizes


def before(x: np.ndarray, firsts: np.ndarray, boundary) -> np.ndarray:
    """What is at the token before; at a text's first token, the boundary."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[firsts] = boundary
    return out


def range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The range of hash values that h is in; rising with h."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _summed(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, rising, and their counts."""
    if c is None:
        h = np.sort(h)
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[at], np.diff(np.append(at, len(h))).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[at], (np.add.reduceat(c, at) if len(at) else c)


def levels_of(c: np.ndarray, order: int) -> np.ndarray:
    """The level of counts; 0 of 0."""
    c = np.asarray(c)
    return np.where(c > 0, 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(BASES[order - 1]) + 1e-9).astype(np.int64), 0)


def _values(order: int) -> np.ndarray:
    """The count that each level stands for: the geometric mean of the least and the greatest; 0 for level 0."""
    base, level = BASES[order - 1], np.arange(256.0)
    low = np.ceil(base ** (level - 1) - 1e-9)
    high = np.maximum(low, np.ceil(base**level - 1e-9) - 1)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


#: By order and level. Level 254 of words stands for 10**24.
VALUES = (_values(1), _values(2))


def _key(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram at a level, a hash that says in which word of its region it is, and the bits that it sets there."""
    x = mix(h ^ np.uint64(0x9E3779B97F4A7C15 * level & (1 << 64) - 1))
    y, bits = mix(x + np.uint64(0x632BE59BD9B4E019)), np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << (y >> np.uint64(6 * i) & np.uint64(63))
    return x >> np.uint64(32), bits


def region(h: np.ndarray, c: np.ndarray, order: int, per_level: int = BITS) -> np.ndarray:
    """A range's Bloom filter of the n-grams of an order and their counts, in 64-bit words."""
    top = levels_of(c, order)
    held = np.zeros(max(1, -(-per_level * int(top.sum()) // 64)), np.uint64)
    level = 1
    while len(h):
        at, bits = _key(h, level)
        np.bitwise_or.at(held, (at * np.uint64(len(held))) >> np.uint64(32), bits)
        level += 1
        h, top = h[top >= level], top[top >= level]
    return held


def _frequent(h: np.ndarray, c: np.ndarray, held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, rising by hash, and the level that their region says."""
    if len(h) > most:
        keep = np.sort(np.lexsort((h, -c))[:most])
        h = h[keep]
    return h, probed(h, held, 0, len(held)).astype(np.uint8)


def probed(h: np.ndarray, data: np.ndarray, starts: np.ndarray | int, sizes: np.ndarray | int) -> np.ndarray:
    """The level of each n-gram, as the last of its unbroken run of levels, in the filter whose region for it starts at
    starts and has so many words."""
    out, live, level = np.zeros(len(h), np.int64), np.arange(len(h)), 1
    starts, sizes = (np.broadcast_to(np.asarray(x).astype(np.uint64), len(h)) for x in (starts, sizes))
    while len(live):
        at, bits = _key(h[live], level)
        found = (data[starts[live] + (at * sizes[live] >> np.uint64(32))] & bits) == bits
        live = live[found]
        out[live] = level
        level += 1
    return out


@dataclass
class Known:
    """What is broadcast of the filter for an order: its regions, one after another, or else the levels of some n-grams."""

    parts: int
    whole: bool
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    some: np.ndarray
    said: np.ndarray

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The filter's levels; ASK where they are not known here."""
        distinct, back = np.unique(h, return_inverse=True)
        if self.whole:
            p = range_of(distinct, self.parts).astype(np.int64)
            return probed(distinct, self.data, self.starts[p], self.sizes[p])[back]
        if not len(self.some):
            return np.full(len(h), ASK, np.int64)
        at = np.minimum(np.searchsorted(self.some, distinct), len(self.some) - 1)
        return np.where(self.some[at] == distinct, self.said[at], ASK).astype(np.int64)[back]


@dataclass
class Model:
    """What is known of words and of bigrams, exact counts of the most frequent words, totals, and weights by the context's
    level."""

    parts: int
    known: tuple[Known, Known]
    head: np.ndarray
    head_counts: np.ndarray
    tokens: int
    words: int
    weights: np.ndarray | None = None

    @property
    def whole(self) -> bool:
        return self.known[0].whole and self.known[1].whole

    def exact(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is one of the most frequent, and its exact count."""
        if not len(self.head):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        found = self.head[at] == h
        return found, np.where(found, self.head_counts[at], 0)

    def smoothed(self, count: np.ndarray) -> np.ndarray:
        """A word's probability by its count, one half added."""
        return (count + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    def logs(self, word: np.ndarray, context: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Logarithms of tokens' probabilities by the levels of the word, the word before, and both."""
        total = VALUES[0][context]
        q = np.where(total > 0, np.minimum(1.0, VALUES[1][both] / np.maximum(total, 1e-9)), 0.0)
        w = self.weights[context]
        return np.log10(w * q + (1 - w) * self.smoothed(VALUES[0][word]))


def _gather(training: DataFrame, parts: int) -> DataFrame:
    """(p, k, ones, more, counts): sorted hashes of a run's n-grams of order k in range p, seen once and more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for k in range(2):
                h, c = _summed(np.concatenate(held[k]))
                held[k].clear()
                once = h[c == 1]
                h, c = h[c > 1], c[c > 1]
                bounds = np.arange(parts + 1, dtype=np.uint64)
                cut = lambda x: np.searchsorted(range_of(x, parts), bounds)  # noqa: E731, B023
                a, b = cut(once), cut(h)
                full = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()), pa.array([k + 1] * len(full), pa.int32()), pa.array([once[a[i] : a[i + 1]].tobytes() for i in full], pa.binary()),
                        pa.array([h[b[i] : b[i + 1]].tobytes() for i in full], pa.binary()), pa.array([c[b[i] : b[i + 1]].tobytes() for i in full], pa.binary()),
                    ],
                    names=["p", "k", "ones", "more", "counts"],
                )

        for batch in pieces(batches):
            texts = text_bytes(batch.column("text"))
            for lo, hi in slices(texts):
                tokens, bigrams, _, _ = grams(texts[lo:hi])
                held[0].append(tokens)
                held[1].append(bigrams)
                size += len(tokens)
                if size >= RUN:
                    yield from send()
                    size = 0
        if size:
            yield from send()

    return training.select("text").mapInArrow(run, "p int, k int, ones binary, more binary, counts binary")


def _count(runs: DataFrame, most: int, per_level: int) -> DataFrame:
    """One row for each range: totals, a histogram of word counts, the words' hashes and counts, the filter's regions of
    words and bigrams, and what they say of the `most` most frequent of each."""

    def merge(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        row = {"p": (table["p"][0].as_py(), pa.int32())}
        for k in (1, 2):
            of = table.filter(pc.equal(table["k"], k))
            read = lambda name, kind: np.frombuffer(b"".join(of[name].to_pylist()), kind)  # noqa: E731, B023
            ones, more, counts = read("ones", np.uint64), read("more", np.uint64), read("counts", np.int64)
            h, c = _summed(np.concatenate([ones, more]), np.concatenate([np.ones(len(ones), np.int64), counts]))
            del of, ones, more, counts
            if k == 1:
                row |= {
                    "n_words": (len(h), pa.int64()), "n_tokens": (int(c.sum()), pa.int64()), "histogram": (np.bincount(_step(c)).tolist(), pa.list_(pa.int64())),
                    "words": (h.tobytes(), pa.binary()), "counts": (c.tobytes(), pa.binary()),
                }
            held = region(h, c, k, per_level)
            some, said = _frequent(h, c, held, most)
            row |= {f"data{k}": (held.tobytes(), pa.binary()), f"size{k}": (len(held), pa.int64()), f"some{k}": (some.tobytes(), pa.binary()), f"said{k}": (said.tobytes(), pa.binary())}
        return pa.table({name: pa.array([x], kind) for name, (x, kind) in row.items()})

    each = ", ".join(f"data{k} binary, size{k} long, some{k} binary, said{k} binary" for k in (1, 2))
    return runs.groupBy("p").applyInArrow(merge, f"p int, n_words long, n_tokens long, histogram array<long>, words binary, counts binary, {each}")


def _step(c: np.ndarray) -> np.ndarray:
    return (4 * np.log2(np.maximum(c, 1))).astype(np.int64)


def learn(training: DataFrame, filter_bytes: int = FILTER_BYTES, head: int = HEAD, range_bytes: int = RANGE_BYTES, per_level: int = BITS) -> tuple[Model, DataFrame]:
    """The model of the texts of training (text), without weights, and the table of word counts and bigrams by range."""
    spark = training.sparkSession
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(RANGES * shuffle_parts(spark), -(-size // range_bytes))
    table = write_table(_count(_gather(training, parts), filter_bytes // 72 // parts, per_level), "counts")
    total = table.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    # a number for each range, and what is to be broadcast, come to the driver
    stats = table.select("p", "size1", "size2").toArrow()
    known, left = [], filter_bytes
    for k in (1, 2):
        sizes = np.ones(parts, np.int64)  # an empty range has a word of zeros
        sizes[np.array(stats["p"], np.int64)] = np.array(stats[f"size{k}"], np.int64)
        starts, whole = np.cumsum(sizes) - sizes, bool(8 * sizes.sum() <= left)
        data, some, said = np.zeros(int(sizes.sum()) if whole else 0, np.uint64), [], []
        for p, *got in table.select("p", *([f"data{k}"] if whole else [f"some{k}", f"said{k}"])).toLocalIterator():
            if whole:
                data[starts[p] : starts[p] + sizes[p]] = np.frombuffer(got[0], np.uint64)
            else:
                some.append((p, np.frombuffer(got[0], np.uint64), np.frombuffer(got[1], np.uint8)))
        some.sort(key=lambda x: x[0])  # ranges rise with their hashes
        join = lambda i, kind: np.concatenate([np.zeros(0, kind), *(x[i] for x in some)])  # noqa: E731, B023
        known.append(Known(parts, whole, data, starts, sizes, join(1, np.uint64), join(2, np.uint8)))
        left -= data.nbytes
    # the least count of the most frequent words: as many as fit, whole steps of the histogram
    steps = {r.step: r.n for r in table.select(F.posexplode("histogram").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n")).collect()}  # a few hundred rows
    least = min(s for s in range(max(steps, default=0) + 2) if sum(n for k, n in steps.items() if k >= s) <= head)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                h, c = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
                keep = _step(c) >= least
                yield pa.RecordBatch.from_arrays([pa.array([x[keep].tobytes()], pa.binary()) for x in (h, c)], names=["words", "counts"])

    heads = table.select("words", "counts").mapInArrow(top, "words binary, counts binary").toArrow()
    h = np.frombuffer(b"".join(heads["words"].to_pylist()), np.uint64)
    c = np.frombuffer(b"".join(heads["counts"].to_pylist()), np.int64)
    rank = np.argsort(h)
    return Model(parts, tuple(known), h[rank], c[rank], total[1] or 0, total[0] or 0), table


# -- the levels of all tokens ------------------------------------------------------------------------------------------

_FIRST = "rid long, block long, start long, n_tokens long, n_known long, base double, word binary, both binary, tail binary, tail_at binary, asked binary, asked_at binary, pairs binary, pairs_at binary"


def _first_pass(rows: DataFrame, shared, block_tokens: int = BLOCK) -> DataFrame:
    """Per row: doc_id, held_out, a number, its block and its place there, its tokens, and as far as is known without the table: how many of them are
    known, their summed logarithms of count + 0.5, the levels of words and bigrams (ASK where the table must say); and
    the hashes of words whose counts, and of words and bigrams whose levels, the table must say, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rid = shared.value, TaskContext.get().partitionId() << 40
        block, filled = rid, 0
        for batch in pieces(batches):
            texts = text_bytes(batch.column("text"))
            out: dict[str, list] = {n.split()[0]: [] for n in _FIRST.split(", ")}
            for lo, hi in slices(texts):
                tokens, bigrams, firsts, sizes = grams(texts[lo:hi])
                found, count = own.exact(tokens)
                word, both = own.known[0].levels(tokens), own.known[1].levels(bigrams)
                # where the word before is unknown, the bigram counts for nothing
                both = np.where((both == ASK) & (before(word, firsts, ASK) == 0), 0, both)
                out["n_tokens"] += sizes.tolist()
                for size in sizes.tolist():
                    if filled >= block_tokens:
                        block, filled = block + 1, 0
                    out["block"].append(block)
                    out["start"].append(filled)
                    filled += size
                out["base"] += np.add.reduceat(np.where(found, np.log10(count + 0.5), 0.0), firsts).tolist()
                out["n_known"] += np.add.reduceat(found.astype(np.int64), firsts).tolist()
                place = np.arange(len(tokens)) - np.repeat(firsts, sizes)
                ends = [*firsts.tolist(), len(tokens)]
                for name, x in (("word", word.astype(np.uint8)), ("both", both.astype(np.uint8))):
                    out[name] += [x[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                for name, h, some, placed in (("tail", tokens, ~found, False), ("asked", tokens, word == ASK, True), ("pairs", bigrams, both == ASK, True)):
                    at = np.flatnonzero(some)
                    cuts = np.searchsorted(at, ends)
                    out[name] += [h[at[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]
                    out[f"{name}_at"] += [place[at[a:b]].astype(np.int32).tobytes() if placed else b"" for a, b in zip(cuts, cuts[1:])]
            out["rid"] = list(range(rid, rid + len(texts)))
            rid += len(texts)
            kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
            made = [pa.array(out[n.split()[0]], kinds[n.split()[1]]) for n in _FIRST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *made], names=["doc_id", "held_out", *out])

    return rows.mapInArrow(run, fields(rows, ["doc_id", "held_out"], _FIRST))


def _spread(first: DataFrame, name: str, parts: int) -> DataFrame:
    """(p, rids, h): the hashes in a column with their rows, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, hashes = np.array(batch.column("rid").to_pylist(), np.int64), batch.column(name).to_pylist()
            for lo, hi in slices(hashes, 32 << 20):
                h = np.frombuffer(b"".join(hashes[lo:hi]), np.uint64)
                if len(h):
                    yield _dealt(h, parts, {"rids": np.repeat(rids[lo:hi], [len(x) // 8 for x in hashes[lo:hi]])})

    return first.select("rid", name).mapInArrow(run, "p int, h binary, rids binary")


def _dealt(h: np.ndarray, parts: int, more: dict[str, np.ndarray], **same: int) -> pa.RecordBatch:
    """A row (p, what is the same for all, h, more) for each range that has any of the hashes."""
    p = range_of(h, parts).astype(np.int64)
    order = np.argsort(p, kind="stable")
    cuts = np.searchsorted(p[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    cut = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())
    cols = {"p": pa.array(full, pa.int32())} | {k: pa.array([x] * len(full)) for k, x in same.items()} | {k: cut(x[order]) for k, x in {"h": h, **more}.items()}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _asked(first: DataFrame, name: str, parts: int) -> DataFrame:
    """(p, block, h, places): the hashes in a column with their places in their blocks, by range and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[bytes], list[np.ndarray]] = ([], [])
        own, size = -1, 0

        def send() -> Iterator[pa.RecordBatch]:
            if size:
                yield _dealt(np.frombuffer(b"".join(held[0]), np.uint64), parts, {"places": np.concatenate(held[1])}, block=own)
            held[0].clear()
            held[1].clear()

        for batch in batches:
            for block, start, h, at in zip(*(batch.column(n).to_pylist() for n in ("block", "start", name, f"{name}_at"))):
                if block != own or size > 8 * BLOCK:
                    yield from send()
                    own, size = block, 0
                if h:
                    held[0].append(h)
                    held[1].append(np.frombuffer(at, np.int32) + start)
                    size += len(h)
        yield from send()

    return first.select("block", "start", name, f"{name}_at").mapInArrow(run, "p int, block long, h binary, places binary")


def _counted(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(rid, s, k): of the words that _spread gives, the sum of logarithms of count + 0.5 and the number of known ones."""

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        read = lambda t, name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind)
        of, h = read(left, "rids", np.int64), read(left, "h", np.uint64)
        known, counts = read(right, "words", np.uint64), read(right, "counts", np.int64)
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        count = np.where(known[at] == h, counts[at], 0) if len(known) else np.zeros(len(h), np.int64)
        rids, back = np.unique(of, return_inverse=True)
        sums = [np.bincount(back, np.log10(count + 0.5), len(rids)), np.bincount(back, count > 0, len(rids)).astype(np.int64)]
        return pa.table({"rid": pa.array(rids, pa.int64()), "s": sums[0], "k": sums[1]})

    found = asked.groupBy("p").cogroup(table.select("p", "words", "counts").groupBy("p")).applyInArrow(look_up, "rid long, s double, k long")
    return found.groupBy("rid").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))


def _said(asked: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """(block, kind, places, levels): what each range's region says of the n-grams that _asked gives, row by row."""

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(right["data"].to_pylist()), np.uint64)
        asked = [np.frombuffer(x, np.uint64) for x in left["h"].to_pylist()]
        distinct, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *asked]), return_inverse=True)
        level = (probed(distinct, data, 0, len(data)) if len(data) else np.zeros(len(distinct), np.int64)).astype(np.uint8)[back]
        ends = np.cumsum([0, *map(len, asked)])
        return pa.table({"block": left["block"], "kind": pa.array([order] * len(asked), pa.int32()), "places": left["places"], "levels": pa.array([level[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())})

    ranges = table.select("p", F.col(f"data{order}").alias("data"))
    return asked.groupBy("p").cogroup(ranges.groupBy("p")).applyInArrow(look_up, "block long, kind int, places binary, levels binary")


def _filled(first: DataFrame, said: DataFrame) -> DataFrame:
    """first's rows with the levels that the table has said in their places, block by block."""
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "word", "both"]

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        start, size = np.array(left["start"], np.int64), np.array(left["n_tokens"], np.int64)
        order = np.argsort(start)
        left, start, size = left.take(pa.array(order)), start[order], size[order]
        kinds, made = np.array(right["kind"], np.int64), {}
        for kind, name in ((1, "word"), (2, "both")):
            level = np.frombuffer(b"".join(left[name].to_pylist()), np.uint8).copy()
            for i in np.flatnonzero(kinds == kind).tolist():
                level[np.frombuffer(right["places"][i].as_py(), np.int32)] = np.frombuffer(right["levels"][i].as_py(), np.uint8)
            made[name] = pa.array([level[a : a + n].tobytes() for a, n in zip(start, size)], pa.binary())
        return pa.table({n: made[n] if n in made else left[n] for n in names})

    rows = first.select(*names, "block", "start")
    return rows.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(fill, fields(first, names))


def _stacked(batch: pa.RecordBatch, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels of the words, the words before, and both, of all tokens of a batch; which tokens begin a text."""
    word = np.frombuffer(b"".join(batch.column("word").to_pylist()), np.uint8)
    sizes = np.array(batch.column("n_tokens"), np.int64)
    firsts = np.cumsum(sizes) - sizes
    return word, before(word, firsts, boundary), np.frombuffer(b"".join(batch.column("both").to_pylist()), np.uint8), firsts


def tallied(levels: DataFrame, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels of word, word before, and both, and how many tokens have them: at most some hundred thousand rows, as there
    are a few dozen levels of each in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, context, both, _ = _stacked(batch, boundary)
            code, n = np.unique(word.astype(np.int64) << 16 | context.astype(np.int64) << 8 | both, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    rows = levels.select("n_tokens", "word", "both").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = np.array(rows["code"], np.int64), np.array(rows["n"], np.int64)
    order = np.argsort(code)
    code, n = code[order], n[order]
    return code >> 16, code >> 8 & 255, code & 255, n


def fit_weights(model: Model, word: np.ndarray, context: np.ndarray, both: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of the bigrams' probability by the context's level, by expectation maximisation on training tokens, each of
    which is left out of the counts that it is predicted from."""
    less = lambda k, level: np.maximum(VALUES[k][level] - 1, 0.0)
    p, total = model.smoothed(less(0, word)), less(0, context)
    q = np.where(total > 0, np.minimum(1.0, less(1, both) / np.maximum(total, 1e-9)), 0.0)
    # the weight is that of the context as it is without the token
    at = levels_of(np.round(total), 1)
    weights = np.full(256, 0.3)
    seen = np.bincount(at, n, 256) + 2.0
    for _ in range(rounds):
        own = weights[at] * q
        part = own / np.maximum(own + (1 - weights[at]) * p, 1e-300)
        weights = (np.bincount(at, part * n, 256) + 0.6) / seen
    weights = np.clip(weights, 0.0, 0.99)
    weights[0] = 0.0  # no context, nothing to mix
    return weights


def score(docs: DataFrame, held_out: Column, **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; learned from the rows that
    held_out (a condition on the columns of docs) is not true of.

    Null and empty texts are one end token. Repeated rows are learned from and scored each; a null held_out counts as
    false. Without training rows all probabilities are equal. Ids keep their type; other columns play no part, whatever
    their names. Workers hold about 2 MB of text at once, or a longer text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model, table = learn(rows.filter(~F.col("held_out")), **settings)
    shared = spark.sparkContext.broadcast(model)
    boundary = int(model.known[0].levels(np.array([END], np.uint64))[0])
    if boundary == ASK:  # one region says
        of = int(range_of(np.array([END], np.uint64), model.parts)[0])
        data = [np.frombuffer(x, np.uint64) for (x,) in table.filter(F.col("p") == of).select("data1").collect()]
        boundary = int(probed(np.array([END], np.uint64), data[0], 0, len(data[0]))[0]) if data else 0
    floor = np.log10(model.tokens + 0.5 * (model.words + 1)) if model.words else np.log10(0.5)
    first = write_table(_first_pass(rows, shared), "first")
    shared.destroy()
    words = _counted(_spread(first, "tail", model.parts), table)
    known = [(F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("base")]
    levels = first
    if not model.whole:
        said = [_said(_asked(first, name, model.parts), table, order) for order, name in ((1, "asked"), (2, "pairs"))]
        rows = _filled(first, said[0].unionByName(said[1])).join(words, "rid", "left")
        levels = write_table(rows.select("rid", "doc_id", "held_out", "n_tokens", *known, "word", "both"), "levels")
        remove_table(first, table)
    model.weights = fit_weights(model, *tallied(levels.filter(~F.col("held_out")), boundary))
    none = np.zeros(0, np.int64)
    scorer = replace(model, known=(), head=none, head_counts=none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, context, both, firsts = _stacked(batch, boundary)
            sums = np.add.reduceat(scorer.logs(word, context, both), firsts) if len(firsts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sums)], names=[*names, "score"])

    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base"]
    scored = levels.select(*names, "word", "both").mapInArrow(run, fields(levels, names, "score double"))
    if model.whole:
        scored = scored.join(words, "rid", "left").select("doc_id", "held_out", "n_tokens", *known, "score")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(floor))).alias("base_score"), "score",
    )


def report(docs: DataFrame) -> DataFrame:
    """score() with the documents whose crc32(doc_id) mod 5 is 1 held out."""
    return score(docs, fold("doc_id", 5) == 1)
