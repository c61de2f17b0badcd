"""Repeated passages: Burrows-Wheeler transforms of shards, merged by refining their interleave.

Windows of `length` bytes are dealt out so that equal ones meet. Consecutive windows whose least hash of a core (a run of
2/5 of the length) lies at the same place make a piece, filed under that core's hash: equal windows have equal cores, so only pieces
of one core can share a window. Hashes of cores and pieces say which cores lie in several different pieces; the texts of
these alone, each once, are gathered by core. There shards of them are sorted and transformed, and the transforms are
merged: from them alone, without the texts, the interleave of all suffixes is refined from 7 symbols to 14, 28 and
so on up to the window's length, and the boundaries that each round finds give the common prefixes of neighbours.
Stretches of neighbours with a common prefix of a whole window are repeated.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _BASE, _INVERSE, _power, carried, fields, mix, pack, pieces, remove_table, shuffle_parts, small_batches, unpack, write_table

_BASE2 = 0xD6E8FEB86659FD93
_INVERSE2 = pow(_BASE2, -1, 1 << 64)
#: Places of a text that are hashed at once; bytes of pieces that make a shard; different pieces of a core that one task merges.
SPAN, SHARD, HOT = 1 << 16, 1 << 18, 1 << 11
#: Bytes of text that are packed into a row: under half a MB when packed, which is no large object to the JVM.
PACKED = 1 << 20
#: Bytes of pieces, of whole cores, that a task merges at once; it takes about a hundred bytes for each.
MERGED = 1 << 19


# -- windows and pieces of a batch of texts ----------------------------------------------------------------------------


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the place behind each text; a null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def _sums(data: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, len(data))[: len(data)], out=out[1:])
    return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width neighbours."""
    have = 1
    while 2 * have <= width:
        keys, have = np.minimum(keys[:-have], keys[have:]), 2 * have
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if width > have else keys


def pieces_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first and last window start of each piece, the hash of its core, and one of all its bytes."""
    core = max(1, 2 * length // 5)
    width, n = length - core + 1, len(data)
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins >= length
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, begins[long], 1)
    np.add.at(edges, ends[long] - length + 1, -1)
    within = np.cumsum(edges)[:n] > 0
    mask = np.uint64((1 << (SPAN + width).bit_length()) - 1)
    found = []
    for lo in range(0, n - length + 1, SPAN):
        hi = min(lo + SPAN, n - length + 1)
        good = within[lo:hi]
        if not good.any():
            continue
        part = data[lo : hi + length - 1]
        sums = _sums(part, _BASE)
        cores = mix((sums[core:] - sums[:-core]) * _power(_INVERSE, len(part))[: len(part) - core + 1])
        at = (_least((cores & ~mask) | np.arange(len(cores), dtype=np.uint64), width) & mask).astype(np.int64)
        cut, stop = good.copy(), good.copy()
        cut[1:] &= ~good[:-1] | (at[1:] != at[:-1])
        stop[:-1] &= ~good[1:] | cut[1:]
        first, last = np.flatnonzero(cut), np.flatnonzero(stop)
        whole = mix((sums[last + length] - sums[first]) * _power(_INVERSE, len(part))[first] + (last - first).astype(np.uint64))
        found.append((first + lo, last + lo, cores[at[first]], whole))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


class Pieces:
    """A batch's pieces: each different one once, sorted by core."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int):
        self.first, self.last, h, g = pieces_of(data, ends, length)
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        starts = np.flatnonzero(new)
        self.h, self.g = h[starts], g[starts]
        self.entry = np.zeros(len(h), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.many = np.diff(np.append(starts, len(h))) > 1
        self.one = np.minimum.reduceat(order, starts) if len(starts) else starts
        own = np.ones(len(starts), bool)
        own[1:] = self.h[1:] != self.h[:-1]
        cores = np.flatnonzero(own)
        self.core_of, self.core, self.core_g, self.core_n = np.cumsum(own) - 1, self.h[cores], self.g[cores], np.diff(np.append(cores, len(own)))


def _dealt(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of the keys of each range, in order."""
    to = (keys % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        yield r, order[cuts[r] : cuts[r + 1]]


def _asked(p: Pieces, ranges: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What a batch asks of each range: kind 0 about its pieces, kind 1 about its cores."""
    for r, of in _dealt(p.g, ranges):
        yield 0, r, of, np.stack([p.h[of], p.g[of], p.many[of].astype(np.uint64)])
    for r, of in _dealt(p.core, ranges):
        yield 1, r, of, np.stack([p.core[of], p.core_g[of], p.core_n[of].astype(np.uint64)])


def _answered(hot: int):
    """For pieces: 0 if there is one, 1 if there are more, 2 for the one of these whose text is to be sent. For
    cores: 0 if they lie in one piece only, 1 if in several, 2 if in more than hot (equal ones of other batches counted)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: (x["kind"], x["bid"]))
        out = []
        for kind in (0, 1):
            of = [x for x in rows if x["kind"] == kind]
            if not of:
                continue
            bodies = [np.frombuffer(x["body"], np.uint64).reshape(3, -1) for x in of]
            h, g, n = np.concatenate(bodies, axis=1)
            order = np.argsort(h, kind="stable") if kind else np.lexsort((g, h))
            h, g, n = h[order], g[order], n[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) if kind else (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(h)))
            if kind:
                total = np.add.reduceat(n, starts)
                several = (np.minimum.reduceat(g, starts) != np.maximum.reduceat(g, starts)) | (np.maximum.reduceat(n, starts) > 1)
                got = np.repeat(several.astype(np.uint8) + (several & (total > np.uint64(hot))), sizes)
            else:
                got = np.repeat(((sizes > 1) | (np.maximum.reduceat(n, starts) > 0)).astype(np.uint8), sizes)
                got += (got > 0) & new
            flags = np.zeros(len(h), np.uint8)
            flags[order] = got
            cuts = np.cumsum([0, *(b.shape[1] for b in bodies)]).tolist()
            out += [{"bid": x["bid"], "kind": kind, "range": x["range"], "body": zlib.compress(flags[a:b].tobytes(), 1)} for x, a, b in zip(of, cuts, cuts[1:])]
        return pa.Table.from_pylist(out, schema=_ROWS)

    return run


_ROWS = pa.schema([("bid", pa.int64()), ("kind", pa.int32()), ("range", pa.int32()), ("body", pa.binary())])
_ROWS_DDL = "bid long, kind int, range int, body binary"


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers of a sorted array."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]


def _spans(bid: int, first: np.ndarray, last: np.ndarray) -> dict:
    return {"bid": bid, "kind": 0, "range": 0, "body": zlib.compress(np.stack([first, last]).astype(np.int64).tobytes(), 1)}


# -- transforms and their merge ----------------------------------------------------------------------------------------

_SYMBOLS = 7


def _refined(keys: np.ndarray, jump, depth: int, most: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by up to `most` symbols from given keys of their first `depth` ones, and the number of symbols
    that each row is known to share with the one before it (`most` if all). jump(d) gives each row's row d symbols on.

    A round takes the rows that are not alone in their block, in the order so far, and deals each block out by the blocks of
    the rows `depth` on; a stable sort, which merges the runs that are in order already. Rows alone stay in their place.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    sorted_keys = keys[order]
    shared = np.full(n, most, np.int32)
    new = np.ones(n, bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    shared[new] = 0
    block = np.zeros(n, np.int32)
    block[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    live = np.flatnonzero(~new | np.append(~new[1:], False)) if n else np.zeros(0, np.int64)
    while len(live) and depth < most:
        step = min(depth, most - depth)
        rows = order[live]
        key = (block[rows].astype(np.int64) << 32) | block[jump(step)[rows]]
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        order[live] = rows
        cut = np.ones(len(live), bool)
        cut[1:] = key[1:] != key[:-1]
        shared[live[cut & ~new[live]]] = depth
        new[live] |= cut
        block[rows] = live[np.maximum.accumulate(np.where(cut, np.arange(len(live)), 0))]
        alone = cut & np.append(cut[1:], True)
        live = live[~alone]
        depth += step
    return order, shared


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of different texts, each with a mark (0) behind it and bytes one up, and the places
    that its rows begin at. Rows are rotations of all texts in a ring, so that a row's next one follows from symbols alone."""
    ring = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ring[np.cumsum([len(x) + 1 for x in texts]) - 1] = 0
    n = len(ring)
    keys = np.zeros(n, np.int64)
    for i in range(_SYMBOLS):
        keys = (keys << 9) | np.roll(ring, -i)
    places = np.arange(n, dtype=np.int32)
    order, _ = _refined(keys, lambda d: (places + d) % n, _SYMBOLS, n)
    return ring[order - 1], order


def merge(transforms: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of all rows of some transforms by their first `most` symbols (rows numbered through), and the
    symbols that each shares with the one before it, `most` at most. Only the transforms are read, no text."""
    following, symbols, before = [], [], 0
    for last in transforms:
        psi = np.argsort(last, kind="stable")
        symbols.append(last[psi])
        following.append((psi + before).astype(np.int32))
        before += len(last)
    symbol, one = np.concatenate(symbols).astype(np.int64), np.concatenate(following)
    depth = min(_SYMBOLS, most)
    keys, at = np.zeros(before, np.int64), np.arange(before, dtype=np.int32)
    jumps = {1: one}
    for _ in range(depth):
        keys, at = (keys << 9) | symbol[at], one[at]

    def jump(d: int) -> np.ndarray:
        if d not in jumps:
            half = jump(d // 2)
            jumps[d] = half[half] if d % 2 == 0 else one[half[half]]
        return jumps[d]

    return _refined(keys, jump, depth, most)


def repeated(texts: list[bytes], length: int, shard: int = SHARD) -> list[np.ndarray]:
    """The places in each of some different texts at which a string of `length` bytes begins that begins elsewhere too."""
    shards, size = [[]], 0
    for x in texts:
        if size > shard:
            shards.append([])
            size = 0
        shards[-1].append(x)
        size += len(x) + 1
    made = [transform(x) for x in shards]
    order, shared = merge([last for last, _ in made], length)
    again = shared >= length
    again[:-1] |= again[1:]
    sizes = np.array([len(x) + 1 for x in texts])
    bases = np.cumsum([0, *(len(last) for last, _ in made)])
    places = np.concatenate([at + base for (_, at), base in zip(made, bases)])[order[again]]
    begins = np.cumsum(sizes) - sizes
    places.sort()
    of = np.searchsorted(begins, places, "right") - 1
    inside = places - begins[of] <= sizes[of] - 1 - length
    places, of = places[inside], of[inside]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [places[a:b] - begins[i] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


# -- the jobs ----------------------------------------------------------------------------------------------------------


def _sent(length: int, ranges: int, text: str):
    """From a batch and the answers to it: kind 0, windows known to repeat; kind 1, texts of pieces to be merged; kind 2,
    windows of cores that lie in too many pieces for one task, by hash."""

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        (bid,), (body,) = batch.column("bid").to_pylist(), batch.column("body").to_pylist()
        data, ends = flat(unpack(body).column(text))
        p = Pieces(data, ends, length)
        got = {(x["kind"], x["range"]): np.frombuffer(zlib.decompress(x["body"]), np.uint8) for x in answers.to_pylist()}
        again, core = np.zeros(len(p.h), np.uint8), np.zeros(len(p.core), np.uint8)
        for kind, r, of, _ in _asked(p, ranges):
            (core if kind else again)[of] = got[kind, r]
        core = core[p.core_of]
        known = again[p.entry] > 0
        out = [_spans(bid, p.first[known], p.last[known])]
        send = np.flatnonzero((again != 1) & (core == 1))
        for r, of in _dealt(p.h[send], ranges):
            of = send[of]
            first, last = p.first[p.one[of]].tolist(), p.last[p.one[of]].tolist()
            rows = pa.RecordBatch.from_arrays(
                [pa.array(p.h[of]), pa.array(first, pa.int64()), pa.array(again[of] == 0), pa.array([data[a : b + length].tobytes() for a, b in zip(first, last)], pa.binary())],
                names=["core", "first", "wanted", "text"],
            )
            out.append({"bid": bid, "kind": 1, "range": r, "body": pack(rows)})
        send = np.flatnonzero((again != 1) & (core == 2))
        if len(send):
            first, sizes = p.first[p.one[send]], p.last[p.one[send]] - p.first[p.one[send]] + 1
            places = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            h, g = window_hashes(data, places, length)
            order = np.lexsort((g, h))
            h, g, places = h[order], g[order], places[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            many = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
            same = np.sort(places[np.repeat(many, np.diff(np.append(np.flatnonzero(new), len(h))))])
            out.append(_spans(bid, same, same))
            h, g, places = h[new], g[new], places[new].astype(np.uint64)
            out += [{"bid": bid, "kind": 2, "range": r, "body": np.stack([h[of], g[of], many[of].astype(np.uint64), places[of]]).tobytes()} for r, of in _dealt(h, ranges)]
        return pa.Table.from_pylist(out, schema=_ROWS)

    return run


def window_hashes(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows at some places."""
    out = []
    for base, inverse in ((_BASE, _INVERSE), (_BASE2, _INVERSE2)):
        sums = _sums(data, base)
        out.append(mix((sums[places + length] - sums[places]) * _power(inverse, len(data))[places]))
    return out[0], out[1]


def _merged(length: int):
    """The repeated windows among the pieces of a range of cores: some whole cores at a time, since pieces of different
    cores share no window."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["bid", "body"]).to_pylist(), key=lambda x: x["bid"])
        got = pa.Table.from_batches([unpack(x["body"]) for x in rows])
        bids = np.repeat([x["bid"] for x in rows], [len(unpack(x["body"])) for x in rows])
        cores = got.column("core").to_numpy()
        order = np.argsort(cores, kind="stable")
        bids, cores, got = bids[order], cores[order], got.take(order).combine_chunks()
        sizes = np.cumsum(pa.compute.binary_length(got.column("text")).to_numpy().astype(np.int64))
        starts = np.flatnonzero(np.append(True, cores[1:] != cores[:-1]))
        before = np.append(0, sizes)[starts]
        cuts = [int(starts[i]) for i in np.flatnonzero(np.append(True, np.diff(before // MERGED) != 0))] + [len(cores)]
        found: dict[int, list[np.ndarray]] = {}
        for a, b in zip(cuts, cuts[1:]):
            some = got.slice(a, b - a)
            each = repeated(some.column("text").to_pylist(), length)
            for bid, first, ask, at in zip(bids[a:b].tolist(), some.column("first").to_pylist(), some.column("wanted").to_pylist(), each):
                if ask and len(at):
                    found.setdefault(bid, []).append(at + first)
        return pa.Table.from_pylist([_spans(b, *_runs(np.sort(np.concatenate(x)))) for b, x in found.items()], schema=_ROWS)

    return run


def _counted():
    """The repeated ones among the windows of a range of hashes."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["bid", "body"]).to_pylist(), key=lambda x: x["bid"])
        bodies = [np.frombuffer(x["body"], np.uint64).reshape(4, -1) for x in rows]
        h, g, many, places = np.concatenate(bodies, axis=1)
        owner = np.repeat([x["bid"] for x in rows], [b.shape[1] for b in bodies])
        order = np.lexsort((g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(h)))
        hit = order[np.repeat((sizes > 1) | (np.maximum.reduceat(many[order], starts) > 0), sizes)]
        out = []
        for bid in np.unique(owner[hit]).tolist():
            at = np.sort(places[hit][owner[hit] == bid].astype(np.int64))
            out.append(_spans(bid, *_runs(at)))
        return pa.Table.from_pylist(out, schema=_ROWS)

    return run


def _removed(length: int, text: str, kept: list[str], schema: pa.Schema, digest: bool):
    """A batch's rows with what its repeated windows cover taken out."""

    def run(batch: pa.Table, spans: pa.Table) -> pa.Table:
        rows = unpack(batch.column("body").to_pylist()[0])
        data, ends = flat(rows.column(text))
        edges = np.zeros(len(data) + 1, np.int64)
        for body in spans.column("body").to_pylist():
            first, last = np.frombuffer(zlib.decompress(body), np.int64).reshape(2, -1)
            np.add.at(edges, first, 1)
            np.add.at(edges, last + length, -1)
        gone = np.cumsum(edges)[: len(data)] > 0
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        opens, closes = gone.copy(), gone.copy()
        opens[1:] &= ~gone[:-1]
        closes[:-1] &= ~gone[1:]
        inner = begins[(begins > 0) & (begins < len(data))]  # a run ends with its text
        opens[inner], closes[inner - 1] = gone[inner], gone[inner - 1]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        cuts = np.searchsorted(first, np.append(begins, len(data)))
        stay = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
        totals = np.concatenate([[0], np.cumsum(gone)])
        out = [*(rows.column(k) for k in kept), pa.array(ends - begins, pa.int64()), pa.array(totals[ends] - totals[begins], pa.int64())]
        if digest:
            out += [pa.array(np.diff(cuts), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stay])]
        else:
            out += [pa.array([[{"start": s, "end": e} for s, e in zip((first[i:j] - b).tolist(), (last[i:j] - b).tolist())] for i, j, b in zip(cuts, cuts[1:], begins)], schema.field(len(kept) + 2).type), pa.array(stay, pa.binary())]
        return pa.Table.from_arrays(out, schema=schema)

    return run


def dedupe(docs: DataFrame, length: int = 200, keep: list[str] | None = None, digest: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of docs: the columns in keep (doc_id), n_bytes, n_removed, spans (start, end of each removed run, in bytes of
    the text's UTF-8) and kept (the remaining bytes). With digest, n_spans and kept_sha256 in place of the last two.

    A byte goes if a string of `length` bytes (2 or more) covers it that begins anywhere else too, in the same text or
    another; no string spans two texts, and all are judged on the whole input. Null and empty texts and those shorter
    than length lose nothing by themselves; repeated rows are texts of their own, so both lose all; an empty table gives no rows; other columns play no part, whatever
    their names. Overlapping occurrences count, so a run of one letter goes wholly.

    Texts are packed by the MB into rows of a written table, which every job reads. A row sends each different
    hash once, so what a task gathers for a core or a piece is at most a number for each row of that table. Pieces of a core in more than
    `hot` of them are not merged in one task: their windows are counted by two 64-bit hashes, with the same result. Pieces
    are equal if the 64-bit hashes of core and piece are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = ["doc_id"] if keep is None else keep
    df, kept, text = carried(docs, keep)
    ranges = max(32, shuffle_parts(spark))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, PACKED):
            yield pa.RecordBatch.from_arrays([pa.array([pack(batch)], pa.binary())], names=["body"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, body in zip(batch.column("bid").to_pylist(), batch.column("body").to_pylist()):
                asked = [{"bid": bid, "kind": kind, "range": r, "body": x.tobytes()} for kind, r, _, x in _asked(Pieces(*flat(unpack(body).column(text)), length), ranges)]
                yield pa.RecordBatch.from_pylist(asked, schema=_ROWS)

    texts = write_table(df.mapInArrow(packed, "body binary").select(F.monotonically_increasing_id().alias("bid"), "body"), "packed")
    answers = write_table(texts.mapInArrow(ask, _ROWS_DDL).groupBy("range").applyInArrow(_answered(hot), _ROWS_DDL), "answers")
    by_batch = texts.groupBy("bid")
    sent = write_table(by_batch.cogroup(answers.groupBy("bid")).applyInArrow(_sent(length, ranges, text), _ROWS_DDL), "sent")
    remove_table(answers)
    spans = sent.filter("kind = 0").unionByName(sent.filter("kind = 1").groupBy("range").applyInArrow(_merged(length), _ROWS_DDL))
    spans = spans.unionByName(sent.filter("kind = 2").groupBy("range").applyInArrow(_counted(), _ROWS_DDL))
    more = "n_bytes long, n_removed long, " + ("n_spans long, kept_sha256 string" if digest else "spans array<struct<start:long,end:long>>, kept binary")
    schema = fields(df, kept, more)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = by_batch.cogroup(spans.groupBy("bid")).applyInArrow(_removed(length, text, kept, to_arrow_schema(schema), digest), schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *out.columns[len(kept) :])


def report(docs: DataFrame) -> DataFrame:
    """The digest of dedupe(): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedupe(docs, digest=True)


ORACLE = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    blocks AS (SELECT rid, b, substr(x, 2 * b + 1, 910) AS y, length(x) // 2 - 200 AS most FROM d, range(0, length(x) // 2 - 199, 256) r(b) WHERE length(x) >= 400),
    w AS MATERIALIZED (SELECT rid, b + i AS p, hash(substr(y, 2 * i + 1, 400)) AS h FROM blocks, range(0, 256) r(i) WHERE b + i <= most),
    again AS MATERIALIZED (SELECT rid, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
    cut AS (SELECT rid, p, coalesce(p - lag(p) OVER s > 200, true) AS opens FROM again WINDOW s AS (PARTITION BY rid ORDER BY p)),
    runs AS (SELECT rid, min(p) AS a, max(p) + 200 AS b FROM (SELECT rid, p, sum(opens::INT) OVER (PARTITION BY rid ORDER BY p) AS run FROM cut) GROUP BY rid, run),
    rest AS (SELECT rid, a, b, coalesce(lag(b) OVER s, 0) AS before, row_number() OVER s AS i, count(*) OVER (PARTITION BY rid) AS n FROM runs WINDOW s AS (PARTITION BY rid ORDER BY a)),
    kept AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed,
        string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS k FROM rest JOIN d USING (rid) GROUP BY rid)
    SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
    FROM d LEFT JOIN kept USING (rid)"""
