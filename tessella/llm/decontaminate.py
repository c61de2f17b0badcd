"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, carried, fields, pieces, small_batches, text_bytes

#: ASCII apart from digits and letters parts words; A-Z become a-z. All other bytes stay, so lengths do too.
_NORMAL = LOWER.translate(bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)))

_automata: dict[str, object] = {}


def normalise(text: bytes) -> bytes:
    """The text's words with a space before and after each."""
    return b" " + b" ".join(text.translate(_NORMAL).split()) + b" "


def item_windows(text: bytes, size: int) -> set[str]:
    """Every run of size words, or the whole of a shorter text; as Latin-1 text with a space at both ends."""
    words = text.translate(_NORMAL).split()
    if not words:
        return set()
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))]
    return {(b" " + b" ".join(x) + b" ").decode("latin-1") for x in runs}


def pattern_blocks(benchmark: DataFrame, size: int = 10, block_bytes: int = 16 << 20) -> Iterator[dict[str, tuple[int, dict[str, None]]]]:
    """Windows of the benchmark with their number of words and item ids, in blocks of at most about block_bytes.

    The items stream to the driver one partition at a time, so neither the driver nor a broadcast ever holds more
    than a block, whatever the benchmark's size. A null item id reads as "null".
    """
    block: dict[str, tuple[int, dict[str, None]]] = {}
    held = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text"))
    for item, text in rows.toLocalIterator():
        for window in item_windows((text or "").encode(), size):
            if window not in block:
                block[window] = (window.count(" ") - 1, {})
                held += 4 * len(window)
            block[window][1][item] = None
        if held > block_bytes:
            yield block
            block, held = {}, 0
    if block:
        yield block


def _automaton(key: str, patterns) -> object:
    """The worker's automaton for a broadcast block of patterns; it keeps one, and no block."""
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        machine = ahocorasick.Automaton()
        for window, value in patterns.value.items():
            machine.add_word(window, value)
        # the block itself stays on the worker's disk only; the automaton has its values
        patterns.__dict__.pop("_value", None)
        machine.make_automaton()
        _automata[key] = machine
    return _automata[key]


def scan(text: bytes, machine) -> tuple[int, list[int], set[str]]:
    """Number of words, the words' numbers that are hit in order, and the items whose windows occur."""
    normal = normalise(text)
    if len(normal) == 2:
        return 0, [], set()
    found = list(machine.iter(normal.decode("latin-1")))
    if not found:
        return normal.count(b" ") - 1, [], set()
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found])
    first = last - [n for _, (n, _) in found]
    edges = np.zeros(len(spaces), np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last, -1)
    items: set[str] = set()
    for _, (_, of) in found:
        items.update(of)
    return len(spaces) - 1, np.flatnonzero(np.cumsum(edges) > 0).tolist(), items


def word_spans(text: str, hits: list[int]) -> list[tuple[int, int]]:
    """Runs of hit words as code-point spans of the original text."""
    import re

    if not hits:
        return []
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    spans: list[list[int]] = []
    before = -2
    for h in hits:
        if h == before + 1:
            spans[-1][1] = at[h][1]
        else:
            spans.append(list(at[h]))
        before = h
    return [tuple(x) for x in spans]


def _found(docs: DataFrame, benchmark: DataFrame, size: int, keep: list[str], block_bytes: int) -> DataFrame:
    """Columns __keep0, __keep1, ... of docs, __n, __hits, __spans and __items."""
    sc = docs.sparkSession.sparkContext
    run_id = uuid.uuid4().hex
    small_batches(docs.sparkSession)
    df, kept, text = carried(docs, keep)
    blocks = [sc.broadcast(b) for b in pattern_blocks(benchmark, size, block_bytes)]

    def scanned(batch: pa.RecordBatch, key: int) -> list[tuple[int, list[int], set[str]]]:
        texts = text_bytes(batch.column(text))
        if not blocks:
            return [(len(x.translate(_NORMAL).split()), [], set()) for x in texts]
        machine = _automaton(f"{run_id}:{key}", blocks[key])
        return [scan(x, machine) for x in texts]

    def made(batch: pa.RecordBatch, got: list[tuple[int, list[int], set[str]]]) -> pa.RecordBatch:
        spans = [[{"start": a, "end": b} for a, b in word_spans(x or "", g[1])] if g[1] else [] for x, g in zip(batch.column(text).to_pylist(), got)] if any(g[1] for g in got) else [[] for _ in got]
        out = [
            pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int32())),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(g[2]) for g in got], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "__n", "__hits", "__spans", "__items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(blocks) < 2:
            for batch in pieces(batches, text):
                yield made(batch, scanned(batch, 0))
            return
        # one automaton at a time: the part's texts wait, packed, for each block in turn
        packed, found = [], []
        for key in range(len(blocks)):
            for i, batch in enumerate(pieces(batches, text) if not key else map(_unpack, packed)):
                got = scanned(batch, key)
                if not key:
                    packed.append(_pack(batch))
                    found.append(got)
                else:
                    found[i] = [(n, sorted({*a, *b}) if b else a, c | d) for (n, a, c), (_, b, d) in zip(found[i], got)]
        while packed:
            yield made(_unpack(packed.pop(0)), found.pop(0))

    return df.mapInArrow(run, fields(df, df.columns, "__n long, __hits array<int>, __spans array<struct<start:int,end:int>>, __items array<string>"))


def _pack(batch: pa.RecordBatch) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpack(data: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, keep: list[str] | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """Per row of docs: the columns in keep (doc_id), n_words, hit_words (numbers of the words within any occurrence
    of a window), hit_spans (the runs of these words in the original text, in code points) and item_ids (sorted).

    Null and empty texts have no words; an empty benchmark hits nothing; repeated rows and repeated items give each
    row its own result and each item once; other columns of docs play no part unless kept. A task holds one automaton,
    of a block of patterns. One block, which most benchmarks are, is one pass over the texts; with more, a task keeps
    its part of the texts, packed, and goes through them once for each block.
    """
    keep = ["doc_id"] if keep is None else keep
    df = _found(docs, benchmark, size, keep, block_bytes)
    names = {"__n": "n_words", "__hits": "hit_words", "__spans": "hit_spans", "__items": "item_ids"}
    return df.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(n) for c, n in names.items()])


def flag(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The digest of find(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find(docs, benchmark, size).select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, all columns, that no window occurs in; null and empty texts and repeated rows among them."""
    kept = _found(docs, benchmark, size, docs.columns, 16 << 20).filter(F.size("__hits") == 0)
    return kept.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(docs.columns)])
