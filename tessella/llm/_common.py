"""What several operators share: tables in the cluster's shared folder, folds, Arrow helpers, word splitting."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import BATCH as BATCH
from ..functions.batches import PIECE as PIECE
from ..functions.batches import small_batches as small_batches
from ..operators.store import remove_table as remove_table
from ..operators.store import write_table as write_table


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pack(batch: pa.RecordBatch) -> bytes:
    """A batch as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key falls in no fold (null)."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(key.cast("string").cast("binary")) % parts).cast("int")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- text as bytes ---------------------------------------------------------------------------------------------------


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PIECE (or limit) bytes of a text column; a longer text is a batch of its own."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64)
        sizes = np.diff(sizes[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes.astype(np.int64)) // (limit or PIECE))) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
            if stop > start:
                yield batch.slice(start, stop - start)


def carried(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str], str]:
    """docs with the kept columns under names that cannot clash, those names, and the one of the text."""
    kept = [f"__keep{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], *([] if "text" in keep else [F.col("text").alias("__text")]))
    return df, kept, kept[keep.index("text")] if "text" in keep else "__text"


def fields(df: DataFrame, names: list[str], more: str = "") -> T.StructType:
    """The schema of df's columns of these names, in their own types, and of more columns."""
    return T.StructType([*(T.StructField(n, df.schema[n].dataType) for n in names), *(T.StructType.fromDDL(more) if more else ())])


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_LOWER_U8 = np.frombuffer(LOWER, np.uint8)
#: space and \x09 to \x0D part words
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i up to n, grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) <= n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of text that are hashed at once.
CHUNK = 4 << 20
_PART = re.compile(rb"[\x09-\x0d ]")


def _chunks(text: bytes) -> Iterator[bytes]:
    """The text in runs of about CHUNK bytes that end between words; a longer word is a run of its own."""
    start = 0
    while len(text) - start > CHUNK:
        found = _PART.search(text, start + CHUNK)
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the texts in order, and each text's number of words."""
    if sum(map(len, texts)) <= CHUNK:
        return _word_hashes(texts)
    parts = [(i, x) for i, text in enumerate(texts) for x in _chunks(text)]
    found = [_word_hashes([x for _, x in parts[lo:hi]]) for lo, hi in slices([x for _, x in parts], CHUNK)]
    counts = np.concatenate([n for _, n in found])
    return np.concatenate([h for h, _ in found]), np.bincount([i for i, _ in parts], counts, len(texts)).astype(np.int64)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts that fit into memory with several numbers a byte.

    A word's hash is the difference of two prefix sums of byte * base**position, moved to position 0 by the
    inverse power: whole batches are hashed without a loop over words.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends_at = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    begins = ends_at - sizes
    before[begins[sizes > 0]] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    after[ends_at[sizes > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_U8[data].astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data))[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    marks = np.searchsorted(starts, np.concatenate([begins, ends_at[-1:]]))
    return mix(h + (ends - starts).astype(np.uint64)), np.diff(marks)


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about limit bytes; a longer text is a run of its own."""
    start = total = 0
    for i, x in enumerate(texts):
        if total and total + len(x) > limit:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(texts):
        yield start, len(texts)
