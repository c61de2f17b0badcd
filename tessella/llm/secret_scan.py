"""Secret scans with Spark SQL functions alone: credential patterns, and sliding-window Shannon entropy for the rest.

Positions come from one split and one extraction by the same pattern: pieces and matches alternate, so running sums of
their lengths are the matches' code-point offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ._common import fresh

#: Fixed: the base patterns. Java's (?i) folds ASCII letters only.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: AKIA and 14 more is 18 in all; a shorter run cannot hide a match, as it ends where the run ends. Likewise for HEX.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs in which windows are weighed.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least bits a character in some window, by character class. A window of 20 has log2(20) = 4.32 at most.
LEAST = {"hex": 3.0, "alnum": 3.6, "symbol": 3.8}
#: Candidates that are no secrets: words and identifiers without digits, digits alone, UUIDs, dates, runs of one mark,
#: placeholders, numbered slugs of words, integrity and version tags.
ALLOW = (
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]|xxxx",
    r"^[A-Za-z]+([/_-][A-Za-z]+)*([/_-][0-9]+)*$",
    r"^sha(1|256|384|512)-",
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_UNIT = 1 << 20


#: Matches whose offsets are summed up in one go; arrays that grow are no longer than that.
BLOCK = 256


def _matches(text: Column, pattern: str, value) -> Column:
    """array<struct<start int, end int, value>> of all matches; value is a function of the match.

    Sums run within blocks of matches, from each block's own offset, so the work follows the number of matches.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    each = f"struct<start:int,end:int,value:{value(None)}>"
    shape = f"struct<at:int,found:array<{each}>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        own = F.struct(start.alias("start"), end.alias("end"), value(x["match"]).alias("value"))
        grown = F.struct(end.alias("at"), F.concat(acc["found"], F.array(own)).alias("found"))
        return F.when(x["match"].isNull(), acc).otherwise(grown.cast(shape))

    def summed(p: Column) -> Column:
        block = lambda i: F.slice(p, i * BLOCK + 1, BLOCK)
        numbers = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
        sizes = F.transform(numbers, lambda i: F.aggregate(block(i), F.lit(0), lambda a, x: a + F.length(x["piece"]) + F.coalesce(F.length(x["match"]), F.lit(0))))
        runs = "struct<at:int,all:array<int>>"
        zero = F.struct(F.lit(0).alias("at"), F.array().alias("all")).cast(runs)
        offsets = F.aggregate(sizes, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")).cast(runs), lambda a: a["all"])
        first = lambda at: F.struct(at.alias("at"), F.array().alias("found")).cast(shape)
        found = lambda o: F.flatten(F.transform(o, lambda at, i: F.aggregate(block(i), first(at), step, lambda acc: acc["found"])))
        return let(offsets, found)

    return F.when(text.rlike(pattern), let(pairs, summed)).otherwise(F.array().cast(f"array<{each}>"))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy in bits of any window of the text (ASCII of the candidate alphabet).

    Counts of the window's characters change by one in and one out; the sum of c*log2(c) follows from a table in
    units of 2**-20, so it is exact integer arithmetic. A text shorter than the window has entropy 0.
    """
    table = F.array(*[F.lit(round(c * math.log2(c) * _UNIT) if c else 0) for c in range(window + 1)]).cast("array<bigint>")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    moves = F.arrays_zip(codes.alias("into"), F.concat(F.array_repeat(F.lit(-1), window), codes).alias("out"))
    shape = "struct<n:array<int>,sum:bigint,seen:int,least:bigint>"
    zero = F.struct(F.array_repeat(F.lit(0), len(_ALPHABET) + 1).alias("n"), F.lit(0).alias("sum"), F.lit(0).alias("seen"), F.lit(None).alias("least")).cast(shape)
    of = lambda n: F.element_at(table, n + 1)

    def step(acc: Column, x: Column) -> Column:
        n_in, n_out = F.element_at(acc["n"], x["into"] + 1), F.element_at(acc["n"], F.greatest(x["out"], F.lit(0)) + 1)
        gain = of(n_in + 1) - of(n_in)
        total = acc["sum"] + F.when(x["out"] < 0, gain).when(x["out"] == x["into"], F.lit(0)).otherwise(gain + of(n_out - 1) - of(n_out))
        counts = F.transform(acc["n"], lambda c, k: c + F.when(k == x["into"], 1).otherwise(0) - F.when(k == x["out"], 1).otherwise(0))
        least = F.when(acc["seen"] + 1 >= window, F.least(acc["least"], total)).otherwise(acc["least"])
        fresh = F.struct(counts.alias("n"), total.alias("sum"), (acc["seen"] + 1).alias("seen"), least.alias("least"))
        return F.when(x["into"].isNull(), acc).otherwise(fresh.cast(shape))

    least = F.aggregate(moves, zero, step, lambda acc: acc["least"])
    bits = F.lit(math.log2(window)) - least / F.lit(float(_UNIT * window))
    return F.when(F.length(text) >= window, bits).otherwise(F.lit(0.0))


def _is_secret(text: Column) -> Column:
    allowed = text.rlike(ALLOW[0])
    for pattern in ALLOW[1:]:
        allowed = allowed | text.rlike(pattern)
    least = F.when(text.rlike("^[0-9a-fA-F]+$"), LEAST["hex"]).when(text.rlike("^[A-Za-z0-9]+$"), LEAST["alnum"]).otherwise(LEAST["symbol"])
    # no window has more bits than the whole has different characters, which are soon counted
    most = F.log2(F.size(F.array_distinct(F.split(text, ""))))
    return F.when(allowed | (most < least), False).otherwise(window_entropy(text) >= least)


def secret_spans(text: Column) -> Column:
    """array<struct<start int, kind int, end int>> by start, then kind (1 to 4 as in KINDS), of a text without nulls."""
    shape = "array<struct<start:int,kind:int,end:int>>"

    def kind(k: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))).cast(shape)

    size = lambda m: "int" if m is None else F.length(F.regexp_extract(m, ASSIGN, 2))
    plain = lambda m: "int" if m is None else F.lit(0)
    itself = lambda m: "string" if m is None else m
    return F.sort_array(
        F.concat(
            kind(1, F.filter(_matches(text, ASSIGN, size), lambda x: x["value"] >= 12)),
            kind(2, _matches(text, ACCESS, plain)),
            kind(3, _matches(text, HEX, plain)),
            kind(4, F.filter(_matches(text, CANDIDATE, itself), lambda x: _is_secret(x["value"]))),
        )
    )


def find(docs: DataFrame) -> DataFrame:
    """docs with secrets: array<struct<start, kind, end>>, code points, end exclusive, kind as a number of KINDS from 1.

    A null text reads as empty and has none; repeated rows each have theirs; a column of docs named secrets is replaced.
    Each row is worked on alone, so there is no shuffle, and memory is bounded by a text.
    """
    return docs.withColumn("secrets", secret_spans(F.coalesce(F.col("text"), F.lit(""))))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end by start, then kind, comma-joined)."""
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return find(docs.select("doc_id", "text")).select(
        "doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        F.sha2(_said(F.filter("secrets", lambda x: x["kind"] < 4)).cast("binary"), 256).alias("base_sha256"),
        _said(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns and rows, with each run of overlapping secrets in text replaced by mark; n_chars, if there,
    follows the text. A null or empty text stays as it is, repeated rows are redacted each, other columns stay, whatever
    their names, and without rows there are none. The work follows the text and its secrets; a text with more than BLOCK
    secrets is held as an array of its characters meanwhile."""
    text, shape = F.col("text"), "struct<at:int,out:string>"
    own = fresh(docs, "__secrets")

    def step(piece):
        def run(acc: Column, x: Column) -> Column:
            grown = F.struct(x["end"].alias("at"), F.concat(acc["out"], piece(acc["at"], x["start"]), F.lit(mark)).alias("out"))
            longer = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
            return F.when((x["start"] < acc["at"]) & (acc["at"] > 0), longer.cast(shape)).otherwise(grown.cast(shape))

        return run

    first = lambda at: F.struct(at.alias("at"), F.lit("").alias("out")).cast(shape)
    cut = lambda at, to: F.substring(text, at + 1, to - at)
    few = F.aggregate(own, first(F.lit(0)), step(cut), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    def many(chars: Column) -> Column:
        # a block of spans is cut out of the characters by place, from the last end before it
        block = lambda i: F.slice(F.col(own), i * BLOCK + 1, BLOCK)
        numbers = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int"))
        ends = F.transform(numbers, lambda i: F.array_max(F.transform(block(i), lambda x: x["end"])))
        ats = F.aggregate(ends, F.array(F.lit(0)), lambda a, e: F.concat(a, F.array(F.greatest(F.element_at(a, -1), e))))
        slices = lambda at, to: F.array_join(F.slice(chars, at + 1, F.greatest(to - at, F.lit(0))), "")
        parts = lambda a: F.transform(numbers, lambda i: F.aggregate(block(i), first(F.get(a, i)), step(slices), lambda acc: acc["out"]))
        rest = lambda a: slices(F.element_at(a, -1), F.size(chars))
        return let(ats, lambda a: F.concat(F.array_join(parts(a), ""), rest(a)))

    cleaned = F.when(F.size(own) <= BLOCK, few).otherwise(let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), many))
    out = docs.withColumn(own, secret_spans(F.coalesce(text, F.lit(""))))
    out = out.withColumn("text", F.when(F.size(own) > 0, cleaned).otherwise(text)).drop(own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(text.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
