"""Porter's stemmer (1980), written from the paper's rules as tables, and as an Arrow UDF over arrays of words."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

# rules of a step: (ending, replacement), longest matching ending first; fixed values of the paper
_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
    ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _kinds(w: str) -> str:
    out = ""
    for i, ch in enumerate(w):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _short_end(w: str) -> bool:
    return len(w) >= 3 and _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def _past(w: str) -> str:
    for end in ("ed", "ing"):
        stem = w[: -len(end)]
        if w.endswith(end) and "v" in _kinds(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _kinds(stem)[-1] == "c" and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


@lru_cache(100_000)
def stem(w: str) -> str:
    if len(w) <= 2:
        return w
    plural = _longest(w, ("sses", "ies", "ss", "s"))
    w = {"sses": w[:-2], "ies": w[:-2], "s": w[:-1]}.get(plural, w)
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        w = _past(w)
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        end = _longest(w, rules)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + rules[end]
    end = _longest(w, _STEP4)
    if end:
        rest = w[: -len(end)]
        if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_words(protected: frozenset[str] = frozenset()):
    """A UDF that stems an array of words; protected ones stay. Of a batch each distinct word is stemmed once."""

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(column.flatten())
        stems = pa.array([w if w is None or w in protected else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(ends, stems.take(coded.indices), mask=column.is_null() if column.null_count else None)

    return run
