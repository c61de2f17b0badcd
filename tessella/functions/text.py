"""Scalar text functions as Columns. All stay in the JVM; see markup and stemmer for the two that cannot."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import SEARCH_STOPWORDS, STOPWORDS


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f of value, computed once: within lambdas an expression would be computed again for each element."""
    return F.transform(F.array(value), lambda x: f(x))[0]


# -- slugs -------------------------------------------------------------------------------------------------------------


def slug(c: Column | str) -> Column:
    """Without anything but ASCII letters and digits; case stays."""
    return F.regexp_replace(_c(c), r"[\W_]+", "")


def replace_bad_chars(c: Column | str) -> Column:
    r"""Each of ' + - & | ! ( ) { } [ ] ^ " ~ * ? : \ becomes an underscore."""
    return F.regexp_replace(_c(c), r"""['+\-&|!(){}\[\]^"~*?:\\]""", "_")


def compress_underscores(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "_+", "_")


def id_slug(c: Column | str) -> Column:
    """A link as an id: trimmed, without schemes, special characters as single underscores."""
    return compress_underscores(replace_bad_chars(F.regexp_replace(F.trim(_c(c)), "https?://", "")))


# -- parties of a case title -------------------------------------------------------------------------------------------

#: Fixed: separators in the order in which they are tried.
SEPARATORS = (" V. ", " v. ", " V ", " v ")


def parties(title: Column | str) -> Column:
    """struct<plaintiff, defendant> of a case title, or null.

    A trailing [ORDER] goes; if the title then ends in a bracket it is cut at its first opening one, unless that is the
    first character; a leading "Case:" goes. The first separator that gives exactly two parts splits it.
    """
    t = F.trim(F.regexp_replace(F.trim(_c(title)), r"\[ORDER\]$", ""))
    at = F.instr(t, "(")
    t = F.trim(F.when(t.endswith(")") & (at > 1), F.substring(t, F.lit(1), at - 1)).otherwise(t))
    t = F.trim(F.regexp_replace(t, "^Case:", ""))
    out = None
    for s in SEPARATORS:
        part = F.split(t, s.replace(".", r"\."), -1)
        pair = F.struct(F.trim(part[0]).alias("plaintiff"), F.trim(F.try_element_at(part, F.lit(2))).alias("defendant"))
        out = F.when(F.size(part) == 2, pair) if out is None else out.when(F.size(part) == 2, pair)
    return out


# -- words and n-grams -------------------------------------------------------------------------------------------------


def words(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(_c(c)), "[^a-z0-9]+"), "")


def search_words(c: Column | str) -> Column:
    """Words that a search looks for: without the short list of function words."""
    stop = F.array(*[F.lit(w) for w in SEARCH_STOPWORDS])
    return F.filter(words(c), lambda w: ~F.array_contains(stop, w))


def feature_words(c: Column | str, stopwords=STOPWORDS) -> Column:
    """Words that may make features: no stop words, longer than a character, not all digits."""
    # one pattern finds runs that have a letter and another character; stop words are a set that is looked up once a word
    found = F.regexp_extract_all(F.lower(_c(c)), F.lit("(?<![0-9])[0-9]++[a-z][a-z0-9]*|[a-z][a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stopwords)) if stopwords else found


def ngrams(w: Column | str, least: int, most: int) -> Column:
    """All runs of least to most words, none of them null, joined by a space, shorter ones first."""

    def size(w: Column, n: int) -> Column:
        # by place: a slice would copy the whole array for each run
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(w[i], *[x for k in range(1, n) for x in (F.lit(" "), w[i + k])]))

    return let(_c(w), lambda w: F.flatten(F.array(*[size(w, n) for n in range(least, most + 1)])))


def short_upper(title: Column | str) -> Column:
    """The lower-cased only upper-case word of four letters, if there is exactly one and the title is not all upper."""
    found = F.regexp_extract_all(_c(title), F.lit("(?<![A-Za-z0-9])[A-Z]{4}(?![A-Za-z0-9])"), F.lit(0))
    only = let(found, lambda x: F.when(F.size(x) == 1, F.transform(x, lambda w: F.lower(w))).otherwise(F.array().cast("array<string>")))
    return F.when(F.upper(_c(title)) != _c(title), only).otherwise(F.array().cast("array<string>"))


def title_ngrams(title: Column | str, least: int = 2, most: int = 4, w: Column | None = None) -> Column:
    """Distinct n-grams of a title's words (w: those words, if stemmed elsewhere) and its short upper-case word, in order."""
    return F.sort_array(distinct_ngrams(title, least, most, w))


def distinct_ngrams(title: Column | str, least: int = 2, most: int = 4, w: Column | None = None) -> Column:
    """The same in no order, for rows that are taken apart anyway."""
    grams = ngrams(feature_words(title) if w is None else w, least, most)
    return F.array_distinct(F.concat(grams, short_upper(title)) if least > 1 else grams)


def with_fallback(features: Column | str, own_id: Column | str) -> Column:
    """Fewer than two features are replaced by the document's id."""
    return let(_c(features), lambda f: F.when(F.size(f) < 2, F.array(_c(own_id))).otherwise(f))


# -- entities ----------------------------------------------------------------------------------------------------------


def is_affix(a: Column, b: Column) -> Column:
    """Whether a, case folded, is a proper beginning or end of b."""
    a, b = F.lower(a), F.lower(b)
    return (a != b) & (b.startswith(a) | b.endswith(a))


def has_affix(a: Column, among: Column) -> Column:
    return F.exists(among, lambda x: is_affix(a, x))


def filter_entities(a: Column | str, invalid: tuple = ()) -> Column:
    """Distinct entities of fewer than three words."""
    bad = F.array(*[F.lit(x) for x in invalid]).cast("array<string>")
    return F.filter(F.array_distinct(_c(a)), lambda x: (F.size(F.split(x, " ")) < 3) & ~F.array_contains(bad, x))


def entities(title: Column | str) -> Column:
    """A case's parties, or else runs of capitalised words (an approximation of a name recogniser)."""
    p = parties(title)
    runs = F.regexp_extract_all(_c(title), F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))
    return F.when(p.isNotNull(), F.array(p["defendant"], p["plaintiff"])).otherwise(filter_entities(runs))


# -- sentences and summaries -------------------------------------------------------------------------------------------

SENTENCE, WORD, SUMMARY = (20, 300), (2, 25), 400
CLEAN_WORDS, CLEAN_SHARE = 6, 0.8


def sentences(c: Column | str) -> Column:
    """Runs up to a full stop, exclamation or question mark, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(_c(c), F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def clean_sentence(c: Column) -> Column:
    """Without a leading date line, up to the last dashes."""
    return F.regexp_replace(c, r"^.+--\s", "")


def is_clean_word(w: Column) -> Column:
    return F.length(w).between(*WORD) & w.rlike("^([a-z]+|[A-Z][a-z]+)$")


def is_clean_sentence(s: Column) -> Column:
    """A sentence of prose: its length, first letter, full stop, and most words are plain words."""
    tokens = F.regexp_extract_all(s, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9 ]"), F.lit(0))
    # words of the right length and form, counted by one pattern: a letter of any case, then small ones
    clean = F.regexp_count(s, F.lit(f"(?<![A-Za-z0-9])[A-Za-z][a-z]{{{WORD[0] - 1},{WORD[1] - 1}}}(?![A-Za-z0-9])"))
    first = F.substring(s, 1, 1)
    plain = F.length(s).between(*SENTENCE) & (F.upper(first) == first) & s.endswith(".")
    return plain & let(clean, lambda n: (n >= CLEAN_WORDS) & (n >= F.size(tokens) * CLEAN_SHARE))


def clean_summary(c: Column | str, parts: Column | None = None) -> Column:
    """The first clean sentences up to 400 characters (the first one always), else the beginning; null if empty. parts
    are the text's sentences, if they were found elsewhere."""
    text = F.replace(_c(c), F.lit("&apos;"), F.lit("'"))
    shape = "struct<out:array<string>,n:int,over:boolean>"

    def add(acc: Column, s: Column) -> Column:
        over = (F.size(acc["out"]) > 0) & (acc["n"] + F.length(s) > SUMMARY)
        grown = F.struct(F.concat(acc["out"], F.array(s)).alias("out"), (acc["n"] + F.length(s)).alias("n"), F.lit(False).alias("over"))
        full = F.struct(acc["out"].alias("out"), acc["n"].alias("n"), F.lit(True).alias("over"))
        return F.when(~is_clean_sentence(s), acc).when(over, full.cast(shape)).otherwise(grown.cast(shape))

    # sentences behind the first one that is too much are not looked at
    step = lambda acc, s: F.when(acc["over"], acc).otherwise(let(clean_sentence(s), lambda s: add(acc, s)))
    zero = F.struct(F.array().alias("out"), F.lit(0).alias("n"), F.lit(False).alias("over")).cast(shape)
    picked = F.aggregate(sentences(text) if parts is None else parts, zero, step, lambda acc: F.array_join(acc["out"], " "))
    short = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)
    return F.when(F.length(_c(c)) > 0, let(picked, lambda p: F.when(p != "", p).otherwise(short)))


def preview(c: Column | str, n: int = 300) -> Column:
    return F.concat(F.substring(_c(c), 1, n), F.lit("..."))


# -- folding, synonyms, spelling ---------------------------------------------------------------------------------------

#: Fixed: letters that do not fold by decomposition.
_LIGATURES = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th", "ß": "ss", "Ĳ": "IJ", "ĳ": "ij", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
_LETTERS = {"Ð": "D", "ð": "d", "Ø": "O", "ø": "o"}


def folding() -> dict[str, str]:
    """Accented Latin letters and ligatures to ASCII: by decomposition up to U+00FF and for Ÿ, the rest as listed."""
    out = dict(_LIGATURES) | _LETTERS
    for ch in [*map(chr, range(0xC0, 0x100)), "Ÿ"]:
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii():
            out[ch] = base
    return out


def fold_ascii(c: Column | str) -> Column:
    rules = folding()
    single = {k: v for k, v in rules.items() if len(v) == 1}
    out = F.translate(_c(c), "".join(single), "".join(single.values()))
    for k, v in rules.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def parse_synonyms(lines: list[str]) -> dict[str, list[str]]:
    r"""Rules "a, b => c, d" (each of a, b becomes c and d) and groups "a, b" (each stands for all); \, is a comma."""
    out: dict[str, list[str]] = {}

    def parts(s: str) -> list[str]:
        return [x.replace("\0", ",").strip() for x in s.replace("\\,", "\0").split(",") if x.strip()]

    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        left, arrow, right = line.partition("=>")
        for src in parts(left):
            known = out.setdefault(src, [])
            known += [x for x in parts(right if arrow else left) if x not in known]
    return out


def expand_synonyms(tokens: Column | str, rules: dict[str, list[str]]) -> Column:
    """Each token's replacements in its place; a token without a rule stays."""
    if not rules:
        return _c(tokens)
    table = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return F.flatten(F.transform(_c(tokens), lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))


def highlight(c: Column | str, terms: list[str], before: str = "<em>", after: str = "</em>", fragment: int = 100, slop: float = 0.5, alternate: Column | str | None = None) -> Column:
    """The best fragment with all matching words wrapped: of the fragments that go from shortly before a match on and do
    not overlap, the first of those with the most matches. It has about `fragment` characters, up to `slop` of that more
    to end with a word. Fragment 0 is the whole text. Without a match the beginning of the alternate field, if given,
    else null. Words are runs of ASCII letters, digits and underscores, in either case."""
    import re

    word = "[A-Za-z0-9_]"
    one = rf"(?<!{word})(?:" + "|".join(re.escape(t) for t in terms) + rf")(?!{word})"
    text = _c(c)
    wrapped = lambda x: F.regexp_replace(x, f"(?i)({one})", before.replace("$", r"\$") + "$1" + after.replace("$", r"\$"))
    if fragment == 0:
        best = F.when(text.rlike(f"(?i){one}"), wrapped(text))
    else:
        lead = fragment // 4
        found = F.regexp_extract_all(text, F.lit(rf"(?is).{{0,{lead}}}?{one}.{{0,{max(0, fragment - lead)}}}{word}{{0,{int(slop * fragment)}}}"), F.lit(0))
        placed = F.transform(found, lambda x, i: F.struct(F.regexp_count(x, F.lit(f"(?i){one}")).alias("n"), (-i).alias("first"), x.alias("part")))
        best = wrapped(F.array_max(placed)["part"])
    return best if alternate is None else F.coalesce(best, F.substring(_c(alternate), 1, fragment) if fragment else _c(alternate))


# -- dates and signatures ----------------------------------------------------------------------------------------------

#: Date formats of feeds, tried in this order.
FEED_DATES = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def feed_date(*cs: Column | str) -> Column:
    """The first readable date of the first attribute that is present, in UTC; null if it cannot be read."""
    raw = F.coalesce(*[_c(c) for c in cs])
    named = F.regexp_replace(raw, "^[A-Za-z]{3}, ", "")  # the weekday carries nothing
    tries = [F.try_to_timestamp(named, F.lit(f.replace("EEE, ", ""))) for f in FEED_DATES]
    return F.coalesce(*tries)


def signature(*cs: Column | str) -> Column:
    """md5 of the fields joined by a bar; null reads as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cs]))
# -- display values ----------------------------------------------------------------------------------------------------


def range_upper(lower: Column | str, gap: float) -> Column:
    """A bucket's upper bound for its label."""
    return _c(lower) + F.lit(gap)


def utc_text(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def capped(tokens: Column | str, most: int = 10_000) -> Column:
    """The tokens that are indexed of a field: the first `most`."""
    return F.slice(_c(tokens), 1, most)
