"""SQL twins of operators that SQL can express."""

from __future__ import annotations

from .secret_scan import ALLOW, LEAST, WINDOW

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM benchmark),
    win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
        FROM b, range(1, len(w) - least(10, len(w)) + 2) r(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM win),
    hits AS MATERIALIZED (SELECT DISTINCT rid, i, n, item_id FROM
        (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, sizes, range(1, len(w) - n + 2) r(i)) x JOIN win USING (n, g)),
    words AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM hits, range(0, n) r(k) GROUP BY rid),
    items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _secrets() -> str:
    names = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), "[aA][pP][iI]_?[kK][eE][yY]"])
    assign = rf"""(?:{names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = {1: assign, 2: "AKIA[A-Z0-9]+", 3: "[0-9a-f]+", 4: "[A-Za-z0-9+/_=-]{20,}"}

    def found(kind: int, pattern: str) -> str:
        return f"""SELECT rid, {kind} AS kind, m, sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM (SELECT rid, unnest(string_split_regex(t, '{pattern}')) AS piece, unnest(regexp_extract_all(t, '{pattern}')) AS m, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS i FROM d) WINDOW w AS (PARTITION BY rid ORDER BY i)"""

    allowed = " OR ".join("regexp_matches(m, '" + p + "')" for p in ALLOW)
    least = f"CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {LEAST['hex']} WHEN regexp_full_match(m, '[A-Za-z0-9]+') THEN {LEAST['alnum']} ELSE {LEAST['symbol']} END"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        every AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM ({found(k, p)}) WHERE m IS NOT NULL" for k, p in kinds.items())}),
        chars AS (SELECT rid, start, i, substring(m, i + j, 1) AS c FROM every, range(1, length(m) - {WINDOW - 2}) a(i), range(0, {WINDOW}) b(j) WHERE kind = 4 AND NOT ({allowed})),
        bits AS (SELECT rid, start, max(h) AS h FROM (SELECT rid, start, i, -sum(n / {WINDOW} * log2(n / {WINDOW})) AS h FROM (SELECT rid, start, i, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
        spans AS (SELECT e.rid, e.kind, CAST(e.start AS BIGINT) AS s, CAST(e.start + length(m) AS BIGINT) AS e FROM every e LEFT JOIN bits b ON b.rid = e.rid AND b.start = e.start
            WHERE CASE kind WHEN 1 THEN length(regexp_extract(m, '{assign}', 1)) >= 12 WHEN 2 THEN length(m) >= 18 WHEN 3 THEN length(m) >= 16 ELSE coalesce(h, 0) >= {least} END),
        said AS (SELECT rid, count(*) FILTER (kind = 1) AS n_assign, count(*) FILTER (kind = 2) AS n_access, count(*) FILTER (kind = 3) AS n_hex,
            string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 4) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans
            FROM (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind] || ':' || s || ':' || e AS x FROM spans) GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN said USING (rid)"""


SECRETS = _secrets()
