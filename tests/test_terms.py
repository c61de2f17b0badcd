"""Prefixes, candidates and collation of words."""

import itertools
import math
import random
from collections import Counter

from tessella.operators import terms


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_terms(spark):
    random.seed(4)
    vocabulary = ["court", "count", "courts", "case", "cast", "cause", "of", "off", "the", "then", "they", "judge", "é", "éa", "z\U0010ffff", "zz"]
    rows = [(i, random.choices(vocabulary, k=random.randint(0, 12))) for i in range(200)] + [(500, None), (501, [])]
    table = terms.build(spark.createDataFrame(rows, "id long, w array<string>").repartition(3))
    df = Counter(t for _, w in rows for t in set(w or []))
    pairs = Counter(p for _, w in rows for p in zip(w or [], (w or [])[1:]))
    assert {r.term: r.df for r in table.terms().collect()} == df and {(r.a, r.b): r.n for r in table.pairs().collect()} == pairs
    for prefix in ("co", "th", "", "é", "z", "nothing", "z\U0010ffff"):
        want = sorted(((t, n) for t, n in df.items() if t.startswith(prefix)), key=lambda x: (-x[1], x[0].encode()))[:3]
        assert [tuple(r) for r in terms.suggest(table, prefix, 3).collect()] == want, prefix
    plan = terms.suggest(table, "co")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,co)" in plan and "LessThan(term,cp)" in plan
    near = lambda w: sorted(((distance(w, t), -n, t) for t, n in df.items() if distance(w, t) <= 2))[:5]
    for query in (["cuort", "off", "thee"], ["casse"], ["xxxxxxxx", "the"], ["off", "the", "xxxxxxxx", "couse"]):
        choices = [[(t, e) for e, _, t in near(w)] or [(w, 0)] for w in query]
        chains = [(round(-sum(math.log1p(pairs[a[0], b[0]]) for a, b in zip(c, c[1:])), 9), sum(e for _, e in c), [t for t, _ in c]) for c in itertools.product(*choices)]
        assert terms.collate(table, query) == min(chains)[2]
    assert terms.collate(table, []) == []
    empty = terms.build(spark.createDataFrame([], "id long, w array<string>"))
    assert terms.collate(empty, ["a", "b"]) == ["a", "b"] and terms.suggest(empty, "a").count() == 0
