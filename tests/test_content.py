"""Main text of pages and learnt sentence boundaries: golden cases, odd input, brute force."""

import math
import random
import re
from collections import Counter

from tessella.operators import content, sentences

PAGE = """<html><head><title>t</title><style>p{}</style></head><body>
<div id="header"><ul class="nav"><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div>
<div class="layout"><div class="content"><h1>A headline</h1>
<p>The first paragraph, long enough to count, speaks of things, and then of others, for a while.</p>
<div class="share"><a href="x">Share this</a></div><script>var x = "<p>no</p>";</script>
<p>The second one has <a href="y">a link</a>, two commas, and nothing else to say &amp; do.</p></div>
<div class="sidebar"><p>Read also, please: <a href="1">one thing, another, and a third that is long enough to look like text</a></p></div></div>
<div class="footer">Imprint, contact, and all that</div></body></html>"""


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, page int")
    return sorted(((r.page_id, r.text) for r in content.main_text(df).collect()), key=str)


def row(i, html, url="http://a.example/x"):
    return (i, url, html, "clash", 1)


def test_main_text(spark):
    long = ("Words, words, and more words, so that this is the text of an article and not of a menu. " * 3).strip()
    split = f"<body><div><div><p>{long}</p></div><div><p>{long}!</p></div><div><a href=x>{long}</a></div></div></body>"
    wrapped = f"<div class='popup'><div><div><p>{long}</p><p>{long}</p></div></div></div><div><p>A short, true text.</p></div>"
    cases = [
        row(1, PAGE), row(2, None), row(3, ""), row(4, PAGE, "http://a.example/x.PDF"), row(5, "no markup, at all"), row(6, split), row(6, split),
        row(7, wrapped), row(8, "<nav><p>only a menu</p></nav>"), row(9, "<p>open <b>never closed<p>next, one" + "<div>" * 2000 + "deep"), row(None, "<td>cell, text"),
    ]
    got = texts(spark, cases)
    body = "A headline\nThe first paragraph, long enough to count, speaks of things, and then of others, for a while.\nThe second one has a link, two commas, and nothing else to say & do."
    one = " ".join(long.split())
    want = [(1, body), (2, ""), (3, ""), (4, ""), (5, "no markup, at all"), (6, f"{one}\n{one}!"), (6, f"{one}\n{one}!"), (7, "A short, true text."), (8, ""), (None, "cell, text")]
    assert [x for x in got if x[0] != 9] == sorted(want, key=str)
    assert dict(got)[9] == "deep"
    assert texts(spark, []) == []


def brute_split(texts):
    """The same rules over plain lists."""
    toks = [re.split(r"[\x20\x09-\x0D]+", t or "") for t in texts]
    toks = [[w for w in t if w] for t in toks]

    def mark(w):
        bare = re.sub(r"[\"')\]]+$", "", w)
        return "!" if re.search(r"[!?]$", bare) else "." if re.search(r"(^|[^.])\.$", bare) else ""

    def kind(w):
        bare = re.sub(r"[.!?,;:]+$", "", re.sub(r"[\"')\]]+$", "", re.sub(r"^[\"'(\[]+", "", w)).lower())
        return "##" if re.fullmatch(r"[0-9]([0-9.,]*[0-9])?", bare) else bare

    def ratio(a, b, both, n):
        def part(k, m, p):
            return (k * math.log(p) if k else 0) + ((m - k) * math.log(1 - p) if m > k else 0)

        if n <= a or both * n <= a * b:
            return 0
        return 2 * (part(both, a, both / a) + part(b - both, n - a, (b - both) / (n - a)) - part(both, a, b / n) - part(b - both, n - a, b / n))

    every = [(kind(w), mark(w), kind(t[i + 1]) if i + 1 < len(t) else None) for t in toks for i, w in enumerate(t)]
    n, freq, dotted = len(every), Counter(k for k, _, _ in every), Counter(k for k, m, _ in every if m == ".")
    share = sum(dotted.values()) / n
    short = set()
    for k, d in dotted.items():
        if re.search(r"[^\W\d_]", k):
            rest, inner = freq[k] - d, k.count(".")
            size = len(k) - inner
            ll = 2 * (d * math.log(0.99) + rest * math.log(0.01) - d * math.log(share) - rest * math.log(1 - share))
            if ll * math.exp(-size) * (inner + 1) * size ** float(-rest) >= 0.3:
                short.add(k)
    single = lambda k: k == "##" or re.fullmatch(r"[^\W\d_]", k) is not None
    ends = [x for x in every if x[2] is not None and (x[1] == "!" or x[1] == "." and not (x[0] in short or single(x[0])))]
    after = Counter(x[2] for x in ends)
    starts = {k for k, b in after.items() if re.match(r"[^\W\d_]", k) and ratio(len(ends), freq[k], b, n) >= 30}
    around = Counter((x[0], x[2]) for x in every if x[2] is not None and x[1] == "." and (x[0] in short or single(x[0])) and x[2] not in starts)
    near = {p for p, b in around.items() if re.match(r"[^\W\d_]|#", p[1]) and ratio(freq[p[0]], freq[p[1]], b, n) >= 7.88}
    out = []
    for t in toks:
        parts, now = [], []
        for i, w in enumerate(t):
            now.append(w)
            if i + 1 == len(t):
                cut = True
            else:
                k, m, b, nxt = kind(w), mark(w), re.sub(r"^[\"'(\[]+", "", t[i + 1]), kind(t[i + 1])
                if m != ".":
                    cut = m == "!"
                elif k in short:
                    cut = nxt in starts and b[:1].isupper() and (k, nxt) not in near
                elif single(k):
                    cut = (k, nxt) not in near and not b[:1].islower()
                else:
                    cut = True
            if cut:
                parts.append(" ".join(now))
                now = []
        out.append(parts)
    return out, short, starts, near


def test_sentences(spark):
    random.seed(3)
    names = ["Smith", "Jones", "Miller", "Baker"]
    plain = ["the court", "a long case", "this matter", "our reader", "every judge"]
    rows = []
    for i in range(400):
        name, verb = random.choice(names), random.choice(["said", "ruled", "wrote"])
        parts = [f"Dr. {name} {verb} on {random.choice(plain)}.", f"The hearing lasted {random.randint(2, 90)}. days?", f"He met J. {name} vs. {random.choice(names)} in town!"]
        parts += [f"The end came (see {random.choice(plain)}.) quickly", "and then it was over."]
        rows.append((i, " ".join(random.sample(parts, 4))))
    rows += [(2000 + i, "over the court a long case and this matter our reader every judge " * 5) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, "  One.\n\nTwo  three"), (1002, "again. And"), (None, "no id. Here"), (1003, "...")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    model = sentences.train(docs)
    want, short, starts, near = brute_split([t for _, t in rows])
    assert {r.type for r in model.abbreviations.collect()} == short and {"dr", "vs"} <= short and "over" not in short
    assert {r.type for r in model.starters.collect()} == starts and "the" in starts
    assert {(r.type, r.next) for r in model.collocations.collect()} == near
    got = Counter((r.id, tuple(r.sentences)) for r in sentences.split(docs, model).collect())
    assert got == Counter((i, tuple(w)) for (i, _), w in zip(rows, want))
    assert any("Dr. Smith said" in s for _, parts in got for s in parts)
    empty = docs.limit(0)
    assert sentences.split(empty, sentences.train(empty)).count() == 0
