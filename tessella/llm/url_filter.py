"""URL filters: rules by host and path, and for the rest trust and distrust that flow along links between hosts.

Trust starts at hosts by their number of pages that an allow rule fits, and flows along links; distrust starts at hosts
by their pages that a block rule fits, and flows against links, to who links there. Both are personalised PageRanks over
the graph of hosts, in whole units (a unit of mass is 10**-15), so sums do not depend on their order and any engine gets
the same. A host with more distrust than trust is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import remove_table, write_table

#: (verdict, host, path) of each rule.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
MASS, KEEP = 10**15, 85
#: Rounds of the SQL, which cannot stop by itself. It is the same where ranks settle by then or verdicts do.
ROUNDS = 8
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: An absolute or protocol-relative link target's host.
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ruled(what: int, rules: tuple) -> Column:
    """The verdict (0) or the text (1) of the longest rule that fits host and path; null if none does. Rules are a
    setting, not data: they become one expression."""
    out = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.lit(verdict if what == 0 else host + path)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def parse(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule and ruled (the rule's verdict) of each page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select("page_id", _lower(F.regexp_extract(url, _URL, 1)).alias("host"), F.regexp_extract(url, _URL, 2).alias("path"))
    return parts.select("*", _ruled(1, rules).alias("rule"), _ruled(0, rules).alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts, from the pages' links."""
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    out = pages.select(_lower(F.regexp_extract(url, _URL, 1)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)))).alias("dst"))
    return out.select("src", _lower(F.col("dst")).alias("dst")).filter("src <> '' and dst <> src").distinct()


def host_ranks(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad: numbers of pages) and links (src, dst).

    Rounds go on until no rank changes: from nothing, ranks in whole units only rise, and they are bounded; a unit is
    gone after about 215 rounds. A round's sums are the only numbers that come to the driver.

    Links hold one row for a pair of hosts and meet a table of ranks on src or dst, so a host with very many links can be
    spread by the skewed join, and sums are partial before the shuffle. Each round is written to the shared folder and
    the one before removed.
    """
    hosts = seeds.unionByName(links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host"))), allowMissingColumns=True)
    hosts = hosts.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    total = hosts.agg(F.greatest(F.sum("good"), F.lit(1)).alias("all_good"), F.greatest(F.sum("bad"), F.lit(1)).alias("all_bad"))
    good, bad = total.first() or (1, 1)
    unit = lambda n, of: (F.col(n).cast("decimal(38,0)") * MASS / F.lit(of or 1).cast("decimal(19,0)")).cast("decimal(38,6)")
    hosts = hosts.select("host", F.floor(unit("good", good)).cast("long").alias("good"), F.floor(unit("bad", bad)).cast("long").alias("bad"))
    links = write_table(links, "links")
    ends = lambda end, name: links.groupBy(F.col(end).alias("host")).agg(F.count("*").alias(name))
    hosts = write_table(hosts.join(ends("src", "n_out"), "host", "left").join(ends("dst", "n_in"), "host", "left"), "hosts")
    state = hosts.select("host", "n_out", "n_in", F.lit(0).cast("long").alias("trust"), F.lit(0).cast("long").alias("distrust"))
    no_links, sums, before = links.isEmpty(), None, None
    while True:
        sent = state.select(F.col("host").alias("src"), F.expr("trust div n_out").alias("x"))
        trusted = links.join(sent, "src").groupBy(F.col("dst").alias("host")).agg(F.sum("x").alias("x"))
        sent = state.select(F.col("host").alias("dst"), F.expr("distrust div n_in").alias("y"))
        blamed = links.join(sent, "dst").groupBy(F.col("src").alias("host")).agg(F.sum("y").alias("y"))
        state = hosts.join(trusted, "host", "left").join(blamed, "host", "left").select(
            "host", "n_out", "n_in", F.expr(f"((100 - {KEEP}) * good + {KEEP} * coalesce(x, 0L)) div 100").alias("trust"),
            F.expr(f"((100 - {KEEP}) * bad + {KEEP} * coalesce(y, 0L)) div 100").alias("distrust"),
        )
        state = write_table(state, "ranks")
        now = tuple(state.agg(*[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("trust", "distrust")]).first())
        if before is not None:
            remove_table(before)
        if no_links or now == sums:
            return state.select("host", "trust", "distrust")
        sums, before = now, state


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    A null url or one without :// has an empty host and path, fits no rule and is allowed, as is any host without trust
    and distrust. A null html has no links. Repeated rows are judged each, and count as often as seeds. Ids keep their
    type, other columns play no part, whatever their names; without pages there are no rows.
    """
    parsed = parse(pages, rules)
    seeds = parsed.filter("ruled is not null").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    ranks = host_ranks(seeds, host_links(pages))
    blocked = ranks.filter("distrust > trust").select("host", F.lit("block").alias("by_host"))
    return parsed.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))


def oracle(rounds: int = ROUNDS, rules: tuple = RULES) -> str:
    """The same in SQL, rounds unrolled."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    url = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    link = _LINK.replace("'", "''").replace("(?i)", "")
    steps = [
        f"parts AS MATERIALIZED (SELECT page_id, {low(f'''regexp_extract(coalesce(url, ''), {url}, 1)''')} AS host, regexp_extract(coalesce(url, ''), {url}, 2) AS path, html FROM pages)",
        f"parsed AS MATERIALIZED (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled FROM parts)",
        f"""links AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT host AS src, {low('u.x')} AS dst
            FROM parts, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1, 'i')) AS u(x)) WHERE src <> '' AND dst <> src)""",
        "seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM parsed WHERE ruled IS NOT NULL GROUP BY host)",
        "every AS (SELECT host, good, bad FROM seeds UNION ALL SELECT src, 0, 0 FROM links UNION ALL SELECT dst, 0, 0 FROM links)",
        "counted AS (SELECT host, sum(good) AS good, sum(bad) AS bad FROM every GROUP BY host)",
        f"""hosts AS MATERIALIZED (SELECT host, CAST(good * CAST({MASS} AS HUGEINT) // (SELECT greatest(sum(good), 1) FROM counted) AS BIGINT) AS good,
            CAST(bad * CAST({MASS} AS HUGEINT) // (SELECT greatest(sum(bad), 1) FROM counted) AS BIGINT) AS bad FROM counted)""",
        "out_of AS (SELECT src AS host, count(*) AS n FROM links GROUP BY src)",
        "into_it AS (SELECT dst AS host, count(*) AS n FROM links GROUP BY dst)",
        "r0 AS (SELECT host, good AS trust, bad AS distrust FROM hosts)",
    ]
    for k in range(rounds):
        steps.append(
            f"""r{k + 1} AS MATERIALIZED (SELECT h.host, ({100 - KEEP} * good + {KEEP} * coalesce(x, 0)) // 100 AS trust, ({100 - KEEP} * bad + {KEEP} * coalesce(y, 0)) // 100 AS distrust
            FROM hosts h
            LEFT JOIN (SELECT dst AS host, CAST(sum(trust // n) AS BIGINT) AS x FROM links JOIN r{k} r ON src = r.host JOIN out_of o ON src = o.host GROUP BY dst) t ON t.host = h.host
            LEFT JOIN (SELECT src AS host, CAST(sum(distrust // n) AS BIGINT) AS y FROM links JOIN r{k} r ON dst = r.host JOIN into_it i ON dst = i.host GROUP BY src) b ON b.host = h.host)"""
        )
    return f"""WITH {', '.join(steps)}
        SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
        FROM parsed p LEFT JOIN r{rounds} r ON r.host = p.host"""
