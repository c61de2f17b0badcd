"""More named queries with their SQL twins: main text of pages, learnt sentence boundaries, term clusters, relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import bucket_store, content, features, names, relevance, sentences, term_clusters, terms
from .operators.store import new_path
from .registry import _B, _PLAIN, _query, _table, _texts
from .sources import feeds
from .streaming import ingest as stream
from .streaming import live

# -- main text of pages ------------------------------------------------------------------------------------------------

#: The article of markup of the pages' few plain forms: its blocks as lines.
_LINES = r"""regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(article|h1|p)[^>]*>|<br>', chr(10), 'g')"""
_MAIN = _PLAIN.replace("(html, '(?s)<(script", f"({_LINES}, '(?s)<(script", 1)


@_query(
    f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split({_MAIN}, chr(10)),
        lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages"""
)
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.main_text(_table(spark, sf_dir, "pages"))


# -- sentences by what the texts show of abbreviations and starters -----------------------------------------------------


def _kind_sql(x: str) -> str:
    bare = f"""regexp_replace(lower(regexp_replace(regexp_replace({x}, '^["''(\\[]+', ''), '["'')\\]]+$', '')), '[.!?,;:]+$', '')"""
    return f"CASE WHEN regexp_full_match({bare}, '[0-9]([0-9.,]*[0-9])?') THEN '##' ELSE {bare} END"


def _mark_sql(x: str) -> str:
    bare = f"""regexp_replace({x}, '["'')\\]]+$', '')"""
    return f"CASE WHEN regexp_matches({bare}, '[!?]$') THEN '!' WHEN regexp_matches({bare}, '(^|[^.])\\.$') THEN '.' ELSE '' END"


def _association_sql(a: str, b: str, both: str, n: str) -> str:
    def part(k: str, m: str, p: str) -> str:
        return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {m} > {k} THEN ({m} - {k}) * ln(1 - {p}) ELSE 0 END)"

    rest = (f"({b} - {both})", f"({n} - {a})")
    own, other = part(both, a, f"({both} / {a})"), part(*rest, f"({rest[0]} / {rest[1]})")
    return f"""CASE WHEN {n} > {a} AND {both} * {n} > {a} * {b}
        THEN 2 * ({own} + {other} - {part(both, a, f"({b} / {n})")} - {part(*rest, f"({b} / {n})")}) ELSE 0 END"""


def _single_sql(x: str) -> str:
    return rf"(regexp_full_match({x}, '\p{{L}}') OR {x} = '##')"


def _sentence_sql(body: str) -> str:
    return rf"""d AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, {body} AS body FROM documents),
    k AS MATERIALIZED (SELECT id, i, w[i] AS a, w[i + 1] AS b FROM (SELECT id,
        list_filter(string_split_regex(coalesce(body, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d), range(1, len(w) + 1) r(i)),
    t AS MATERIALIZED (SELECT id, i, a, b, {_mark_sql("a")} AS mark, {_kind_sql("a")} AS type, {_kind_sql("b")} AS next FROM k),
    c AS MATERIALIZED (SELECT type, mark, CASE WHEN mark <> '' THEN next END AS next, count(*) AS n FROM t GROUP BY ALL),
    y AS MATERIALIZED (SELECT type, coalesce(sum(n) FILTER (mark = '.'), 0)::DOUBLE AS dotted, sum(n)::DOUBLE AS n FROM c GROUP BY type),
    q AS (SELECT sum(n) AS every, sum(dotted) / sum(n) AS share FROM y),
    z AS (SELECT type, dotted, n - dotted AS plain, len(type) - len(replace(type, '.', '')) AS inside, len(replace(type, '.', '')) AS size,
        share FROM y, q WHERE dotted > 0 AND regexp_matches(type, '\p{{L}}')),
    ab AS MATERIALIZED (SELECT type, dotted, plain, exp(-size) * (inside + 1) * pow(size, -plain)
        * 2 * (dotted * ln(0.99) + plain * ln(0.01) - dotted * ln(share) - plain * ln(1 - share)) AS score FROM z),
    p AS MATERIALIZED (SELECT c.type, mark, next, n, coalesce(score >= 0.3, false) AS short
        FROM c LEFT JOIN ab USING (type) WHERE next IS NOT NULL),
    ends AS (SELECT * FROM p WHERE mark = '!' OR NOT (short OR {_single_sql("type")})),
    st AS MATERIALIZED (SELECT * FROM (SELECT type, {_association_sql("breaks", "n", "joint", "every")} AS score
        FROM (SELECT next AS type, sum(n)::DOUBLE AS joint FROM ends GROUP BY next) x JOIN y USING (type), q,
            (SELECT sum(n)::DOUBLE AS breaks FROM ends) WHERE regexp_matches(type, '^\p{{L}}')) WHERE score >= 30),
    co AS MATERIALIZED (SELECT * FROM (SELECT type, next, {_association_sql("a", "b", "joint", "every")} AS score
        FROM (SELECT p.type, next, sum(p.n)::DOUBLE AS joint, any_value(x.n) AS a, any_value(z.n) AS b
            FROM p JOIN y x ON x.type = p.type JOIN y z ON z.type = next
            WHERE mark = '.' AND (short OR {_single_sql("p.type")}) AND next NOT IN (SELECT type FROM st) GROUP BY ALL), q
        WHERE regexp_matches(next, '^[\p{{L}}#]')) WHERE score >= 7.88),
    cut AS (SELECT id, i FROM (SELECT *, regexp_replace(b, '^["''(\[]+', '') AS bare FROM t) t LEFT JOIN ab USING (type)
            LEFT JOIN st ON st.type = t.next LEFT JOIN co ON co.type = t.type AND co.next = t.next
        WHERE mark <> '' AND b IS NOT NULL AND CASE WHEN mark = '!' THEN true
            WHEN coalesce(ab.score >= 0.3, false) THEN st.type IS NOT NULL AND regexp_matches(bare, '^\p{{Lu}}') AND co.type IS NULL
            WHEN {_single_sql("t.type")} THEN co.type IS NULL AND NOT regexp_matches(bare, '^\p{{Ll}}') ELSE true END),
    se AS MATERIALIZED (SELECT id, CAST(s AS BIGINT) AS i, string_agg(a, ' ' ORDER BY j) AS sentence FROM (
        SELECT t.id, t.i AS j, a, count(cut.i) OVER (PARTITION BY t.id ORDER BY t.i ROWS UNBOUNDED PRECEDING)
            - CASE WHEN cut.i IS NULL THEN 0 ELSE 1 END AS s
        FROM t LEFT JOIN cut ON cut.id = t.id AND cut.i = t.i) GROUP BY id, s)"""


_BODY = "replace(text, '&apos;', '''')"


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.replace("body", F.lit("&apos;"), F.lit("'")).alias("body"))


@_query(
    f"""WITH {_sentence_sql("text")} SELECT type, CAST(dotted AS BIGINT) AS dotted, CAST(plain AS BIGINT) AS plain,
        round(score, 4) + 0.0 AS score, score >= 0.3 AS abbreviation FROM ab"""
)
def sentence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences.abbreviations(sentences.token_counts(features.spread(_table(spark, sf_dir, "documents").select("text"))))
    return found.withColumn("score", F.round("score", 4) + 0.0)  # no negative zeros


@_query(
    f"""WITH {_sentence_sql("text")} SELECT type, NULL::VARCHAR AS next, round(score, 4) AS score FROM st
        UNION ALL SELECT type, next, round(score, 4) FROM co"""
)
def sentence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentences.train(features.spread(_table(spark, sf_dir, "documents").select("text")))
    both = model.starters.withColumn("next", F.lit(None).cast("string")).unionByName(model.collocations)
    return both.select("type", "next", F.round("score", 4).alias("score"))


@_query(f"WITH {_sentence_sql(_BODY)} SELECT id, i, sentence FROM se")
def trained_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _bodies(spark, sf_dir)
    found = sentences.split(docs, sentences.train(docs, "body"), text="body")
    return found.select("id", F.posexplode("sentences").alias("i", "sentence")).select("id", F.col("i").cast("long").alias("i"), "sentence")


@_query(
    rf"""WITH {_sentence_sql(_BODY)}, s AS (SELECT id, i, regexp_replace(sentence, '^.+--\s', '') AS s FROM se),
        w AS (SELECT *, regexp_extract_all(s, '[A-Za-z0-9]+|[^A-Za-z0-9 ]') AS w FROM s),
        n AS (SELECT *, len(list_filter(w, lambda x: length(x) BETWEEN 2 AND 25 AND regexp_full_match(x, '[a-z]+|[A-Z][a-z]+'))) AS n FROM w),
        g AS (SELECT id, i, s, row_number() OVER (PARTITION BY id ORDER BY i) AS k, sum(length(s)) OVER (PARTITION BY id ORDER BY i) AS total
            FROM n WHERE length(s) BETWEEN 20 AND 300 AND upper(s[1]) = s[1] AND ends_with(s, '.') AND n >= 6 AND n >= 0.8 * len(w)),
        picked AS (SELECT id, string_agg(s, ' ' ORDER BY i) AS picked FROM g WHERE k = 1 OR total <= 400 GROUP BY id)
        SELECT id, coalesce(picked, CASE WHEN length(body) > 200 THEN substring(body, 1, 200) || '...' ELSE body END) AS summary
        FROM d LEFT JOIN picked USING (id) WHERE body <> ''"""
)
def clean_summary_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _bodies(spark, sf_dir).filter("body <> ''")
    # of a text that has no clean sentence the first 200 characters are shown, and whether there are more
    both = F.struct("id", F.substring("body", 1, 201).alias("body"))
    found = sentences.split(docs.withColumn("both", both), sentences.train(_bodies(spark, sf_dir), "body"), "both", "body")
    return found.select("both.id", text.clean_summary("both.body", F.col("sentences")).alias("summary"))


# -- canopies and k-means over the exported term vectors ---------------------------------------------------------------


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.export_vectors(_texts(spark, sf_dir).withColumn("w", text.words("body")), "w")


_EXPORT = f"""{_B}, tf AS (SELECT id, w[i] AS feature, count(*) AS tf FROM a, range(1, len(w) + 1) r(i) GROUP BY ALL), n AS (SELECT count(*) AS n FROM a),
    df AS (SELECT feature, count(*) AS df FROM tf, n GROUP BY feature, n HAVING count(*) <= 0.5 * n),
    raw AS (SELECT id, feature, sqrt(tf) * (ln(n / (df + 1)) + 1) AS w FROM tf JOIN df USING (feature), n),
    p AS MATERIALIZED (SELECT id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw),
    ids AS MATERIALIZED (SELECT DISTINCT id FROM p)"""


def _kmeans_sql(first: str, rounds: int) -> str:
    """Lloyd's steps, unrolled; first selects (cluster, feature, weight)."""
    steps = [f"c0 AS MATERIALIZED ({first})"]
    for k in range(rounds):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT ids.id, coalesce(cluster, (SELECT min(cluster) FROM c{k})) AS cluster FROM ids LEFT JOIN (SELECT id,
                arg_min(cluster, (-round(s, 9), cluster)) AS cluster FROM (SELECT id, cluster, sum(p.weight * c.weight) AS s
                    FROM p JOIN c{k} c USING (feature) GROUP BY ALL) GROUP BY id) USING (id))"""
        )
        steps.append(
            f"""c{k + 1} AS MATERIALIZED (SELECT cluster, feature, w / sqrt(sum(w * w) OVER (PARTITION BY cluster)) AS weight
                FROM (SELECT cluster, feature, sum(weight) AS w FROM p JOIN a{k} USING (id) GROUP BY ALL)
                UNION ALL SELECT * FROM c{k} WHERE cluster NOT IN (SELECT cluster FROM a{k}))"""
        )
    return ", ".join(steps)


_STARTS = """SELECT id AS cluster, feature, weight FROM p
    WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT < floor(least(1.0, greatest(100, (SELECT count(*) FROM ids) // 100) / (SELECT count(*) FROM ids)) * 4294967296)"""


@_query(f"WITH {_EXPORT}, {_kmeans_sql(_STARTS, 3)} SELECT id, cluster FROM a2")
def kmeans_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_clusters.kmeans(_exported(spark, sf_dir), rounds=3)


#: A pass over all points in the order of their md5, one at a time.
_CANOPIES = """s AS MATERIALIZED (SELECT x.id AS a, y.id AS b, round(sum(x.weight * y.weight), 9) AS s FROM p x JOIN p y USING (feature) WHERE x.id <> y.id GROUP BY ALL),
    o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY md5(id), id) AS i FROM ids),
    nb AS MATERIALIZED (SELECT i, id, coalesce(list(b) FILTER (b IS NOT NULL), []) AS near FROM o LEFT JOIN s ON a = id AND s > 0.3 GROUP BY i, id),
    walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS found UNION ALL
        SELECT nb.i, CASE WHEN list_has_any(near, found) THEN found ELSE list_append(found, id) END FROM walk JOIN nb ON nb.i = walk.i + 1),
    centre AS MATERIALIZED (SELECT unnest(found) AS id FROM walk WHERE i = (SELECT count(*) FROM ids))"""


@_query(f"WITH RECURSIVE {_EXPORT}, {_CANOPIES} SELECT a AS id, b AS canopy FROM s WHERE s > 0.2 AND b IN (SELECT id FROM centre) UNION ALL SELECT id, id FROM centre")
def canopy_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_clusters.canopy(_exported(spark, sf_dir), 0.8, 0.7)


_FROM_CANOPIES = "SELECT id AS cluster, feature, weight FROM p WHERE id IN (SELECT id FROM centre)"


@_query(f"WITH RECURSIVE {_EXPORT}, {_CANOPIES}, {_kmeans_sql(_FROM_CANOPIES, 2)} SELECT id, 'mahout' || cluster AS cluster FROM a1")
def canopy_kmeans_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_clusters.batch_clusters(_exported(spark, sf_dir), rounds=2)


# -- clusters of a stream ----------------------------------------------------------------------------------------------


@_query(
    f"""WITH RECURSIVE {_B}, tf AS (SELECT id, w[i] AS feature, count(*) AS tf FROM a, range(1, len(w) + 1) r(i) GROUP BY ALL), n AS (SELECT count(*) AS n FROM a),
        raw AS (SELECT id, feature, sqrt(tf) * (ln(n / (count(*) OVER (PARTITION BY feature) + 1)) + 1) AS w FROM tf, n),
        p AS MATERIALIZED (SELECT id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw WHERE w > 0),
        s AS (SELECT x.id AS a, y.id AS b, round(sum(x.weight * y.weight), 9) AS s FROM p x JOIN p y USING (feature)
            WHERE y.id::BIGINT < x.id::BIGINT GROUP BY ALL HAVING round(sum(x.weight * y.weight), 9) >= 0.5),
        up AS MATERIALIZED (SELECT a AS id, arg_min(b, (-s, b::BIGINT)) AS parent FROM s GROUP BY a),
        chain AS (SELECT id, id AS top FROM a UNION ALL SELECT chain.id, parent FROM chain JOIN up ON up.id = chain.top)
        SELECT id, top AS clusterid FROM chain WHERE top NOT IN (SELECT id FROM up)"""
)
def live_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "documents").schema
    words = lambda docs: docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), text.words("text").alias("w"))
    docs = words(_table(spark, sf_dir, "documents"))
    return live.clustered(words(stream.read_items(spark, f"{sf_dir}/documents.parquet*", schema)), live.frequencies(docs), docs.count(), 0.5)


@_query(
    """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true) AS opens FROM events),
        s AS (SELECT user_id, ts, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
        SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, run"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "events").schema
    found = live.sessions(stream.read_items(spark, f"{sf_dir}/events.parquet*", schema), "ts", "user_id", "12 hours", "400 days")
    return stream.latest(found, ["start", "user_id"], "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


# -- relevance ---------------------------------------------------------------------------------------------------------

#: A frequent word, and two that fewer documents hold.
ASKED = ("the", "anhe", "heat")


def _index(spark: SparkSession, sf_dir: str, positions: bool = False) -> relevance.Index:
    return relevance.build(_texts(spark, sf_dir).select("id", "body"), words=text.words("body"), positions=positions)


_BM25 = f"""{_B}, t AS (SELECT id, w[i] AS term, count(*) AS tf, any_value(len(w)) AS length FROM a, range(1, len(w) + 1) r(i) GROUP BY id, w[i]),
    n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM a), df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * length / mean)) ORDER BY term) AS score
        FROM t JOIN df USING (term), n WHERE term IN {ASKED} GROUP BY id)"""


@_query(f"WITH {_BM25} SELECT id, round(score, 8) AS score FROM s")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.scores(_index(spark, sf_dir), list(ASKED)).select("id", F.round("score", 8).alias("score"))


@_query(f"WITH {_BM25} SELECT id, round(score, 8) AS score FROM s ORDER BY score DESC, id LIMIT 20")
def bm25_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.top(_index(spark, sf_dir), list(ASKED), 20).select("id", F.round("score", 8).alias("score"))


@_query(
    f"""WITH {_B}, t AS MATERIALIZED (SELECT id, w[i] AS term, i FROM a, range(1, len(w) + 1) r(i) WHERE w[i] IN ('of', 'the'))
        SELECT x.id, CAST(min(y.i - x.i - 1) AS INTEGER) AS slack FROM t x JOIN t y ON x.id = y.id AND x.term = 'of' AND y.term = 'the' AND y.i > x.i
        GROUP BY x.id HAVING min(y.i - x.i - 1) <= 3"""
)
def phrase_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.phrase(_index(spark, sf_dir, True), ["of", "the"], 3)


# -- upserts that rewrite what they touch ------------------------------------------------------------------------------


@_query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 64 = 5 THEN 'X' ELSE o_orderstatus END AS status,
        CASE WHEN o_orderkey % 64 = 5 THEN 2 ELSE 1 END AS version FROM orders UNION ALL SELECT -o_orderkey, 'N', 1 FROM orders WHERE o_orderkey % 100 = 9"""
)
def upsert_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    store = bucket_store.BucketStore(spark, new_path(spark, "orders"), orders.schema, "version", 8)
    store.upsert(orders)
    newer = orders.filter("id % 64 = 5").select("id", F.lit("X").alias("status"), F.lit(2).alias("version"))
    older = orders.filter("id % 64 = 7").select("id", F.lit("Y").alias("status"), F.lit(0).alias("version"))
    more = orders.filter("id % 100 = 9").select((-F.col("id")).alias("id"), F.lit("N").alias("status"), F.lit(1).alias("version"))
    for _ in range(2):  # a batch that comes again changes nothing
        store.upsert(newer.unionByName(older).unionByName(more))
    return store.rows()


# -- terms: prefixes, spelling of several words -------------------------------------------------------------------------


def _terms(spark: SparkSession, sf_dir: str, pairs: bool = True) -> terms.Terms:
    return terms.build(_texts(spark, sf_dir).select("id", text.words("body").alias("w")), pairs=pairs)


_TERMS = f"""{_B}, d AS MATERIALIZED (SELECT u.t AS term, count(DISTINCT id) AS df FROM a, unnest(w) u(t) GROUP BY 1)"""


@_query(f"WITH {_TERMS} SELECT term, df FROM d WHERE starts_with(term, 'th') ORDER BY df DESC, term LIMIT 25")
def suggest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.suggest(_terms(spark, sf_dir, pairs=False), "th", 25)


#: Queries of two words, misspelt.
COLLATED = ("off thee", "anda teh", "thh erre")


@_query(
    f"""WITH {_TERMS}, q(query) AS (VALUES {", ".join(f"('{x}')" for x in COLLATED)}),
        w AS (SELECT query, i, string_split(query, ' ')[i] AS word FROM q, range(1, 3) r(i)),
        c AS MATERIALIZED (SELECT query, i, term, levenshtein(word, term) AS e FROM w, d WHERE levenshtein(word, term) <= 2
            QUALIFY row_number() OVER (PARTITION BY query, i ORDER BY levenshtein(word, term), df DESC, term) <= 5),
        n AS MATERIALIZED (SELECT w[i] AS a, w[i + 1] AS b, count(*) AS n FROM a, range(1, len(w)) r(i) GROUP BY ALL)
        SELECT x.query AS query, arg_min(x.term || ' ' || y.term, (-coalesce(n.n, 0), x.e + y.e, x.term, y.term)) AS collation
        FROM c x JOIN c y ON x.query = y.query AND x.i = 1 AND y.i = 2 LEFT JOIN n ON n.a = x.term AND n.b = y.term GROUP BY x.query"""
)
def spell_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _terms(spark, sf_dir)
    return spark.createDataFrame([(x, " ".join(terms.collate(table, x.split()))) for x in COLLATED], "query string, collation string")


# -- names -------------------------------------------------------------------------------------------------------------

_NAMES = rf"""k AS MATERIALIZED (SELECT id, i, w[i] AS a, w[i - 1] AS b FROM (SELECT CAST(doc_id AS VARCHAR) AS id,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), range(1, len(w) + 1) r(i)),
    t AS MATERIALIZED (SELECT id, i, regexp_replace(a, '^[^\p{{L}}0-9]+|[^\p{{L}}0-9]+$', '', 'g') AS word, i = 1 OR {_mark_sql("b")} <> '' AS first,
        NOT regexp_matches(a, '[\p{{L}}0-9]$') AS closed FROM k),
    c AS MATERIALIZED (SELECT lower(word) AS word, count(*) FILTER (regexp_full_match(word, '\p{{Lu}}\p{{L}}+')) AS upper,
            count(*) FILTER (regexp_full_match(word, '\p{{Ll}}+')) AS lower FROM t
        WHERE regexp_full_match(word, '\p{{Ll}}+') OR regexp_full_match(word, '\p{{Lu}}\p{{L}}+') AND NOT first GROUP BY 1)"""


@_query(f'WITH {_NAMES} SELECT word, upper AS "upper", lower AS "lower", upper >= 2 AND upper > lower AS name FROM c')
def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.case_counts(features.spread(_table(spark, sf_dir, "documents").select("text")))


@_query(
    rf"""WITH {_NAMES}, n AS (SELECT t.*, lag(i) OVER o AS before, lag(closed) OVER o AS stop FROM t JOIN c ON c.word = lower(t.word) AND upper >= 2 AND upper > lower
            WHERE regexp_full_match(t.word, '\p{{Lu}}\p{{L}}+') WINDOW o AS (PARTITION BY id ORDER BY i)),
        g AS (SELECT id, i, word, sum(coalesce(before <> i - 1 OR stop OR first, true)::INT) OVER (PARTITION BY id ORDER BY i) AS run FROM n),
        e AS (SELECT DISTINCT id, said FROM (SELECT id, run, string_agg(word, ' ' ORDER BY i) AS said FROM g GROUP BY id, run)),
        s AS (SELECT id, string_agg(said, '|' ORDER BY said) AS names FROM e GROUP BY id)
        SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(names, '') AS names FROM documents LEFT JOIN s ON id = CAST(doc_id AS VARCHAR)"""
)
def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = features.spread(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))
    found = names.entities(docs, names.case_counts(docs))
    return found.select("id", F.array_join("entities", "|").alias("names"))
