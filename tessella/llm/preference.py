"""Preference formatting with DataFrame functions: common turns as the prompt, the rest as two masked completions.

The longest common prefix is found without gathering a conversation anywhere: the two sides meet turn by turn, and the
least turn at which they differ is a partial minimum. Turns are rendered in blocks, of which a task holds one, and a
pair's rendered blocks are then put together in order: its prompt once, its two completions and their masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns that are rendered at once. Results do not depend on it.
BLOCK = 64
_BEGIN, _MIDDLE, _END = "<|im_start|>", "\n", "<|im_end|>\n"


def _sides(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn, chosen, rejected): each side's distinct messages of the turn, in order."""
    def side(df: DataFrame, name: str) -> DataFrame:
        message = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        return df.filter("pair_id is not null").select("pair_id", F.col("turn").cast("long").alias("turn"), message.alias("message"), F.lit(name).alias("side"))

    both = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    own = lambda name: F.sort_array(F.collect_set(F.when(F.col("side") == name, F.col("message")))).alias(name)
    return both.groupBy("pair_id", "turn").agg(own("chosen"), own("rejected"))


def _place() -> Column:
    """Where a turn stands: a null one before all others."""
    return F.struct(F.col("turn").isNotNull().alias("given"), "turn")


def _render(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(_BEGIN), m["role"], F.lit(_MIDDLE), m["text"], F.lit(_END))), "")


def _spans(messages: Column) -> Column:
    """array<struct<start, end>> of the assistant's texts within the rendered messages."""
    shape = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + len(_BEGIN) + F.length(m["role"]) + len(_MIDDLE)
        end = start + F.length(m["text"])
        own = F.when(m["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array())
        return F.struct((end + len(_END)).alias("at"), F.concat(acc["spans"], own).alias("spans")).cast(shape)

    return F.aggregate(messages, F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(shape), step, lambda acc: acc["spans"])


def _mask(blocks: Column, said: str, spans: str) -> Column:
    """start:end of all spans, comma-joined, moved by the lengths of the blocks before."""
    shape = "struct<at:int,out:array<string>>"

    def step(acc: Column, b: Column) -> Column:
        moved = F.transform(b[spans], lambda x: F.concat_ws(":", (x["start"] + acc["at"]).cast("string"), (x["end"] + acc["at"]).cast("string")))
        return F.struct((acc["at"] + F.length(b[said])).alias("at"), F.concat(acc["out"], moved).alias("out")).cast(shape)

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(shape), step, lambda acc: F.array_join(acc["out"], ","))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask from (pair_id, turn, role, text) of both sides: one
    row for each pair.

    prompt holds the turns before the first turn in which the sides differ or one has none; chosen and rejected hold
    each side's turns from there on. A mask lists, as start:end in code points of the completion, what to train on: the
    assistant's texts.

    A null role or text reads as empty, a null turn comes first, rows without a pair_id are left out; messages of one
    turn go by role, then text, and repeated rows count once. A pair with one side has an empty prompt and an empty
    other completion. Other columns play no part, whatever their names; without rows there are no pairs. A pair's texts
    are one row, so they must fit into a string (2 GB).
    """
    turns = _sides(chosen, rejected)
    differ = (F.size("chosen") == 0) | (F.size("rejected") == 0) | (F.col("chosen") != F.col("rejected"))
    first = turns.groupBy(F.col("pair_id").alias("__pair")).agg(F.min(F.when(differ, _place())).alias("__first"))
    joined = turns.join(first, F.col("pair_id") == F.col("__pair")).withColumn("shared", F.col("__first").isNull() | (_place() < F.col("__first")))
    row = F.struct(_place().alias("place"), "shared", "chosen", "rejected")
    blocks = joined.groupBy("pair_id", F.col("turn").isNotNull().alias("given"), F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    flat = lambda name, shared: F.flatten(F.transform("turns", lambda t: F.when(t["shared"] == shared, t[name]).otherwise(none)))
    parts = blocks.select("pair_id", "given", "block", flat("chosen", True).alias("p"), flat("chosen", False).alias("c"), flat("rejected", False).alias("r"))
    said = F.struct("given", "block", _render(F.col("p")).alias("p"), _render(F.col("c")).alias("c"), _render(F.col("r")).alias("r"), _spans(F.col("c")).alias("cs"), _spans(F.col("r")).alias("rs"))
    pairs = parts.select("pair_id", said.alias("b")).groupBy("pair_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    whole = lambda name: F.array_join(F.transform("b", lambda x: x[name]), "")
    return pairs.select(
        "pair_id", whole("p").alias("prompt"), whole("c").alias("chosen"), whole("r").alias("rejected"),
        _mask(F.col("b"), "c", "cs").alias("chosen_mask"), _mask(F.col("b"), "r", "rs").alias("rejected_mask"),
    )


def pair_neighbours(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides of a table of conversations: conv_id 2k is preferred to 2k + 1, as pair k."""
    side = lambda odd: conversations.filter(F.pmod("conv_id", F.lit(2)) == odd).select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), "turn", "role", "text")
    return side(0), side(1)


ORACLE = f"""WITH m AS (SELECT (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair_id, turn, ((conv_id % 2) + 2) % 2 AS side,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT pair_id, (turn IS NOT NULL, coalesce(turn, 0)) AS place, list_sort(list(DISTINCT {{'role': role, 'text': text}}) FILTER (side = 0)) AS c,
        list_sort(list(DISTINCT {{'role': role, 'text': text}}) FILTER (side = 1)) AS r FROM m GROUP BY pair_id, turn),
    f AS (SELECT pair_id, min(place) FILTER (c IS DISTINCT FROM r) AS first FROM t GROUP BY pair_id),
    flat AS (SELECT pair_id, place, part, u.role AS role, u.text AS text FROM (
            SELECT t.pair_id, place, 'p' AS part, c AS list FROM t JOIN f USING (pair_id) WHERE first IS NULL OR place < first
            UNION ALL SELECT t.pair_id, place, 'c', c FROM t JOIN f USING (pair_id) WHERE place >= first
            UNION ALL SELECT t.pair_id, place, 'r', r FROM t JOIN f USING (pair_id) WHERE place >= first), unnest(list) AS z(u)),
    rendered AS (SELECT *, '{_BEGIN}' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said FROM flat),
    placed AS (SELECT *, coalesce(sum(length(said)) OVER (PARTITION BY pair_id, part ORDER BY place, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + {len(_BEGIN)} + length(role) + 1 AS start FROM rendered),
    g AS (SELECT pair_id, part, string_agg(said, '' ORDER BY place, role, text) AS said,
        coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(text) AS BIGINT), ',' ORDER BY place, role, text) FILTER (role = 'assistant'), '') AS mask
        FROM placed GROUP BY pair_id, part)
    SELECT k.pair_id, coalesce(p.said, '') AS prompt, coalesce(c.said, '') AS chosen, coalesce(r.said, '') AS rejected,
        coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
    FROM (SELECT DISTINCT pair_id FROM g) k
    LEFT JOIN g p ON p.pair_id = k.pair_id AND p.part = 'p'
    LEFT JOIN g c ON c.pair_id = k.pair_id AND c.part = 'c'
    LEFT JOIN g r ON r.pair_id = k.pair_id AND r.part = 'r'"""
