"""Chat formatting: logged snapshots collapse to maximal conversations, then render.

A chat log often holds the same conversation again and again, each time with more
turns. Every turn gets a hash of its number, role and text (two independent XXH64); the
running exclusive or of these hashes is the hash of the conversation's prefix up to
that turn. A conversation whose last prefix hash is a prefix hash of a longer one is
contained in it and leaves by an anti-join; of equal conversations the least id stays.
Only the maximal conversations are rendered.

A conversation may hold any number of turns: turns are cut into segments of
`segment` turn numbers, running hashes are taken inside a segment and joined with the
hash of the segments before it, so no window holds a whole long conversation; a
conversation is rendered in parts of one segment each. Prefixes are combined before
the shuffle, so a first turn that a third of all conversations share is one row.

Only DataFrame functions are used. 128 bits of hash stand for equality of turns.

Defined cases: repeated rows (conversation, turn, role, text) count once. Several
different rows of one turn number stay together, ordered by role and text. A null
turn number comes before all others, a null conversation id is one conversation, and
null roles and texts differ from empty ones in hashes but render as empty. Turn numbers
may have gaps, which count as content. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoline.llm.common import stored, table

SEGMENT = 1024
# Markers of the rendered form.
OPEN, CLOSE, END = "<|", "|>\n", "\n<|end|>\n"


def turns_of(log: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct rows as (conv, at, role, text, seg), where `conv` and `at` are never null."""
    at = F.col(turn).cast("long")
    return (log.select(F.struct(F.col(conv_id).alias("id")).alias("conv"),
                       F.struct(at.isNotNull().alias("known"), F.coalesce(at, F.lit(0)).alias("turn")).alias("at"),
                       F.col(role).alias("role"), F.col(text).alias("text"))
            .distinct())


def _segment(at: Column, segment: int) -> Column:
    return F.when(at["known"], F.floor(at["turn"] / F.lit(segment))).otherwise(F.lit(-(1 << 62))).cast("long")


def prefixes(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each conversation and turn number: hashes h1, h2 and number n of turns up to it."""
    # A hash passes over nulls, so they are told apart from texts by a first letter.
    role, text = (F.coalesce(F.concat(F.lit("t"), c), F.lit("n")) for c in ("role", "text"))
    hashed = turns.select("conv", "at", F.xxhash64("at", role, text).alias("h1"), F.xxhash64(F.lit(1), text, role, "at").alias("h2"))
    steps = stored(hashed.groupBy("conv", "at").agg(
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count(F.lit(1)).alias("n"))
        .withColumn("seg", _segment(F.col("at"), segment)), "chat-steps")
    sums = [F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("n").alias("n")]
    inside = Window.partitionBy("conv", "seg").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.groupBy("conv", "seg").agg(*sums).select(
        "conv", "seg", *[F.coalesce(agg.over(before), F.lit(0)).alias(f"b_{c}") for c, agg in
                         (("h1", F.bit_xor("h1")), ("h2", F.bit_xor("h2")), ("n", F.sum("n")))])
    running = steps.select("conv", "at", "seg", F.bit_xor("h1").over(inside).alias("h1"), F.bit_xor("h2").over(inside).alias("h2"),
                           F.sum("n").over(inside).alias("n"))
    return running.join(carried, ["conv", "seg"]).select(
        "conv", "at", F.col("h1").bitwiseXOR(F.col("b_h1")).alias("h1"),
        F.col("h2").bitwiseXOR(F.col("b_h2")).alias("h2"), (F.col("n") + F.col("b_n")).alias("n"))


def maximal(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The conversations (column conv) that are prefix of no other; of equal ones that of the least id."""
    found = stored(prefixes(turns, segment), "chat-prefixes")
    last = found.groupBy("conv").agg(F.max("at").alias("at"))
    whole = found.join(last, ["conv", "at"]).groupBy("h1", "h2", "n").agg(F.min("conv").alias("conv"))
    inner = (found.join(last.select("conv", F.col("at").alias("end")), "conv").where(F.col("at") < F.col("end"))
             .select("h1", "h2", "n").distinct())
    return whole.join(inner, ["h1", "h2", "n"], "left_anti").select("conv")


def render(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, part (from 0), n_turns and text of each segment of each conversation."""
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE), F.coalesce("text", F.lit("")), F.lit(END))
    parts = turns.withColumn("seg", _segment(F.col("at"), segment)).groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "text", line.alias("line")))).alias("lines"))
    number = F.row_number().over(Window.partitionBy("conv").orderBy("seg")) - 1
    return parts.select(F.col("conv.id").alias("conv_id"), number.cast("long").alias("part"),
                        F.size("lines").cast("long").alias("n_turns"),
                        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


def format_chats(log: DataFrame, segment: int = SEGMENT, **columns: str) -> DataFrame:
    turns = turns_of(log, **columns)
    return render(turns.join(maximal(turns, segment), "conv", "left_semi"), segment)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list([coalesce(turn::VARCHAR, ''), coalesce('r' || role, 'n'), coalesce('t' || text, 'n')]
        ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS x, max(turn) AS last_turn FROM r GROUP BY conv_id),
p AS (SELECT DISTINCT list([coalesce(b.turn::VARCHAR, ''), coalesce('r' || b.role, 'n'), coalesce('t' || b.text, 'n')]
        ORDER BY b.turn NULLS FIRST, b.role NULLS FIRST, b.text NULLS FIRST) AS x
      FROM (SELECT DISTINCT conv_id, turn FROM r) a JOIN c USING (conv_id) JOIN r b ON a.conv_id = b.conv_id AND b.turn <= a.turn
      WHERE a.turn < c.last_turn GROUP BY a.conv_id, a.turn),
k AS (SELECT min(conv_id) AS conv_id FROM c ANTI JOIN p USING (x) GROUP BY x),
s AS (SELECT conv_id, turn // 1024 AS seg, count(*) AS n_turns,
        string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), ''
                   ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS text
      FROM r SEMI JOIN k USING (conv_id) GROUP BY conv_id, turn // 1024)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seg) - 1 AS part, n_turns, text FROM s"""
