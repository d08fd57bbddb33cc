"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation many times, once for each turn it grew by.
Every turn gets the rolling hash of the conversation up to it; a conversation
whose whole hash is a shorter prefix of another one, or equals that of one
with a smaller id, is a snapshot and goes by an anti-join.  What is left is
rendered as training text.

How it scales.  A turn's hash mixes its place, role and text into 128 bits,
and the rolling hash is the exclusive or of them, so it needs running sums
over 32-byte rows: texts are not shuffled for it.  Turns are ordered over the
whole table by range, and a conversation of any size lies in as many ranges as
it fills: places and hashes are summed inside a range, and what the ranges
before it add is a row for each range.  So a conversation with a third of all
turns is as many tasks' work as its share.  Prefixes are made distinct before
the join with map-side aggregation, so a first turn that a third of all
conversations share is one row a task, and the anti-join reads each distinct
prefix once.  Only turns of kept conversations shuffle text, and long ones are
rendered in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.scratch import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART_TURNS = 10_000


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, tie, ...) with range, place (from 1) and n_turns of the conversation.

    The order is that of turn, nulls first, then role, then tie; equal rows
    may come in any order.
    """
    within = [F.col("turn").asc_nulls_first(), "role", "tie", "own"]
    spread = turns.withColumn("own", F.monotonically_increasing_id()).repartitionByRange("conv_id", *within)
    ranged = cut(spread.withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("conv_id")
    before = counts.select("conv_id", "range", (F.sum("c").over(whole.orderBy("range")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n_turns"))
    here = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*within))
    return ranged.join(before, ["conv_id", "range"]).withColumn("place", here + F.col("before")).drop("own", "before")


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, place, n_turns, a, b: the rolling hash up to each turn (its place counts from 1)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("tie"), F.xxhash64(F.lit(1), role, text).alias("x"), F.xxhash64(F.lit(2), text, role).alias("y"))
    each = cut(numbered(turns).select("conv_id", "range", "place", "n_turns", F.xxhash64("place", "x", "y").alias("a"), F.xxhash64("y", "place", "x").alias("b")))
    sofar = Window.partitionBy("conv_id", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = each.groupBy("conv_id", "range").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = ranges.select("conv_id", "range", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("a", "b")))
    return each.join(before, ["conv_id", "range"]).select("conv_id", "place", "n_turns", *(F.bit_xor(c).over(sofar).bitwiseXOR(F.col(f"before_{c}")).alias(c) for c in ("a", "b")))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no snapshot of another."""
    every = prefixes(conversations)
    key = ["place", "a", "b"]
    whole = every.where("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = every.where("place < n_turns").select(*key).distinct()
    return whole.join(shorter, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_parts, n_turns, n_copies, rendered: the maximal conversations.

    Turns are in order of turn, then role, then text digest; a null turn comes
    first, null roles and texts are empty strings.  Turns without conv_id
    belong to no conversation.  A repeated row is a turn of its own.  n_turns
    and n_copies are those of the conversation: n_copies counts the
    conversations with exactly these turns, of which the smallest conv_id
    stays.  One form holds for every size: a row is a part of a conversation,
    of part_turns turns at most, as a row must fit in memory, and a
    conversation is its n_parts parts in order, part 0 on.  Other columns are
    not read.
    """
    kept = maximal(conversations)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("tie"), text.alias("text"))
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    lines = numbered(turns.join(kept.drop("n_turns"), "conv_id")).select("conv_id", "n_turns", "n_copies", line.alias("line"), (F.col("place") - 1).alias("at"))
    parts = lines.groupBy("conv_id", F.floor(F.col("at") / part_turns).cast("int").alias("part"), "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    return parts.select("conv_id", "part", F.ceil(F.col("n_turns") / part_turns).cast("int").alias("n_parts"), F.col("n_turns").cast("int").alias("n_turns"), "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


ORACLE = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
  '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS line, string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text) ROWS UNBOUNDED PRECEDING) AS s
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
whole AS (SELECT place, s, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n GROUP BY place, s),
kept AS (SELECT conv_id, place AS n_turns, n_copies FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place = whole.place AND p.s = whole.s AND p.place < p.n))
SELECT conv_id, CAST((place - 1) // {PART_TURNS} AS INTEGER) AS part, CAST((n_turns + {PART_TURNS - 1}) // {PART_TURNS} AS INTEGER) AS n_parts, CAST(n_turns AS INTEGER) AS n_turns, n_copies, string_agg(line, '' ORDER BY place) AS rendered
FROM kept JOIN p USING (conv_id) GROUP BY ALL"""
