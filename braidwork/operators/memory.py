"""Conversation memory: windows over an append-only log (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.text import preview, strip

CONTEXT, AUDIT, AUDIT_CHARS = 20, 3, 4096
QUIT = ("quit", "exit", "q")


def _by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def context_window(messages: DataFrame, n: int = CONTEXT) -> DataFrame:
    """The last n messages of each conversation, with pos from 1 in order; none for n of 0 or less."""
    last = messages.withColumn("_back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_back") <= max(n, 0))
    return last.withColumn("pos", F.row_number().over(_by_turn()).cast("long")).drop("_back")


def context_at_each_turn(messages: DataFrame, n: int = CONTEXT) -> DataFrame:
    """Each message with `context`: the last n messages up to it, itself included, as structs."""
    return messages.withColumn("context", F.collect_list(F.struct("turn", "role", "text")).over(_by_turn().rowsBetween(-(n - 1), 0)))


def running_count(messages: DataFrame) -> DataFrame:
    """Each message with n_messages and n_chars of its conversation so far."""
    sofar = _by_turn().rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("n_messages", F.count("*").over(sofar)).withColumn("n_chars", F.sum(F.length("text")).over(sofar))


def history(messages: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """conv_id, turn, role, text of the stored roles; order by conv_id and turn to read it."""
    return messages.where(F.col("role").isin(*roles)).select("conv_id", "turn", "role", "text")


def audit_log(messages: DataFrame, last: int = AUDIT, chars: int = AUDIT_CHARS) -> DataFrame:
    """Each message with `audit`: the last messages as a JSON list of role and content, cut to a length; nulls stay nulls."""
    said = F.collect_list(F.struct(F.col("role").alias("role"), F.col("text").alias("content"))).over(_by_turn().rowsBetween(-(last - 1), 0))
    return messages.select("conv_id", "turn", preview(F.to_json(said, {"ignoreNullFields": "false"}), chars).alias("audit"))


def next_turn(finished: DataFrame, utterances: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, messages) for the next turn: the messages a run ended with and what the user says then (run, text).

    A run without earlier messages starts with the utterance; runs without an
    utterance do not go on.
    """
    kind = dict(finished.dtypes)["messages"]
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(None).alias("blocks"))).cast(kind)
    return utterances.join(finished.select(run, "messages"), run, "left").select(run, F.concat(F.coalesce("messages", F.array().cast(kind)), said).alias("messages"))


def accepted_input(utterances: DataFrame) -> DataFrame:
    """Stripped, non-blank utterances (conv_id, turn, text) before the first that asks to quit."""
    tidy = utterances.withColumn("text", strip(F.col("text")))
    quits = F.min(F.when(F.lower("text").isin(*QUIT), F.col("turn"))).over(Window.partitionBy("conv_id"))
    return tidy.withColumn("_quit", quits).where((F.col("text") != "") & (F.col("_quit").isNull() | (F.col("turn") < F.col("_quit")))).drop("_quit")


def prompt_context(chunks: DataFrame) -> DataFrame:
    """(qid, rag_context) from retrieved chunks (qid, rk, source, heading, text), in order of rank."""
    item = F.concat(F.lit("["), "source", F.lit(" / "), "heading", F.lit("]\n"), "text")
    return chunks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", item.alias("item")))).alias("items")).select("qid", F.array_join(F.transform("items", lambda x: x["item"]), "\n---\n").alias("rag_context"))


def or_empty(history_column: Column) -> Column:
    """An absent history as an empty one."""
    return F.coalesce(history_column, F.array().cast("array<struct<role:string,content:string>>"))
