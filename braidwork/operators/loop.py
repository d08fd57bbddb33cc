"""The bounded agent loop, for all open runs at once.

A round is a few DataFrame steps over the runs that are still open: complete,
resolve the tool calls against each run's candidates, execute those found,
append the results.  Rounds are written, so each costs its own work only; a
run leaves as soon as it has its answer.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.payload import BLOCK, extract_text, tool_uses
from braidwork.operators.agent import FAILED, MAX_ITERATIONS, correlate, not_found
from braidwork.session import written

#: A message's text, and its content blocks: what the model said, or results by the id of their call.
PART = "struct<type:string,text:string,id:string,name:string,input:string,is_error:boolean>"
MESSAGES = f"array<struct<role:string,content:string,blocks:array<{PART}>>>"
#: Fixed value: the answer of a run that did not end.
GAVE_UP = "[Error] Max tool-call iterations reached. Partial response may be incomplete."


class Runs(NamedTuple):
    """What the runs came to, the calls that were executed, and the rounds."""

    results: DataFrame
    calls: DataFrame
    rounds: DataFrame


def _messages(column, kind: str):
    """Messages with blocks; those without get none."""
    empty = F.array().cast(MESSAGES)
    if "blocks" in kind:
        return F.coalesce(column, empty).cast(MESSAGES)
    return F.coalesce(F.transform(column, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast(f"array<{PART}>").alias("blocks"))), empty)


def run_agents(runs: DataFrame, candidates: DataFrame, complete: Callable[[DataFrame], DataFrame], execute: Callable[[DataFrame], DataFrame], cap: int = MAX_ITERATIONS,
               retrieve: Callable[[DataFrame], DataFrame] | None = None, search_tool: str = "search_tools") -> Runs:
    """Runs (run_id, messages) with candidate tools (run_id, tool_name, endpoint_url), to their answers or the cap.

    complete takes open runs (run_id, iteration, messages) and adds stop_reason
    and blocks (an array of content blocks); execute takes calls (tool_name,
    endpoint_url, arguments, ...) and adds result and failed.  retrieve, if
    given, answers calls of `search_tool`: it takes them (run_id, arguments)
    and returns further candidates (run_id, tool_name, endpoint_url), which
    count from the next round on.

    results: run_id, status (completed or max_iterations), iterations, response,
    messages: the whole history, the answer included, to go on from (see
    memory.next_turn).  calls: run_id, iteration, call_no, call_id, tool_name,
    arguments, result, failed, for the calls that were executed; one whose tool
    is no candidate is answered by an error and not logged.  rounds: run_id,
    iteration, stop_reason.  The rounds run when this is called.
    """
    kind = dict(runs.dtypes)["messages"]
    opened = written(runs.select("run_id", F.lit(0).alias("iteration"), _messages(F.col("messages"), kind).alias("messages")))
    known = candidates.select("run_id", "tool_name", "endpoint_url")
    finished: list[DataFrame] = []
    logged: list[DataFrame] = []
    told_all: list[DataFrame] = []
    block = F.col("block")
    for i in range(cap):
        if opened.isEmpty():
            break
        told = written(complete(opened.withColumn("iteration", F.lit(i))).withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>"))))
        told_all.append(told.select("run_id", F.lit(i).alias("iteration"), "stop_reason"))
        ended = F.coalesce(F.col("stop_reason") == "end_turn", F.lit(False))
        parts = F.transform("blocks", lambda b: F.struct(*(b[x].alias(x) for x in ("type", "text", "id", "name", "input")), F.lit(None).cast("boolean").alias("is_error")))
        told = told.withColumn("messages", F.concat("messages", F.array(F.struct(F.lit("assistant").alias("role"), extract_text(F.col("blocks")).alias("content"), parts.alias("blocks")))).cast(MESSAGES))
        finished.append(told.where(ended).select("run_id", F.lit("completed").alias("status"), F.lit(i + 1).alias("iterations"), extract_text(F.col("blocks")).alias("response"), "messages"))
        asked = told.where(~ended).select("run_id", F.posexplode(tool_uses(F.col("blocks"))).alias("call_no", "block")).select(
            "run_id", F.lit(i).alias("iteration"), "call_no", block["id"].alias("call_id"), block["name"].alias("tool_name"), F.coalesce(block["input"], F.lit("{}")).alias("arguments"))
        matched = written(asked.join(known.distinct().withColumn("known", F.lit(True)), ["run_id", "tool_name"], "left"))
        searches = matched.where(F.col("tool_name") == search_tool) if retrieve else matched.limit(0)
        done = written(execute(matched.where("known" if not retrieve else f"known and tool_name <> '{search_tool}'").drop("known")))
        logged.append(done.select("run_id", "iteration", "call_no", "call_id", "tool_name", "arguments", "result", "failed"))
        answers = done.select("run_id", "call_no", "call_id", "result", F.lit(None).cast("boolean").alias("is_error"))
        missing = matched.where("known is null" if not retrieve else f"known is null and not tool_name <=> '{search_tool}'")
        answers = answers.unionByName(missing.select("run_id", "call_no", "call_id", not_found(F.col("tool_name")).alias("result"), F.lit(True).alias("is_error")))
        if retrieve:
            more = written(retrieve(searches.select("run_id", "arguments")).select("run_id", "tool_name", "endpoint_url"))
            known = known.unionByName(more).distinct()
            names = more.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_set("tool_name"))).alias("result"))
            answers = answers.unionByName(searches.select("run_id", "call_no", "call_id").join(names, "run_id", "left").select("run_id", "call_no", "call_id", F.coalesce("result", F.lit("[]")).alias("result"), F.lit(None).cast("boolean").alias("is_error")))
        own = F.struct("call_no", F.lit("tool_result").alias("type"), F.col("result").alias("text"), F.col("call_id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input"), "is_error")
        said = answers.groupBy("run_id").agg(F.array_sort(F.collect_list(own)).alias("answers"))
        results = F.transform(F.coalesce("answers", F.array()), lambda a: F.struct(*(a[x].alias(x) for x in ("type", "text", "id", "name", "input", "is_error"))))
        reply = F.struct(F.lit("user").alias("role"), F.array_join(F.transform(results, lambda a: a["text"]), "\n").alias("content"), results.alias("blocks"))
        opened = written(told.where(~ended).join(said, "run_id", "left").select("run_id", "iteration", F.concat("messages", F.array(reply)).cast(MESSAGES).alias("messages")))
    finished.append(opened.select("run_id", F.lit("max_iterations").alias("status"), F.lit(cap).alias("iterations"), F.lit(GAVE_UP).alias("response"), "messages"))

    def every(frames: list[DataFrame], schema: str) -> DataFrame:
        out = runs.sparkSession.createDataFrame([], schema)
        for f in frames:
            out = out.unionByName(f)
        return out

    run_id = f"run_id {dict(runs.dtypes)['run_id']}"
    calls = every(logged, f"{run_id}, iteration int, call_no int, call_id string, tool_name string, arguments string, result string, failed boolean")
    return Runs(every(finished, f"{run_id}, status string, iterations int, response string, messages {MESSAGES}"), calls.withColumn("failed", F.coalesce("failed", F.col("result").startswith(FAILED))),
                every(told_all, f"{run_id}, iteration int, stop_reason string"))


def answered_calls(results: DataFrame) -> DataFrame:
    """(run_id, call_id, tool_name, arguments, result, is_error): the calls in the runs' messages, each with the result that carries its id."""
    parts = results.select("run_id", F.explode("messages").alias("m")).select("run_id", F.explode("m.blocks").alias("b"))
    calls = parts.where("b.type = 'tool_use'").select("run_id", F.col("b.id").alias("call_id"), F.col("b.name").alias("tool_name"), F.col("b.input").alias("arguments"))
    given = parts.where("b.type = 'tool_result'").select("run_id", F.col("b.id").alias("call_id"), F.col("b.text").alias("result"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))
    return correlate(calls, given)
