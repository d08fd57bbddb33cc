"""Agent-run analytics: call resolution, termination, tokens, tool lists, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ITERATIONS = 10
FAILED = "Error executing tool"


def not_found(tool: Column) -> Column:
    """The error text for a tool that is not among the candidates."""
    return F.concat(F.lit("Tool '"), F.coalesce(tool, F.lit("None")), F.lit("' not found in registry."))


def resolve_calls(calls: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Every call with is_error and error: one whose tool is not among its candidates is an error row.

    Candidates are those of the call's turn, so a tool that is registered but
    was not retrieved is missing too.  The join is by key; Spark chooses how.
    """
    known = candidates.select(*keys).distinct().withColumn("_found", F.lit(True))
    out = calls.join(known, keys, "left").withColumn("is_error", F.col("_found").isNull()).drop("_found")
    return out.withColumn("error", F.when(F.col("is_error"), not_found(F.col(keys[-1]).cast("string"))))


def correlate(calls: DataFrame, results: DataFrame, call_id: str = "call_id", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Calls with the result that answers each by its id within a run; calls without an answer keep nulls.

    results: keys, call_id, result and is_error; the first of several answers
    counts, by is_error then result.
    """
    on = [*keys, call_id]
    first = results.groupBy(*on).agg(F.min(F.struct("is_error", "result")).alias("answer"))
    return calls.join(first, on, "left").select(*calls.columns, F.col("answer.result").alias("result"), F.col("answer.is_error").alias("is_error"))


def result_text(tool: Column, result: Column, failure: Column) -> Column:
    """A call's result, or its failure as a result text."""
    return F.when(failure.isNotNull(), F.concat(F.lit(f"{FAILED} '"), tool, F.lit("': "), failure)).otherwise(result)


def has_failed(result: Column) -> Column:
    return F.coalesce(result.startswith(FAILED), F.lit(False))


def terminate(steps: DataFrame, cap: int = MAX_ITERATIONS, run: str = "run_id") -> DataFrame:
    """run, status, iterations from steps (run, iteration from 0, stop_reason).

    A run completes at its first `end_turn` below the cap; otherwise it reaches
    the cap, or is open where its steps end before.
    """
    inside = steps.where(F.col("iteration") < cap)
    done = F.min(F.when(F.col("stop_reason") == "end_turn", F.col("iteration")))
    return inside.groupBy(run).agg(done.alias("done"), F.count("*").alias("n")).select(
        run, F.when(F.col("done").isNotNull(), "completed").when(F.col("n") >= cap, "max_iterations").otherwise("open").alias("status"), F.coalesce(F.col("done") + 1, F.col("n")).cast("long").alias("iterations"))


def is_final(finish_reason: Column, tool_calls: Column) -> Column:
    """An answer is final unless it stops for tool calls and has some; without a reason it is final."""
    return ~(F.coalesce(finish_reason == "tool_calls", F.lit(False)) & F.coalesce(tool_calls.isNotNull() & (F.size(tool_calls) > 0), F.lit(False)))


def total_tokens(rounds: DataFrame, by: str) -> DataFrame:
    """Tokens of each turn's rounds; rounds without usage count nothing."""
    return rounds.groupBy(by).agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"))


def tools_called(calls: DataFrame, by: str) -> DataFrame:
    """Names of the tools called, in order and with repeats, as a JSON list; attempts count."""
    return calls.groupBy(by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tool"))), lambda x: x["tool"])).alias("tools"))


def ledger(calls: DataFrame, key: str = "idempotency_key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The first call of each idempotency key, with the number of attempts."""
    first = F.min_by(F.struct(*[c for c in calls.columns if c != key]), F.struct(*order))
    return calls.groupBy(key).agg(first.alias("first"), F.count("*").alias("attempts")).select(key, "first.*", "attempts")


def cap_rounds(rounds: DataFrame, run: str, order: str, cap: int = MAX_ITERATIONS) -> DataFrame:
    """The first `cap` rounds of each run, with iteration from 0."""
    return rounds.withColumn("iteration", (F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1).cast("long")).where(F.col("iteration") < cap)
