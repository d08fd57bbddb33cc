"""Spans of the engine's own work: agent runs, handled messages, retrieval, memory, device state.

Each function takes the log tables of that work and returns spans (trace_id,
span_id, parent_id, name, start_ts, end_ts, attributes, status), for the
operators of spans.py.  Span names and attribute keys are fixed values.  A
trace is a run or a message; span ids number its steps: 0 is the root, a round
has ROUND ids, its model call the first after its own, then its tool calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUND = 10_000
QUERY_CHARS, PREVIEW_CHARS, RESULT_CHARS = 512, 200, 1024
COLUMNS = ("trace_id", "span_id", "parent_id", "name", "start_ts", "end_ts", "attributes", "status")


def attributes(**values: Column) -> Column:
    """A map of the attributes that have a value; __ stands for a dot in a key."""
    every = F.map_from_arrays(F.array(*(F.lit(k.replace("__", ".")) for k in values)), F.array(*(v.cast("string") for v in values.values())))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def _span(trace: Column, span: Column, parent: Column, name: Column, start: Column, end: Column, values: Column, status: Column | None = None) -> list[Column]:
    status = F.when(end.isNull(), "UNSET").otherwise("OK") if status is None else status
    made = (trace.cast("long"), span.cast("long"), parent.cast("long"), name, start.cast("timestamp"), end.cast("timestamp"), values, status)
    return [c.alias(n) for c, n in zip(made, COLUMNS, strict=True)]


def run_spans(runs: DataFrame, rounds: DataFrame, calls: DataFrame) -> DataFrame:
    """Spans of agent runs.

    runs: run_id, query, status, iterations, start_ts, end_ts.  rounds: run_id,
    iteration, stop_reason, start_ts, end_ts, and llm_end_ts, when the model
    had answered.  calls: run_id, iteration, call_no, tool_name, arguments,
    result, start_ts, end_ts.  A run that reached the cap is an error.
    """
    c, at = F.col, (F.col("iteration") + 1) * ROUND
    root = runs.select(*_span(c("run_id"), F.lit(0), F.lit(None), F.lit("orchestrator.run"), c("start_ts"), c("end_ts"), attributes(query=c("query"), iterations=c("iterations")),
                              F.when(c("end_ts").isNull(), "UNSET").when(c("status") == "max_iterations", "ERROR").otherwise("OK")))
    each = rounds.select(*_span(c("run_id"), at, F.lit(0), F.concat(F.lit("iteration."), c("iteration").cast("string")), c("start_ts"), c("end_ts"), attributes(none=F.lit(None))))
    model = rounds.select(*_span(c("run_id"), at + 1, at, F.lit("llm.complete"), c("start_ts"), c("llm_end_ts"), attributes(stop_reason=c("stop_reason"))))
    tools = calls.select(*_span(c("run_id"), at + 2 + c("call_no"), at, F.concat(F.lit("tool."), c("tool_name")), c("start_ts"), c("end_ts"),
                                attributes(arguments=c("arguments"), result_preview=F.left("result", F.lit(PREVIEW_CHARS)))))
    return root.unionByName(each).unionByName(model).unionByName(tools)


def message_spans(messages: DataFrame, rounds: DataFrame, calls: DataFrame) -> DataFrame:
    """Spans of handled messages.

    messages: message_id, query, response, total_tokens, tools_called (a JSON
    list), start_ts, end_ts.  rounds: message_id, round, model, tokens,
    start_ts, end_ts.  calls: message_id, round, call_no, tool_name, arguments,
    result, error, start_ts, end_ts.  A call with an error has status ERROR.
    """
    c, at = F.col, (F.col("round") + 1) * ROUND
    root = messages.select(*_span(c("message_id"), F.lit(0), F.lit(None), F.lit("agent.handle_message"), c("start_ts"), c("end_ts"), attributes(
        user__query=F.left("query", F.lit(QUERY_CHARS)), agent__response=F.left("response", F.lit(QUERY_CHARS)), agent__total_tokens=c("total_tokens"), agent__tools_called=c("tools_called"))))
    model = rounds.select(*_span(c("message_id"), at, F.lit(0), F.lit("agent.llm_call"), c("start_ts"), c("end_ts"), attributes(llm__model=c("model"), llm__round=c("round"), llm__tokens__total=c("tokens"))))
    tools = calls.select(*_span(c("message_id"), at + 1 + c("call_no"), F.lit(0), F.lit("agent.mcp_tool_call"), c("start_ts"), c("end_ts"), attributes(
        tool__name=c("tool_name"), tool__args=c("arguments"), tool__result=F.left("result", F.lit(RESULT_CHARS)), tool__error=c("error")), F.when(c("error").isNotNull(), "ERROR").otherwise("OK")))
    return root.unionByName(model).unionByName(tools)


def retrieval_spans(asked: DataFrame, found: DataFrame) -> DataFrame:
    """rag.retrieve for each query (qid, query, start_ts, end_ts) with what was found (qid, score): a trace of one span each."""
    top = found.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    c = F.col
    return asked.join(top, "qid", "left").select(*_span(c("qid"), F.lit(0), F.lit(None), F.lit("rag.retrieve"), c("start_ts"), c("end_ts"), attributes(
        rag__query=F.left("query", F.lit(QUERY_CHARS)), rag__documents_retrieved=F.coalesce("n", F.lit(0)), rag__top_score=c("top"))))


def memory_spans(counted: DataFrame, window: int) -> DataFrame:
    """memory.add_message and memory.get_context_window for each message (conv_id, turn, role, text, n_messages, ts) of memory.running_count."""
    c = F.col
    add = counted.select(*_span(c("conv_id"), c("turn") * 2, F.lit(None), F.lit("memory.add_message"), c("ts"), c("ts"), attributes(
        memory__role=c("role"), memory__content_length=F.length(F.coalesce("text", F.lit(""))), memory__total_messages=c("n_messages"))))
    read = counted.select(*_span(c("conv_id"), c("turn") * 2 + 1, F.lit(None), F.lit("memory.get_context_window"), c("ts"), c("ts"), attributes(
        memory__window_size=F.least(c("n_messages"), F.lit(max(window, 0))), memory__total_messages=c("n_messages"))))
    return add.unionByName(read)


def state_spans(requests: DataFrame) -> DataFrame:
    """mcp.<tool> for each device request (seq, tool, room, door, value, status, current, target, error, ts); one with an error text has status ERROR."""
    c = F.col
    return requests.select(*_span(c("seq"), F.lit(0), F.lit(None), F.concat(F.lit("mcp."), c("tool")), c("ts"), c("ts"), attributes(
        room=c("room"), door=c("door"), value=c("value"), temperature__current=c("current"), temperature__target=c("target"),
        door__status=F.when(c("tool") == "get_door_status", c("status")), status=F.when(c("tool") == "set_door_status", c("status")), door__new_status=F.when((c("tool") == "set_door_status") & c("error").isNull(), c("status"))),
        F.when(c("error").isNotNull(), "ERROR").otherwise("OK")))
