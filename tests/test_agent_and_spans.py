import datetime as dt
import http.server
import json
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions import payload
from braidwork.operators import agent, catalog, spans, telemetry
from braidwork.sources import files, providers

T0 = dt.datetime(2024, 1, 1)
SPAN = "trace_id long, span_id long, parent_id long, name string, start_ts timestamp, end_ts timestamp, attributes map<string,string>, status string"


def span(i, parent, start=0, end=None, name=None, status="OK"):
    return (1, i, parent, name or f"s{i}", T0 + dt.timedelta(milliseconds=start), None if end is None else T0 + dt.timedelta(milliseconds=end), {"k": "v"}, status)


def test_tree_of_a_deep_chain_and_orphans(spark):
    rows = [span(i, i - 1 if i else None) for i in range(150)] + [span(500, 499), span(501, 500)]
    got = {r.span_id: r for r in spans.tree(spark.createDataFrame(rows, SPAN)).collect()}
    assert got[149].depth == 149 and got[149].root_id == 0 and got[149].path == "/".join(map(str, range(150)))
    assert (got[501].depth, got[501].root_id, got[501].path) == (1, 500, "500/501")


def test_cycles_are_an_error(spark):
    for rows in ([span(1, 2), span(2, 1)], [span(1, 1)], [span(0, None), span(9, 0), *(span(i, i % 5 + 1) for i in range(1, 6)), span(7, 3)]):
        with pytest.raises(ValueError, match="cycle"):
            spans.tree(spark.createDataFrame(rows, SPAN))


def test_traces_that_share_ids(spark):
    rows = [(t, *span(i, None if i == 1 else 1, i, name=f"{t}.{i}")[1:]) for t in (7, 8) for i in (1, 2)]
    df = spark.createDataFrame(rows, SPAN)
    assert sorted((r.trace_id, r.span_id, r.path) for r in spans.tree(df).collect()) == [(7, 1, "1"), (7, 2, "1/2"), (8, 1, "1"), (8, 2, "1/2")]
    assert sorted((r.trace_id, r.parent_id, r.children) for r in spans.children(df).collect()) == [(7, 1, ["7.2"]), (8, 1, ["8.2"])]
    assert {r.trace_id: json.loads(r.trace)["children"][0]["name"] for r in spans.trace_json(df).collect()} == {7: "7.2", 8: "8.2"}


def test_a_deep_trace_as_json(spark):
    rows = [span(i, i - 1 if i else None, i) for i in range(60)] + [span(100 + i, i, 1000 + i) for i in range(60)]
    (row,) = spans.trace_json(spark.createDataFrame(rows, SPAN)).collect()
    at, depth = json.loads(row.trace), 0
    while at["children"]:
        assert [c["name"] for c in at["children"]] in ([f"s{depth + 1}", f"s{100 + depth}"], [f"s{100 + depth}"])
        at, depth = at["children"][0], depth + 1
    assert depth == 60


def test_export(spark):
    df = spark.createDataFrame([span(10, 1, 0, 2)], SPAN)
    assert spans.with_resource(df).first().resource == {"service.name": "home-agent"}
    got = json.loads(spans.export_lines(df).first().value)
    assert got["span"]["spanId"] == "000000000000000a" and got["span"]["attributes"] == [{"key": "k", "value": {"stringValue": "v"}}]
    assert int(got["span"]["endTimeUnixNano"]) - int(got["span"]["startTimeUnixNano"]) == 2_000_000 and got["resource"]["attributes"][0]["key"] == "service.name"


def test_spans_of_runs_and_messages(spark):
    ts = "start_ts timestamp, end_ts timestamp"
    t = [T0 + dt.timedelta(seconds=i) for i in range(9)]
    runs = spark.createDataFrame([(1, "q", "completed", 2, t[0], t[8]), (2, "r", "max_iterations", 10, t[0], t[1])], f"run_id long, query string, status string, iterations int, {ts}")
    rounds = spark.createDataFrame([(1, 0, "tool_use", t[0], t[4], t[1]), (1, 1, "end_turn", t[5], t[8], t[7])], f"run_id long, iteration int, stop_reason string, {ts}, llm_end_ts timestamp")
    calls = spark.createDataFrame([(1, 0, 0, "a", "{}", "x" * 300, t[1], t[2])], f"run_id long, iteration int, call_no int, tool_name string, arguments string, result string, {ts}")
    got = telemetry.run_spans(runs, rounds, calls)
    by = {(r.trace_id, r.name): r for r in got.collect()}
    assert by[2, "orchestrator.run"].status == "ERROR" and by[1, "orchestrator.run"].attributes == {"query": "q", "iterations": "2"}
    assert len(by[1, "tool.a"].attributes["result_preview"]) == 200 and by[1, "llm.complete"].attributes["stop_reason"] in ("tool_use", "end_turn")
    tree = json.loads(spans.trace_json(got.where("trace_id = 1")).first().trace)
    assert [c["name"] for c in tree["children"]] == ["iteration.0", "iteration.1"] and [c["name"] for c in tree["children"][0]["children"]] == ["llm.complete", "tool.a"]
    messages = spark.createDataFrame([(1, "q" * 600, "a", 7, '["f"]', t[0], t[3])], f"message_id long, query string, response string, total_tokens int, tools_called string, {ts}")
    model = spark.createDataFrame([(1, 0, "m", 7, t[0], t[1])], f"message_id long, round int, model string, tokens int, {ts}")
    used = spark.createDataFrame([(1, 0, 0, "f", "{}", None, "down", t[1], t[2])], f"message_id long, round int, call_no int, tool_name string, arguments string, result string, error string, {ts}")
    got = {r.name: r for r in telemetry.message_spans(messages, model, used).collect()}
    assert len(got["agent.handle_message"].attributes["user.query"]) == 512 and got["agent.llm_call"].attributes == {"llm.model": "m", "llm.round": "0", "llm.tokens.total": "7"}
    assert got["agent.mcp_tool_call"].status == "ERROR" and got["agent.mcp_tool_call"].attributes == {"tool.name": "f", "tool.args": "{}", "tool.error": "down"}
    asked = spark.createDataFrame([(1, "q", t[0], t[1]), (2, "r", t[0], t[1])], f"qid long, query string, {ts}")
    found = spark.createDataFrame([(1, 0.5), (1, 0.75)], "qid long, score double")
    assert {r.trace_id: r.attributes for r in telemetry.retrieval_spans(asked, found).collect()} == {
        1: {"rag.query": "q", "rag.documents_retrieved": "2", "rag.top_score": "0.75"}, 2: {"rag.query": "r", "rag.documents_retrieved": "0"}}
    device = spark.createDataFrame([(1, "set_door_status", None, "garage", None, "open", None, None, None, t[0]), (2, "get_temperature", "attic", None, None, None, None, None, "Unknown room", t[0])],
                                   "seq long, tool string, room string, door string, value double, status string, current double, target double, error string, ts timestamp")
    got = {r.trace_id: r for r in telemetry.state_spans(device).collect()}
    assert got[1].attributes == {"door": "garage", "status": "open", "door.new_status": "open"} and got[1].name == "mcp.set_door_status" and got[2].status == "ERROR"


def test_results_by_id(spark):
    calls = spark.createDataFrame([(1, "x", "a"), (1, "y", "b"), (2, "x", "c")], "run_id long, call_id string, tool string")
    results = spark.createDataFrame([(1, "x", "one", False), (1, "x", "two", True), (2, "x", "three", False)], "run_id long, call_id string, result string, is_error boolean")
    assert sorted((r.tool, r.result, r.is_error) for r in agent.correlate(calls, results).collect()) == [("a", "one", False), ("b", None, None), ("c", "three", False)]


def test_catalogues_and_vectors_grow(spark, tmp_path):
    path = f"file://{tmp_path}/tools"
    files.append_rows(catalog.catalog(spark, [{"name": "a", "description": "x"}]), path)
    new = catalog.catalog(spark, [{"name": "b", "description": "y"}, {"name": "a", "description": "z"}, {"name": "b", "description": "w"}])
    more, rejected = catalog.append(spark.read.parquet(path), new)
    assert sorted((r.name, r.error) for r in rejected.collect()) == [("a", "Tool with name 'a' already exists."), ("b", "Tool with name 'b' already exists.")]
    files.append_rows(more, path)
    assert sorted((r.ord, r.name, r.description) for r in spark.read.parquet(path).collect()) == [(0, "a", "x"), (1, "b", "y")]
    with pytest.raises(ValueError, match="other columns"):
        files.append_rows(spark.range(2), path)


def test_lines_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello\nquit\n")
    lines = files.follow_lines(spark, f"file://{tmp_path}/in")
    query = files.append_stream(lines.select("conv_id", "source", "text"), f"file://{tmp_path}/out", f"file://{tmp_path}/progress")
    query.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text("again\n")
    query.processAllAvailable()
    query.stop()
    assert sorted((r.source, r.text) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("a.txt", "hello"), ("a.txt", "quit"), ("b.txt", "again")]
    shown = files.show_stream(lines)
    shown.processAllAvailable()
    shown.stop()
    assert shown.exception() is None
    assert files.stamped(spark.range(1)).first().ingested_ts is not None


def test_posting_to_a_server():
    class Echo(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(500 if self.path == "/down" else 200)
            self.end_headers()
            self.wfile.write(b"plain" if self.path == "/text" else json.dumps({"got": got, "type": self.headers["Content-Type"]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert providers.post_json(f"{base}/", {"a": 1}) == {"got": {"a": 1}, "type": "application/json"}
        assert providers.post_json(f"{base}/text", {}) == "plain"
        waits = []
        again = providers.Retrying(providers.post_json, attempts=3, trip=9, sleep=waits.append)
        with pytest.raises(OSError, match="500"):
            again(f"{base}/down", {})
        assert len(waits) == 2 and 0.2 <= waits[0] <= 0.4 <= waits[1]
    finally:
        server.shutdown()


def test_retries_breaker_and_rate():
    now, calls = [0.0], []

    def flaky(endpoint, arguments):
        calls.append(endpoint)
        if arguments.get("bad"):
            raise ValueError("bad arguments")
        if endpoint == "down" or len(calls) == 1:
            raise TimeoutError("slow")
        return "ok"

    def sleep(s):
        now[0] += s

    p = providers.Retrying(flaky, attempts=3, trip=4, rest=30, clock=lambda: now[0], sleep=sleep)
    assert p("up", {}) == "ok" and len(calls) == 2
    with pytest.raises(ValueError):
        p("up", {"bad": 1})
    assert len(calls) == 3  # not tried again
    for _ in range(2):
        with pytest.raises(TimeoutError):
            p("down", {})
    seen = len(calls)
    with pytest.raises(RuntimeError, match="left alone"):
        p("down", {})
    assert len(calls) == seen
    now[0] += 31
    with pytest.raises(TimeoutError):
        p("down", {})
    paced = providers.Retrying(lambda e, a: "ok", rate=2, clock=lambda: now[0], sleep=sleep)
    began = now[0]
    for _ in range(5):
        paced("x", {})
    assert now[0] - began == pytest.approx(2.0)


def test_durations(spark):
    df = spark.createDataFrame([span(1, None, 0, 1500.126), span(2, None, 5)], SPAN)
    assert [r[0] for r in df.select(spans.duration_ms(F.col("start_ts"), F.col("end_ts"))).collect()] == [1500.13, None]


def test_nested_trace(spark):
    df = spark.createDataFrame([span(1, None, 0, 9, "run"), span(2, 1, 2, 3, "b"), span(3, 1, 1, 2, "a"), span(4, 2, 2)], SPAN)
    (row,) = spans.trace_json(df).collect()
    tree = json.loads(row.trace)
    assert tree["name"] == "run" and tree["duration_ms"] == 9.0 and [c["name"] for c in tree["children"]] == ["a", "b"]
    assert tree["children"][1]["children"][0]["end_ts"] is None and tree["children"][0]["children"] == []
    assert spans.trace_json(df.limit(0)).count() == 0
    kids = {r.parent_id: (r.n_children, r.children) for r in spans.children(df).collect()}
    assert kids == {1: (2, ["a", "b"]), 2: (1, ["s4"])}


def test_stack_of_starts_and_ends(spark):
    marks = [("start", 1, "run"), ("start", 2, "it.0"), ("start", 3, "llm"), ("end", 3, None), ("start", 4, "tool"), ("end", 4, None), ("end", 2, None), ("start", 5, "it.1"), ("start", 6, "llm")]
    df = spark.createDataFrame([(1, q, kind, i, name, T0 + dt.timedelta(seconds=q), "ERROR" if (kind, i) == ("end", 4) else None) for q, (kind, i, name) in enumerate(marks)], "trace_id long, seq long, kind string, span_id long, name string, ts timestamp, status string")
    got = {r.span_id: (r.parent_id, r.status, r.end_ts is None) for r in spans.from_stack(df).collect()}
    assert got == {1: (None, "UNSET", True), 2: (1, "OK", False), 3: (2, "OK", False), 4: (2, "ERROR", False), 5: (1, "UNSET", True), 6: (5, "UNSET", True)}


def test_attributes_and_events(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}, "p" * 5000)], "x map<string,string>, y map<string,string>, t string")
    row = df.select(spans.set_attributes(F.col("x"), F.col("y")).alias("m"), spans.io_events(F.col("t"), F.lit("c")).alias("e")).first()
    assert row.m == {"a": "1", "b": "3", "c": "4"}
    assert [e.name for e in row.e] == ["llm.prompt", "llm.completion"] and len(row.e[0].attributes["llm.prompt"]) == 4096 and row.e[1].attributes == {"llm.completion": "c"}


def test_termination(spark):
    rows = [(1, i, "tool_use") for i in range(12)] + [(2, 0, "tool_use"), (2, 1, "end_turn")] + [(3, 0, "max_tokens")] + [(4, i, "end_turn" if i == 10 else "tool_use") for i in range(11)]
    got = {r.run_id: (r.status, r.iterations) for r in agent.terminate(spark.createDataFrame(rows, "run_id long, iteration long, stop_reason string")).collect()}
    assert got == {1: ("max_iterations", 10), 2: ("completed", 2), 3: ("open", 1), 4: ("max_iterations", 10)}


def test_final_answers(spark):
    df = spark.createDataFrame([("tool_calls", [1]), ("tool_calls", []), ("tool_calls", None), ("stop", [1]), ("length", None), (None, [1])], "f string, c array<int>")
    assert [r[0] for r in df.select(agent.is_final(F.col("f"), F.col("c"))).collect()] == [False, True, True, True, True, True]


def test_catalogue(spark):
    df = catalog.catalog(spark, [{"name": "a", "description": "x", "parameters": {"type": "object"}}, {"name": "b", "description": None}, {"name": "a", "description": "y"}])
    accepted, rejected = catalog.register(df)
    assert sorted(r.name for r in accepted.collect()) == ["a", "b"] and [(r.ord, r.error) for r in rejected.collect()] == [(2, "Tool with name 'a' already exists.")]
    assert sorted((r.name, r.description) for r in catalog.register_first(df).collect()) == [("a", "x"), ("b", None)]
    assert [r[0] for r in df.orderBy("ord").select(catalog.embedding_text(F.col("name"), F.col("description"))).collect()] == ["a: x", None, "a: y"]
    assert json.loads(catalog.function_json(df).where("description = 'x'").first().definition) == {"type": "function", "function": {"name": "a", "description": "x", "parameters": {"type": "object"}}}


def test_payloads(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("plain",), ("[1, 2]",), (None,)], "t string")
    assert [tuple(r) for r in df.select(payload.json_or_text(F.col("t")), payload.is_json(F.col("t"))).collect()] == [('{"a":1}', True), ("plain", False), ("[1,2]", True), (None, False)]
    schema = {"type": "object", "properties": {"room": {"type": "string", "enum": ["a", "b"]}, "value": {"type": "number"}, "date": {"type": "string", "format": "date"}}, "required": ["room", "value"]}
    assert payload.schema_type(schema) == T.StructType([T.StructField("room", T.StringType(), False), T.StructField("value", T.DoubleType(), False), T.StructField("date", T.DateType())])
    bad = spark.createDataFrame([('{"room":"a","value":2}',), ('{"room":"c","value":"x"}',), ('{"date":"2024-13-01"}',), ("{",)], "t string")
    assert [r[0] for r in bad.select(payload.schema_errors(F.col("t"), schema)).collect()] == [[], ["room is not allowed", "value is not a number"], ["missing room", "missing value", "date is not a date"], ["not JSON"]]


def test_providers(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    vectors = [r.e for r in df.select(providers.embed(F.col("t")).alias("e")).collect()]
    assert math.isclose(np.linalg.norm(vectors[0]), 1, rel_tol=1e-6) and not any(vectors[1]) and not any(vectors[2])
    calls = spark.createDataFrame([("t1", "ok", '{"x": 1}'), ("t2", "down", "{}"), ("t3", "ok", "not json")], "tool_name string, endpoint_url string, arguments string")

    def fake(endpoint, arguments):
        if endpoint == "down":
            raise OSError("refused")
        return {"got": arguments}

    got = {r.tool_name: (r.result, r.failed) for r in providers.execute_calls(calls, fake).collect()}
    assert got["t1"] == ('{"got": {"x": 1}}', False) and got["t2"] == ("Error executing tool 't2': refused", True) and got["t3"][1]
    told = providers.complete(spark.createDataFrame([(1,), (2,)], "prompt_id long"), spark.createDataFrame([(1, "hi", "end_turn")], "prompt_id long, completion string, stop_reason string"))
    assert {r.prompt_id: r.completion for r in told.collect()} == {1: "hi", 2: None}


def test_sinks_and_options(spark, tmp_path):
    files.write_json(spark.createDataFrame([span(1, None)], SPAN).coalesce(1), f"{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*.json")
    assert json.loads(part.read_text())["end_ts"] is None
    assert files.option(spark, "spark.sql.session.timeZone") == "UTC"
    with pytest.raises(KeyError):
        files.option(spark, "braidwork.missing")


def test_total_tokens_and_tools(spark):
    rounds = spark.createDataFrame([(1, 5), (1, None), (2, None)], "turn long, total_tokens int")
    assert {r.turn: r.total_tokens for r in agent.total_tokens(rounds, "turn").collect()} == {1: 5, 2: 0}
    calls = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "a")], "turn long, pos long, tool string")
    assert agent.tools_called(calls, "turn").first().tools == '["a","b","a"]'
