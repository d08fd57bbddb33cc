from pyspark.sql import functions as F

from braidwork.functions.payload import BLOCK
from braidwork.functions.registry import register_functions, register_snapshot, register_tool, typed_arguments
from braidwork.operators import loop, memory, state
from braidwork.sources import providers


def scripted(script):
    """A completion provider that says what the script has for (run_id, iteration)."""
    def complete(open_runs):
        def run(batches):
            for b in batches:
                said = [script.get((int(r), int(i)), ("tool_use", [])) for r, i in zip(b["run_id"], b["iteration"], strict=True)]
                yield b.drop(columns="messages").assign(stop_reason=[s for s, _ in said], blocks=[[dict(type=k, text=t, id=n, name=n, input=a) for k, t, n, a in blocks] for _, blocks in said])
        words = open_runs.select("run_id", "iteration", F.lit("").alias("messages")).mapInPandas(run, f"run_id long, iteration int, stop_reason string, blocks array<{BLOCK}>")
        return open_runs.join(words, ["run_id", "iteration"])
    return complete


def execute(calls):
    return providers.execute_calls(calls, lambda endpoint, arguments: f"{endpoint}:{arguments['x']}")


def test_runs_end_when_they_answer(spark):
    use = lambda name, x: ("tool_use", None, name, f'{{"x": {x}}}')
    script = {
        (1, 0): ("end_turn", [("text", "hel", None, None), ("text", "lo", None, None)]),
        (2, 0): ("tool_use", [("text", "let me see", None, None), use("a", 1), use("zzz", 2), use("a", 3)]), (2, 1): ("end_turn", [("text", "done", None, None)]),
        (3, 0): ("max_tokens", []),
        (4, 0): ("tool_use", [("tool_use", None, "a", "not json")]), (4, 1): ("end_turn", []),
    }
    runs = spark.createDataFrame([(i, [("user", f"q{i}")] if i < 4 else None) for i in (1, 2, 3, 4)], "run_id long, messages array<struct<role:string,content:string>>")
    tools = spark.createDataFrame([(i, "a", "e") for i in (1, 2, 3, 4)], "run_id long, tool_name string, endpoint_url string")
    results, calls, rounds = loop.run_agents(runs, tools, scripted(script), execute, cap=3)
    assert sorted((r.run_id, r.iteration, r.stop_reason) for r in rounds.collect() if r.run_id < 3) == [(1, 0, "end_turn"), (2, 0, "tool_use"), (2, 1, "end_turn")]
    got = {r.run_id: (r.status, r.iterations, r.response) for r in results.collect()}
    assert got == {1: ("completed", 1, "hello"), 2: ("completed", 2, "done"), 3: ("max_iterations", 3, loop.GAVE_UP), 4: ("completed", 2, "")}
    (two,) = results.where("run_id = 2").collect()
    assert [(m.role, m.content) for m in two.messages] == [("user", "q2"), ("assistant", "let me see"), ("user", "e:1\nTool 'zzz' not found in registry.\ne:3"), ("assistant", "done")]
    assert [(b.type, b.id) for b in two.messages[1].blocks] == [("text", None), ("tool_use", "a"), ("tool_use", "zzz"), ("tool_use", "a")]
    assert [(b.type, b.id, b.text, b.is_error) for b in two.messages[2].blocks] == [("tool_result", "a", "e:1", None), ("tool_result", "zzz", "Tool 'zzz' not found in registry.", True), ("tool_result", "a", "e:3", None)]
    assert [(r.call_no, r.result, r.failed) for r in calls.where("run_id = 2").orderBy("call_no").collect()] == [(0, "e:1", False), (2, "e:3", False)]
    assert [r.failed for r in calls.where("run_id = 4").collect()] == [True]


def test_no_runs(spark):
    runs = spark.createDataFrame([], "run_id long, messages array<struct<role:string,content:string>>")
    for df in loop.run_agents(runs, spark.createDataFrame([], "run_id long, tool_name string, endpoint_url string"), scripted({}), execute):
        assert df.count() == 0


def test_two_turns(spark):
    """What a run ends with is where the next turn goes on."""
    use = ("tool_use", None, "a", '{"x": 1}')
    tools = spark.createDataFrame([(1, "a", "e")], "run_id long, tool_name string, endpoint_url string")
    first = spark.createDataFrame([(1, [("user", "weather?")])], "run_id long, messages array<struct<role:string,content:string>>")
    one = loop.run_agents(first, tools, scripted({(1, 0): ("tool_use", [use]), (1, 1): ("end_turn", [("text", "sunny", None, None)])}), execute)
    asked = spark.createDataFrame([(1, "and tomorrow?"), (2, "hello")], "run_id long, text string")
    turn = memory.next_turn(one.results, asked)
    assert {r.run_id: [(m.role, m.content) for m in r.messages] for r in turn.collect()} == {
        1: [("user", "weather?"), ("assistant", ""), ("user", "e:1"), ("assistant", "sunny"), ("user", "and tomorrow?")], 2: [("user", "hello")]}
    two = loop.run_agents(turn, tools, scripted({(1, 0): ("end_turn", [("text", "rain", None, None)]), (2, 0): ("end_turn", [])}), execute)
    got = {r.run_id: r for r in two.results.collect()}
    assert len(got[1].messages) == 6 and got[1].messages[-1].content == "rain" and got[1].messages[1].blocks[0].name == "a" and got[2].iterations == 1


def test_answers_by_id(spark):
    use = lambda name, i: ("tool_use", None, name, '{"x": %d}' % i)
    tools = spark.createDataFrame([(1, "a", "e")], "run_id long, tool_name string, endpoint_url string")
    runs = spark.createDataFrame([(1, None)], "run_id long, messages array<struct<role:string,content:string>>")
    done = loop.run_agents(runs, tools, scripted({(1, 0): ("tool_use", [use("a", 1), use("b", 2)]), (1, 1): ("end_turn", [])}), execute)
    assert sorted((r.call_id, r.tool_name, r.result, r.is_error) for r in loop.answered_calls(done.results).collect()) == [("a", "a", "e:1", False), ("b", "b", "Tool 'b' not found in registry.", True)]


def test_tools_found_on_the_way(spark):
    """A search for tools brings candidates for the rounds after it."""
    use = lambda name, a: ("tool_use", None, name, a)
    script = {(1, 0): ("tool_use", [use("notify", '{"x": 1}'), use("search_tools", '{"query": "notify"}')]), (1, 1): ("tool_use", [use("notify", '{"x": 2}')]), (1, 2): ("end_turn", [])}
    runs = spark.createDataFrame([(1, None)], "run_id long, messages array<struct<role:string,content:string>>")
    none = spark.createDataFrame([], "run_id long, tool_name string, endpoint_url string")
    catalogue = spark.createDataFrame([("notify", "n"), ("other", "o")], "tool_name string, endpoint_url string")

    def retrieve(searches):
        return searches.join(catalogue, F.get_json_object("arguments", "$.query") == F.col("tool_name"))

    done = loop.run_agents(runs, none, scripted(script), execute, retrieve=retrieve)
    assert [(r.iteration, r.tool_name, r.result) for r in done.calls.collect()] == [(1, "notify", "n:2")]
    assert done.results.first().messages[1].blocks[1].text == '["notify"]'


def test_state_as_a_table_function(spark):
    register_snapshot(spark, state.seed_rooms(spark), state.seed_doors(spark))
    got = {(r.category, r.device): (r.target, r.status) for r in spark.sql("SELECT * FROM house_snapshot()").collect()}
    assert got[("temperature", "living_room")] == (22.0, None) and got[("doors", "garage")] == (None, "open") and len(got) == 5


def test_registered_functions(spark):
    register_functions(spark)
    register_tool(spark, "shout", lambda s: s.upper())
    row = spark.sql("SELECT vector_dot(array(1D, 2D), array(3D, 4D)) AS d, vector_norm(array(3D, 4D)) AS n, vector_cosine(array(0D, 0D), array(1D, 0D)) AS c, shout('a') AS s").first()
    assert tuple(row) == (11.0, 5.0, 0.0, "A")
    df = spark.createDataFrame([('{"room": "a", "value": 2, "day": "2024-01-02"}',), ("no",)], "arguments string")
    schema = {"properties": {"room": {"type": "string"}, "value": {"type": "number"}, "day": {"type": "string", "format": "date"}}}
    got = [r.args for r in typed_arguments(df, schema).collect()]
    assert got[0].value == 2.0 and str(got[0].day) == "2024-01-02" and (got[1] is None or got[1].room is None)
