import duckdb

from braidwork.llm import chat_formatting as m

KIND = "conv_id long, turn long, role string, text string"


def rows(df):
    return sorted(map(tuple, m.format_chats(df).collect()))


def oracle(table):
    con = duckdb.connect()
    con.register("conversations", table)
    return sorted(con.sql(m.ORACLE).fetchall())


def test_matches_sql(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert rows(df) == oracle(df.toArrow())


def test_snapshots_collapse(spark):
    chat = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    turns = [(c, t, *chat[t]) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for t in range(n)]
    turns += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, "assistant", "hi")]
    df = spark.createDataFrame(turns, KIND)
    got = rows(df)
    assert [r[:5] for r in got] == [(3, 0, 1, 3, 2), (5, 0, 1, 2, 1), (6, 0, 1, 1, 1)]
    assert got[0][5] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert got == oracle(df.toArrow())


def test_odd_rows(spark):
    turns = [(1, None, None, None), (1, 0, "user", ""), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, "user", "y" * 200_000), (None, 0, "user", "x"), (5, 0, "b", "1"), (5, 0, "a", "2"), (6, 0, "a", "2")]
    df = spark.createDataFrame(turns, KIND).selectExpr("*", "1 as place", "2 as n_turns", "3 as a", "4 as x")
    assert rows(df) == oracle(df.select("conv_id", "turn", "role", "text").toArrow())
    assert [(r[0], r[3]) for r in rows(df)] == [(1, 2), (2, 2), (4, 1), (5, 2)]
    assert rows(df.limit(0)) == []


def test_long_conversations_come_in_parts(spark):
    turns = [(1, i, "user", f"m{i}") for i in range(7)]
    got = sorted(map(tuple, m.format_chats(spark.createDataFrame(turns, KIND), part_turns=3).collect()))
    assert [r[:5] for r in got] == [(1, 0, 3, 7, 1), (1, 1, 3, 7, 1), (1, 2, 3, 7, 1)]
    whole = m.format_chats(spark.createDataFrame(turns, KIND)).first().rendered
    assert "".join(r[5] for r in got) == whole


def test_a_conversation_over_many_ranges(spark):
    """One conversation has nearly all turns, and another is its prefix."""
    turns = [(1, i, "user", f"m{i % 50}") for i in range(3000)] + [(2, i, "user", f"m{i % 50}") for i in range(1700)] + [(c, i, "user", f"m{i}") for c in range(3, 60) for i in range(c % 4 + 1)]
    df = spark.createDataFrame(turns, KIND).repartition(6)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # so that a small table has several ranges
    try:
        check_ranges(df)
    finally:
        spark.conf.unset(setting)


def check_ranges(df):
    got = m.prefixes(df).collect()
    assert sorted(r.place for r in got if r.conv_id == 1) == list(range(1, 3001)) and {r.n_turns for r in got if r.conv_id == 2} == {1700}
    assert m.numbered(df.selectExpr("*", "md5(text) as tie")).where("conv_id = 1").select("range").distinct().count() > 2
    assert {r.conv_id: (r.n_turns, r.n_copies) for r in m.format_chats(df).collect()} == {1: (3000, 1)}
    assert rows(df) == oracle(df.toArrow())
