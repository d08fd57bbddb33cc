import datetime as dt

from pyspark.sql import functions as F

from braidwork.operators import memory, state
from braidwork.sources import files
from braidwork.streaming import twins

T0 = dt.datetime(2024, 1, 1)


def commands(spark, rows, value="double"):
    return spark.createDataFrame([(k, v, T0 + dt.timedelta(seconds=s), q) for k, v, s, q in rows], f"k string, v {value}, ts timestamp, seq long")


def test_set_temperature_changes_the_target_only(spark):
    log = commands(spark, [("living_room", 36.0, 1, 1), ("living_room", 18.0, 0, 2), ("attic", 20.0, 5, 3), (None, 1.0, 5, 4)]).withColumnsRenamed({"k": "room", "v": "value"})
    rooms, bad = state.set_temperatures(log, state.seed_rooms(spark), ("living_room", "bedroom"))
    assert sorted(map(tuple, rooms.collect())) == [("bedroom", 20.0, 20.0), ("living_room", 21.5, 36.0)]
    assert {r.error for r in bad.collect()} == {"Unknown room 'attic'. Valid rooms: ['living_room', 'bedroom']", "Unknown room 'None'. Valid rooms: ['living_room', 'bedroom']"}


def test_door_is_checked_before_status(spark):
    log = commands(spark, [("attic", "ajar", 1, 1), ("garage", "ajar", 2, 2), ("garage", "closed", 3, 3), ("garage", "open", 3, 2)], "string").withColumnsRenamed({"k": "door", "v": "status"})
    doors, bad = state.set_doors(log, state.seed_doors(spark), ("front_door", "back_door", "garage"))
    assert dict(map(tuple, doors.collect())) == {"front_door": "closed", "back_door": "closed", "garage": "closed"}
    assert [r.error for r in bad.orderBy("seq").collect()] == ["Unknown door 'attic'. Valid doors: ['front_door', 'back_door', 'garage']", "Status must be 'open' or 'closed', got 'ajar'"]


def test_snapshot_and_reads(spark):
    one = state.snapshot(state.seed_rooms(spark), state.seed_doors(spark)).first()
    assert one.doors == {"front_door": "closed", "back_door": "closed", "garage": "open"} and one.temperature["living_room"].target == 22.0
    got = state.read(spark.createDataFrame([("garage",), ("shed",)], "door string"), state.seed_doors(spark), "door", "door", ("garage",)).orderBy("door").collect()
    assert [(r.status, r.error) for r in got] == [("open", None), (None, "Unknown door 'shed'. Valid doors: ['garage']")]


def test_rules(spark):
    df = spark.createDataFrame([(31.0, 20.0), (14.0, 20.0), (27.0, 20.0), (20.0, 15.0), (20.26, 20.0)], "t double, c double")
    assert [tuple(r) for r in df.select(state.temperature_rule(F.col("t"), F.col("c")), state.half_degrees(F.col("t"))).collect()] == [("reject", 31.0), ("reject", 14.0), ("confirm", 27.0), ("alert", 20.0), ("ok", 20.5)]


def messages(spark, n, conv=1):
    return spark.createDataFrame([(conv, i, ("user", "assistant", "tool")[i % 3], f"m{i}") for i in range(1, n + 1)], "conv_id long, turn long, role string, text string")


def test_context_window(spark):
    df = messages(spark, 25)
    assert [(r.turn, r.pos) for r in memory.context_window(df).orderBy("pos").collect()] == [(5 + i, i) for i in range(1, 21)]
    assert memory.context_window(df, 0).count() == 0 and memory.context_window(df, -3).count() == 0
    last = memory.context_at_each_turn(df, 3).where("turn = 7").first()
    assert [m.turn for m in last.context] == [5, 6, 7]
    assert memory.history(df).where("role = 'tool'").count() == 0
    assert df.limit(1).select(memory.or_empty(F.lit(None).cast("array<struct<role:string,content:string>>"))).first()[0] == []


def test_input_stops_at_quit(spark):
    df = files.utterances(spark, ["  hello ", "", " \t", "more", " Exit ", "after"])
    assert [r.text for r in memory.accepted_input(df).orderBy("turn").collect()] == ["hello", "more"]


def write_parts(spark, folder, parts, kind):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/t.parquet/p{i}")


def test_streamed_state_in_two_batches(spark, tmp_path):
    rows = [(k, float(i), T0 + dt.timedelta(seconds=(i * 37) % 50), i) for i, k in enumerate([1, 2, 1, 3, 2, 1, 1, 2])]
    kind = "k long, v double, ts timestamp, seq long"
    for i, part in enumerate((rows[4:], rows[:4])):  # out of order across batches
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    want = dict(map(tuple, state.last_write(spark.createDataFrame(rows, kind), "k", "v").collect()))
    log = twins.follow(spark, str(tmp_path), "t")
    out = twins.settle(twins.last_write(log, "k", "v"), "update")
    assert out.select("batch_id").distinct().count() == 2
    assert {r.k: r.v for r in twins.newest(out, "k").collect()} == want
    custom = twins.settle(twins.last_write_custom(twins.follow(spark, str(tmp_path), "t"), "k", "v"), "update")
    assert {r.k: r.v for r in twins.newest(custom, "k").collect()} == want


def test_streamed_ledger_and_windows(spark, tmp_path):
    kind = "key string, ts timestamp, name string, status string"
    rows = [(f"k{i % 3}", T0 + dt.timedelta(minutes=i), "a", "ERROR" if i == 2 else "OK") for i in range(6)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    first = twins.settle(twins.first_of_key(twins.follow(spark, str(tmp_path), "t"), "key", "ts", "1 hour"))
    assert sorted(r.key for r in first.collect()) == ["k0", "k1", "k2"]
    seen = twins.settle(twins.calls_per_window(twins.follow(spark, str(tmp_path), "t")), "update")
    assert [(r.calls, r.errors) for r in twins.newest(seen, "name").collect()] == [(6, 1)]
