"""Keyed device state from a command log: validation, last write wins, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


DOOR_STATES = ("open", "closed")
# The initial house.
ROOMS: tuple[tuple[str, float, float], ...] = (("living_room", 21.5, 22.0), ("bedroom", 20.0, 20.0))
DOORS: tuple[tuple[str, str], ...] = (("front_door", "closed"), ("back_door", "closed"), ("garage", "open"))


def seed_rooms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROOMS), "room string, current double, target double")


def seed_doors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DOORS), "door string, status string")


def last_write(log: DataFrame, key: str, value: str, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(key, value): each key's value with the greatest order; pre-aggregated, so hot keys are no burden."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def unknown(kind: str, key: Column, known: tuple[str, ...]) -> Column:
    """The error text for a key that is not known, else null."""
    listed = "[" + ", ".join(f"'{k}'" for k in known) + "]"
    return F.when(key.isNull() | ~key.isin(*known), F.concat(F.lit(f"Unknown {kind} '"), F.coalesce(key, F.lit("None")), F.lit(f"'. Valid {kind}s: {listed}")))


def bad_status(status: Column) -> Column:
    return F.when(status.isNull() | ~status.isin(*DOOR_STATES), F.concat(F.lit("Status must be 'open' or 'closed', got '"), F.coalesce(status, F.lit("None")), F.lit("'")))


def set_temperatures(commands: DataFrame, seed: DataFrame, rooms: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(room, current, target) after commands (room, value, ts, seq), and the rejected commands with error.

    Only the target changes, and any value is taken.
    """
    judged = commands.withColumn("error", unknown("room", F.col("room"), rooms))
    last = last_write(judged.where("error is null"), "room", "value")
    return seed.join(last, "room", "left").select("room", "current", F.coalesce("value", "target").alias("target")), judged.where("error is not null")


def set_doors(commands: DataFrame, seed: DataFrame, doors: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(door, status) after commands (door, status, ts, seq), and the rejected ones; the door is checked first."""
    judged = commands.withColumn("error", F.coalesce(unknown("door", F.col("door"), doors), bad_status(F.col("status"))))
    last = last_write(judged.where("error is null"), "door", "status").withColumnRenamed("status", "latest")
    return seed.join(last, "door", "left").select("door", F.coalesce("latest", "status").alias("status")), judged.where("error is not null")


def read(requests: DataFrame, snapshot: DataFrame, key: str, kind: str, known: tuple[str, ...]) -> DataFrame:
    """Requests with the snapshot's columns, or an error text for unknown keys."""
    return requests.withColumn("error", unknown(kind, F.col(key), known)).join(snapshot, key, "left")


def snapshot(rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """One row with both categories as maps."""
    r = rooms.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("room", F.struct("current", "target"))))).alias("temperature"))
    d = doors.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("door", "status")))).alias("doors"))
    return r.crossJoin(d)  # one row each


def temperature_rule(requested: Column, current: Column) -> Column:
    """reject beyond 15 to 30, confirm above 26, alert if it is below 16 now, else ok."""
    return F.when((requested > 30) | (requested < 15), "reject").when(requested > 26, "confirm").when(current < 16, "alert").otherwise("ok")


def half_degrees(value: Column) -> Column:
    return F.round(value * 2) / 2


GARAGE_MINUTES, LOCK_MINUTES, NIGHT_HOUR = 10, 5, 22


def leaving_check(leaving: DataFrame, doors: DataFrame) -> DataFrame:
    """(seq, open_doors, alert): for each row (seq) on which the user leaves, the doors that are open then and whether to warn.

    doors is the snapshot (door, status); it has a row for each device.
    """
    open_ = doors.where("status = 'open'").agg(F.array_sort(F.collect_list("door")).alias("open_doors"))
    return leaving.select("seq").crossJoin(open_).withColumn("alert", F.size("open_doors") > 0)  # one row


def left_open(log: DataFrame, minutes: int) -> DataFrame:
    """(door, opened_ts, closes_ts, closed_by): each time that a door opens, when it is closed at the latest.

    log: door, status, ts, seq of accepted commands.  A door closes by itself
    `minutes` after it was opened unless a command closes it before; opening an
    open door starts no new time.
    """
    order = Window.partitionBy("door").orderBy("ts", "seq")
    placed = log.withColumn("before", F.lag("status").over(order)).where("before is null or before <> status")
    turns = placed.withColumn("next_ts", F.lead("ts").over(order)).where("status = 'open'")
    due = F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))
    by_command = F.col("next_ts").isNotNull() & (F.col("next_ts") < due)
    return turns.select("door", F.col("ts").alias("opened_ts"), F.when(by_command, F.col("next_ts")).otherwise(due).alias("closes_ts"), F.when(by_command, "command").otherwise("timer").alias("closed_by"))


def garage_closings(log: DataFrame, minutes: int = GARAGE_MINUTES) -> DataFrame:
    return left_open(log.where("door = 'garage'"), minutes)


def lock_closings(log: DataFrame, minutes: int = LOCK_MINUTES) -> DataFrame:
    return left_open(log.where("door <> 'garage'"), minutes)


def night_garage(log: DataFrame, hour: int = NIGHT_HOUR) -> DataFrame:
    """(day, opened_ts): the days on which the garage is open at `hour` o'clock by its last command of the day before then."""
    before = log.where((F.col("door") == "garage") & (F.hour("ts") < hour)).groupBy(F.to_date("ts").alias("day")).agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("last"))
    return before.where("last.status = 'open'").select("day", F.col("last.ts").alias("opened_ts"))
