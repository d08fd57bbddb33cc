"""Flat span tables: durations, trees, roll-ups, pairing of starts and ends.

A span is (trace_id, span_id, parent_id, name, start_ts, end_ts, attributes,
status) and known by trace_id and span_id; the tree is derived, as Spark has
no recursive type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import written

EVENT_CHARS = 4096
#: Fixed value: the service that spans are exported for.
SERVICE = "home-agent"


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds to two places, null while the span is open."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000, 2)


def set_attributes(attributes: Column, new: Column) -> Column:
    """Attributes with new ones put in; the last value of a key wins."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(attributes, lambda k, _: ~F.map_contains_key(new, k))), F.map_entries(new)))


def _placed(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, depth, root_id, way: way holds (start_ts, span_id) from the root to the span.

    Pointers double: after n rounds each span knows its ancestor 2^n steps up,
    so the number of joins grows with the logarithm of the depth.
    """
    step = F.array(F.struct("start_ts", "span_id"))
    base = spans.select("trace_id", "span_id", "parent_id", F.col("start_ts").cast("timestamp").alias("start_ts"))
    ids = base.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("there"))
    state = written(base.join(ids, ["trace_id", "parent_id"], "left").select(
        "trace_id", "span_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"), F.col("span_id").alias("root_id"), step.alias("way")))
    while True:
        # a span with as many ancestors as its trace has spans is among its own
        n, most, open_ = state.groupBy("trace_id").agg(F.count("*").alias("n"), F.max("depth").alias("most"), F.count("up").alias("open")).agg(
            F.count("*"), F.max(F.expr("open > 0 and most >= n")), F.sum("open")).first()
        if n and most:
            raise ValueError("the parents form a cycle")
        if not open_:
            return state.drop("up")
        above = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("way").alias("way2"), F.col("root_id").alias("root2"))
        state = written(state.join(above, ["trace_id", "up"], "left").select(
            "trace_id", "span_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("root2", "root_id").alias("root_id"),
            F.when(F.col("up").isNotNull(), F.concat("way2", "way")).otherwise(F.col("way")).alias("way")))


def tree(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, depth, root_id, path for each span (trace_id, span_id, parent_id, start_ts).

    Span ids are those of a trace: other traces may use them too.  A span
    whose parent is not in its trace is a root.  Cycles are an error.  The
    rounds run when this is called.
    """
    ids = F.array_join(F.transform("way", lambda x: x["span_id"].cast("string")), "/")
    return _placed(spans).select("trace_id", "span_id", "depth", "root_id", ids.alias("path"))


def children(spans: DataFrame) -> DataFrame:
    """trace_id, parent_id, n_children, children (names in order of start, then id)."""
    nested = F.array_sort(F.collect_list(F.struct("start_ts", "span_id", "name")))
    return spans.where("parent_id is not null").groupBy("trace_id", "parent_id").agg(F.count("*").alias("n_children"), F.transform(nested, lambda x: x["name"]).alias("children"))


def trace_json(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, trace: a JSON object for each root with all its descendants nested.

    The spans of a tree are put in order, parents first, and each is written
    up to its children; what opens is closed where the next span is not
    deeper.  So the number of jobs does not depend on the depth.
    """
    own = F.to_json(F.struct("name", "start_ts", "end_ts", duration_ms(F.col("start_ts"), F.col("end_ts")).alias("duration_ms"), "attributes", "status"), {"ignoreNullFields": "false"})
    body = F.concat(F.regexp_replace(own, r"\}\z", ""), F.lit(',"children":['))
    placed = _placed(spans)
    each = spans.withColumn("body", body).select("trace_id", "span_id", "body").join(placed, ["trace_id", "span_id"])
    trees = each.groupBy("trace_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("way", "depth", "body"))).alias("all"))

    def put(x: Column, i: Column) -> Column:
        after = F.get("all", i + 1)["depth"]
        closing = F.repeat(F.lit("]}"), (x["depth"] - F.coalesce(after, F.lit(0)) + 1).cast("int"))
        return F.concat(x["body"], F.when(after > x["depth"], F.lit("")).otherwise(F.concat(closing, F.when(after.isNotNull(), F.lit(",")).otherwise(F.lit("")))))

    return trees.select("trace_id", F.col("root_id").alias("span_id"), F.array_join(F.transform("all", put), "").alias("trace"))


def roll_up(spans: DataFrame, by: str = "name") -> DataFrame:
    """Calls, error rate and exact latency percentiles."""
    ms = duration_ms(F.col("start_ts"), F.col("end_ts"))
    return spans.groupBy(by).agg(F.count("*").alias("calls"), F.avg((F.col("status") == "ERROR").cast("double")).alias("error_rate"),
                                 *(F.percentile(ms, p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


def from_stack(marks: DataFrame) -> DataFrame:
    """Spans of start and end marks (trace_id, seq, kind, span_id, name, ts, status) as a stack opens and closes them.

    A start's parent is the span open then; an end closes its span by id.  Open
    spans have status UNSET and no end.
    """
    order = Window.partitionBy("trace_id").orderBy("seq")
    starts = (marks.withColumn("_open", F.sum(F.when(F.col("kind") == "start", 1).otherwise(-1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .where("kind = 'start'"))
    # the parent is the latest start one level up: a start is looked for on that level and found on its own
    sides = starts.select("*", F.explode(F.array(F.struct(F.col("_open").alias("level"), F.lit(True).alias("own")), F.struct((F.col("_open") - 1).alias("level"), F.lit(False).alias("own")))).alias("side"))
    level = Window.partitionBy("trace_id", "side.level").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    linked = sides.withColumn("parent_id", F.last(F.when(F.col("side.own"), F.col("span_id")), ignorenulls=True).over(level)).where("not side.own")
    ends = marks.where("kind = 'end'").select("trace_id", "span_id", F.col("ts").alias("end_ts"), F.coalesce("status", F.lit("OK")).alias("ended"))
    return linked.join(ends, ["trace_id", "span_id"], "left").select("trace_id", "span_id", "parent_id", "name", F.col("ts").alias("start_ts"), "end_ts", F.coalesce("ended", F.lit("UNSET")).alias("status"))


def io_events(prompt: Column, completion: Column, chars: int = EVENT_CHARS) -> Column:
    """The two events of a model call, each cut to a length; each attribute has its event's name."""
    one = lambda name, value: F.struct(F.lit(name).alias("name"), F.map_from_arrays(F.array(F.lit(name)), F.array(F.left(value, F.lit(chars)))).alias("attributes"))
    return F.array(one("llm.prompt", prompt), one("llm.completion", completion))


def with_resource(spans: DataFrame, service: str = SERVICE) -> DataFrame:
    """Spans with the resource they are exported under, as a map with service.name."""
    return spans.withColumn("resource", F.create_map(F.lit("service.name"), F.lit(service)))


def export_lines(spans: DataFrame, service: str = SERVICE) -> DataFrame:
    """value: a JSON line for each span in the shape of an OTLP export: resource, ids as hex, times in nanoseconds, attributes as pairs."""
    nanos = lambda c: (F.unix_micros(c.cast("timestamp")) * 1000).cast("string")
    attributes = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    span = F.struct(
        F.lower(F.lpad(F.hex("trace_id"), 32, "0")).alias("traceId"), F.lower(F.lpad(F.hex("span_id"), 16, "0")).alias("spanId"), F.lower(F.lpad(F.hex("parent_id"), 16, "0")).alias("parentSpanId"), "name",
        nanos(F.col("start_ts")).alias("startTimeUnixNano"), nanos(F.col("end_ts")).alias("endTimeUnixNano"), attributes.alias("attributes"), F.struct(F.col("status").alias("code")).alias("status"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value"))).alias("attributes"))
    return spans.select(F.to_json(F.struct(resource.alias("resource"), span.alias("span"))).alias("value"))
