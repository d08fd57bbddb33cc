"""Functions under SQL names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.payload import schema_type

#: SQL bodies, so that they stay inside the optimizer.
SQL_FUNCTIONS = {
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vector_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / ((sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) + 1e-10) * (sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) + 1e-10))",
}


def register_functions(spark: SparkSession) -> None:
    """vector_dot, vector_norm and vector_cosine as temporary SQL functions."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_tool(spark: SparkSession, name: str, function: Callable, returns: str = "string") -> None:
    """A local Python tool as a SQL function of the same name; for small inputs, as it runs row by row."""
    spark.udf.register(name, function, returns)


def typed_arguments(calls: DataFrame, parameters: dict, column: str = "arguments") -> DataFrame:
    """calls with `args`: the JSON arguments read with the types of a JSON Schema, null where malformed."""
    return calls.withColumn("args", F.from_json(column, schema_type(parameters), {"mode": "PERMISSIVE"}))


def register_snapshot(spark: SparkSession, rooms: DataFrame, doors: DataFrame, name: str = "house_snapshot") -> None:
    """The state of all devices as a SQL table function: name() has category, device, current, target, status."""
    rooms.createOrReplaceTempView(f"{name}_rooms")
    doors.createOrReplaceTempView(f"{name}_doors")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TABLE (category STRING, device STRING, current DOUBLE, target DOUBLE, status STRING) RETURN
        SELECT 'temperature', room, current, target, CAST(NULL AS STRING) FROM {name}_rooms UNION ALL SELECT 'doors', door, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), status FROM {name}_doors""")
