"""Tool catalogues: uniqueness, embedding text, model-side schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "ord long, name string, description string, parameters string, endpoint_url string"


def catalog(spark: SparkSession, tools: list[dict]) -> DataFrame:
    """A catalogue of literal tools (name, description, parameters as a dict, endpoint_url), in order."""
    rows = [(i, t["name"], t.get("description"), json.dumps(t.get("parameters", {})), t.get("endpoint_url", "")) for i, t in enumerate(tools)]
    return spark.createDataFrame(rows, SCHEMA)


def register(tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the first tool of each name by ord, and the others with an error."""
    ranked = tools.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("ord")))
    error = F.concat(F.lit("Tool with name '"), "name", F.lit("' already exists."))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n").withColumn("error", error)


def append(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected) of new tools for a stored catalogue: names that are stored or come earlier are rejected.

    The new tools are numbered on from the stored ones.  Write the first with
    sources.files.append_rows.
    """
    last = stored.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    accepted, rejected = register(new)
    known = stored.select("name").distinct()
    fresh = accepted.join(known, "name", "left_anti")
    error = F.concat(F.lit("Tool with name '"), "name", F.lit("' already exists."))
    again = accepted.join(known, "name", "left_semi").withColumn("error", error)
    columns = [c for c in stored.columns if c != "ord"]
    return fresh.crossJoin(last).withColumn("ord", F.col("last") + 1 + F.col("ord")).select("ord", *columns).select(*stored.columns), rejected.unionByName(again)  # last is one row


def register_first(tools: DataFrame) -> DataFrame:
    """The accepted tools by one pre-aggregated group, for catalogues where a name may be very frequent."""
    rest = [c for c in tools.columns if c != "name"]
    return tools.groupBy("name").agg(F.min_by(F.struct(*rest), "ord").alias("t")).select("name", "t.*")


def embedding_text(name: Column, description: Column) -> Column:
    return F.concat(name, F.lit(": "), description)


def model_schema(tools: DataFrame) -> DataFrame:
    """name, description, input_schema: what a model is shown; the endpoint stays out."""
    return tools.select("name", "description", F.col("parameters").alias("input_schema"))


def function_json(tools: DataFrame) -> DataFrame:
    """name, definition: the nested function form as JSON text."""
    body = F.struct(F.lit("function").alias("type"), F.struct("name", "description", F.from_json("parameters", "struct<type:string,required:array<string>>").alias("parameters")).alias("function"))
    return tools.select("name", F.to_json(body).alias("definition"))
