"""JSON payloads: arguments, responses, content blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Content blocks of a message.
BLOCK = "struct<type:string,text:string,id:string,name:string,input:string>"


def json_or_text(body: Column) -> Column:
    """A body as compact JSON if it is JSON, else as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(body)), body)


def is_json(body: Column) -> Column:
    return F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))


def extract_text(blocks: Column) -> Column:
    """The texts of the text blocks, one after the other; empty for null."""
    return F.array_join(F.transform(F.filter(F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>")), lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")


def tool_uses(blocks: Column) -> Column:
    return F.filter(F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>")), lambda b: b["type"] == "tool_use")


def join_results(blocks: Column) -> Column:
    """Result blocks line by line: their text, or the block as JSON."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.to_json(b))), "\n")


def schema_type(schema: dict) -> T.StructType:
    """The struct of a JSON Schema object: string, number, integer, boolean, date; required fields are not nullable."""
    kinds = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}
    needed = set(schema.get("required", []))
    fields = []
    for name, spec in schema.get("properties", {}).items():
        kind = T.DateType() if spec.get("format") == "date" else T.ArrayType(T.StringType()) if spec.get("type") == "array" else kinds.get(spec.get("type"), T.StringType())
        fields.append(T.StructField(name, kind, name not in needed))
    return T.StructType(fields)


def schema_errors(arguments: Column, schema: dict) -> Column:
    """What of a JSON argument text breaks the schema: an array of messages, empty if nothing does."""
    parsed = F.try_parse_json(arguments)
    checks = [F.when(parsed.isNull(), F.lit("not JSON"))]
    for name in schema.get("required", []):
        checks.append(F.when(parsed.isNotNull() & F.try_variant_get(parsed, f"$.{name}", "string").isNull(), F.lit(f"missing {name}")))
    for name, spec in schema.get("properties", {}).items():
        value = F.try_variant_get(parsed, f"$.{name}", "string")
        if spec.get("type") in ("number", "integer"):
            checks.append(F.when(value.isNotNull() & F.try_variant_get(parsed, f"$.{name}", "double").isNull(), F.lit(f"{name} is not a number")))
        if spec.get("format") == "date":
            checks.append(F.when(value.isNotNull() & value.try_cast("date").isNull(), F.lit(f"{name} is not a date")))
        if "enum" in spec:
            checks.append(F.when(value.isNotNull() & ~value.isin(*spec["enum"]), F.lit(f"{name} is not allowed")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())
