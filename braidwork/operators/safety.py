"""Prioritised pattern screening of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import any_case

# Patterns in order of priority, and the reason each gives.
PATTERNS: tuple[tuple[str, str], ...] = (
    (r"ignore\s+(all\s+)?previous\s+instructions", "prompt override attempt"),
    (r"ignore\s+(all\s+)?above\s+instructions", "prompt override attempt"),
    (r"disregard\s+(all\s+)?previous", "prompt override attempt"),
    (r"forget\s+(all\s+)?(your\s+)?instructions", "prompt override attempt"),
    (r"you\s+are\s+now\s+", "role reassignment attempt"),
    (r"act\s+as\s+if\s+you\s+have\s+no\s+restrictions", "restriction bypass attempt"),
    (r"pretend\s+you\s+are\s+", "role reassignment attempt"),
    (r"^\s*system\s*:", "system prompt injection"),
    (r"<\s*system\s*>", "system prompt injection"),
    (r"\]\s*system\s*:", "system prompt injection"),
    (r"do\s+not\s+follow\s+(your\s+)?guidelines", "guideline bypass attempt"),
    (r"override\s+(your\s+)?(safety|content)\s+(filter|policy)", "safety bypass attempt"),
    (r"jailbreak", "jailbreak attempt"),
)


def reason(text: Column, patterns=PATTERNS) -> Column:
    """The reason of the first pattern found, or an empty string (for null too).

    Texts are held against all patterns at once; only those that have one are
    held against each.
    """
    first = F.coalesce(*(F.when(text.rlike(any_case(p)), F.lit(r)) for p, r in patterns), F.lit(""))
    return F.when(text.rlike(any_case("|".join(f"(?:{p})" for p, _ in patterns))), first).otherwise(F.lit("")) if patterns else F.lit("")


def verdict(text: Column, patterns=PATTERNS) -> Column:
    """struct<passed, reason>; another classifier may stand in with the same contract."""
    why = reason(text, patterns)
    return F.struct((why == "").alias("passed"), why.alias("reason"))


def route(messages: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(passed rows, blocked rows with reason); either side evaluates the patterns once."""
    why = reason(F.col(column))
    found = F.filter(F.array(why), lambda r: r != "")  # exploding keeps the optimizer from computing it in a filter again
    return messages.where(why == ""), messages.select("*", F.explode(found).alias("reason"))
