"""Heading-based chunking inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import heading_title, strip, unix_lines

MARK = "## "


def chunk_sections(files: DataFrame) -> DataFrame:
    """source, chunk_no, heading, text: the sections of each file (source, text).

    A line that starts with "## " opens a section headed by it; what stands
    before the first one is headed by the source.  An empty file has no chunk,
    one of blank lines has one with an empty text.  chunk_no counts from 0.
    """
    parts = F.split(unix_lines(F.col("text")), "\n(?=## )", -1)
    rows = files.where(F.length("text") > 0).select("source", F.posexplode(parts).alias("chunk_no", "body"))
    first_line = F.substring_index("body", "\n", 1)
    heading = F.when(F.col("body").startswith(MARK), heading_title(first_line)).otherwise(F.col("source"))
    return rows.select("source", F.col("chunk_no").cast("long").alias("chunk_no"), heading.alias("heading"), strip(F.col("body")).alias("text"))
