"""Lines of text files with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and line of one text file, as small as rule files are: the file is one row at first."""
    whole = spark.read.text(path, wholetext=True)
    return split_lines(whole.select(F.col("value").alias("content"))).select("line_no", "line")


def split_lines(contents: DataFrame, content: str = "content") -> DataFrame:
    """contents with a row for each line: line_no from 1, line. LF ends a line, a CR before it is dropped; no empty last line."""
    text = F.regexp_replace(F.col(content).cast("string"), r"\n\z", "")
    rows = contents.where(F.octet_length(content) > 0).select("*", F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    return rows.withColumns({"line_no": F.col("at") + 1, "line": F.regexp_replace("line", r"\r\z", "")}).drop("at")
