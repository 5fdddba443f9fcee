"""Headerless, blank-separated station text files (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.quality import null_sentinels
from ..schema import HOUR_SCHEMA, HOUR_SENTINELS, MINUTE_SCHEMA, MINUTE_SENTINELS


def parse_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """Split the ``value`` column on runs of blanks into the typed columns of ``schema``.

    Blank lines are skipped; a cell that does not parse, or that a short line
    lacks, is NULL; surplus cells are ignored.
    """
    text = F.btrim("value", F.lit(" \t\r\n\f"))
    cells = lines.where(F.col("value").rlike(r"\S")).select(F.split(text, r"\s+").alias("cell"))
    return cells.select(
        *(
            F.get("cell", F.lit(i)).try_cast(field.dataType).alias(field.name)
            for i, field in enumerate(schema)
        )
    )


def minute_lines(lines: DataFrame) -> DataFrame:
    """A1 for lines in a column ``value``, with sentinels turned to NULL."""
    return null_sentinels(parse_lines(lines, MINUTE_SCHEMA), MINUTE_SENTINELS)


def hour_lines(lines: DataFrame) -> DataFrame:
    """A2 for lines in a column ``value``, with sentinels turned to NULL."""
    return null_sentinels(parse_lines(lines, HOUR_SCHEMA), HOUR_SENTINELS)


def read_minute_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A1. Minute files."""
    return minute_lines(spark.read.text(path))


def read_hour_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A2. Hour files."""
    return hour_lines(spark.read.text(path))
