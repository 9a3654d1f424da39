"""Readers of JSON documents and lines."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.values import parse_json


def read_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """Non-empty lines of JSON as text, with their place in the file."""
    lines = spark.read.text(path).select(F.col("value").alias(column), F.monotonically_increasing_id().alias("line"))
    return lines.where(F.trim(column) != "")


def read_documents(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """One JSON document a file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias(column))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_value(spark: SparkSession, path: str) -> Any:
    """A JSON file as a plain value, while the plan is made."""
    return parse_json(read_documents(spark, path).first()[0])


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
