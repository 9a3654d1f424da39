"""Validation of streams: the same Columns on a stream, split into valid and invalid rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docloom.operators.validate import Validator


def validate_stream(stream: DataFrame, validator: Validator, column: str) -> DataFrame:
    """The stream with doc, errors and valid; validation keeps no state."""
    return validator.apply(stream, column)


def split(stream: DataFrame, validator: Validator, column: str, good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands valid and invalid rows of each micro-batch to two sinks."""
    done = validator.apply(stream, column)

    def batch(df: DataFrame, epoch: int) -> None:
        held = df.persist()
        try:
            good(held.where("valid"), epoch)
            bad(held.where(~F.col("valid")), epoch)
        finally:
            held.unpersist()

    return done.writeStream.foreachBatch(batch)


def error_counts(stream: DataFrame, validator: Validator, column: str, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Errors by path in event-time windows, late rows beyond the watermark dropped."""
    done = validator.apply(stream, column).withWatermark(time, late)
    return done.select(time, F.explode("errors").alias("e")).groupBy(F.window(time, window), F.col("e.path").alias("path")).agg(F.count("*").alias("n"))
