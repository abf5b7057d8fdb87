"""Row-by-row conversions of streams; they hold no state, so they need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import normalized_route
from ..operators.modeling import Dictionary, modeling_to_modeling


def modeling_stream(events: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """``modeling_to_modeling`` of a streaming table of events."""
    return modeling_to_modeling(events, dictionary)


def route_stream(events: DataFrame, column: str, out: str = "ROUTE") -> DataFrame:
    """A streaming table with each row's route normalised."""
    return events.withColumn(out, normalized_route(F.col(column)))
