"""Route of administration from a column of spellings."""

from __future__ import annotations

import logging
import warnings

from pyspark.sql import DataFrame, functions as F

from ..functions import normalized_route

log = logging.getLogger(__name__)


def first_route(df: DataFrame, column: str, order_by: str, keys: list[str] | None = None) -> DataFrame:
    """Per key (or over all): the first non-null spelling, how many there are, and the route; oral if there is none."""
    first = F.min(F.when(F.col(column).isNotNull(), F.struct(F.col(order_by), F.col(column).alias("route"))))["route"]
    out = df.groupBy(*(keys or [])).agg(first.alias("first_spelling"), F.countDistinct(column).alias("n_spellings"))
    return out.withColumn("route", normalized_route(F.col("first_spelling")))


def get_route_from_data_column(df: DataFrame, column: str, order_by: str | None = None) -> str:
    """iv, oral, sc or im: the first spelling decides; several different ones warn."""
    if order_by is None:
        df, order_by = df.withColumn("_ord", F.monotonically_increasing_id()), "_ord"
    row = first_route(df, column, order_by).first()
    if row.n_spellings > 1:
        warnings.warn(f"{row.n_spellings} routes found; the first is used", stacklevel=2)
    return row.route
