"""Column expressions with the semantics that the operators need."""

from .expressions import (
    UTC_CONF, coded_by_level, hours_between, is_blq_text, nearest_cut, normalized_route, number_text, r_ifelse, round_one, to_datetime, try_number, upper_names,
)
from .numbering import number_rows

__all__ = [
    "UTC_CONF", "coded_by_level", "hours_between", "is_blq_text", "nearest_cut", "normalized_route", "number_rows", "number_text", "r_ifelse", "round_one", "to_datetime", "try_number", "upper_names",
]
