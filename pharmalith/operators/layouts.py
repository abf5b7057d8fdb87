"""Which layout a dataset has, and conversion between layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .modeling import Dictionary, modeling_to_modeling, modeling_to_nca
from .nca import nca_to_modeling
from .sdtm import sdtm_to_modeling

#: The layouts.
INPUTS, OUTPUTS = ("auto", "nca", "modeling", "sdtm"), ("nca", "modeling")


class UnsupportedConversion(ValueError):
    """No conversion leads from the one layout to the other."""


def detect_dataset_type(data: DataFrame | dict[str, DataFrame]) -> str:
    """sdtm for several tables, modeling for a table with an EVID column (in any case), else nca."""
    if isinstance(data, dict):
        return "sdtm"
    if not hasattr(data, "columns"):
        raise TypeError("expected a DataFrame or a dict of DataFrames")
    return "modeling" if "evid" in {c.lower() for c in data.columns} else "nca"


def reformat_data(data: DataFrame | dict[str, DataFrame], dictionary: Dictionary | None = None, input_type: str = "auto", output_type: str = "nca", **options) -> DataFrame:
    """Convert between layouts; options go to the conversion."""
    if input_type not in INPUTS or output_type not in OUTPUTS:
        raise ValueError(f"input_type must be one of {INPUTS}, output_type one of {OUTPUTS}")
    kind = detect_dataset_type(data) if input_type == "auto" else input_type
    if (kind, output_type) == ("sdtm", "modeling"):
        return sdtm_to_modeling(data, dictionary, **options)
    if (kind, output_type) == ("nca", "modeling"):
        return nca_to_modeling(data, dictionary or Dictionary(), **options)
    if (kind, output_type) == ("modeling", "modeling"):
        return modeling_to_modeling(data, dictionary, **options)
    if (kind, output_type) == ("modeling", "nca"):
        return modeling_to_nca(data, dictionary, **options)
    raise UnsupportedConversion(f"no conversion from {kind} to {output_type}")
