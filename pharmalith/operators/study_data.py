"""Study data ready for model fitting or non-compartmental analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hours_between
from ..sources import example_domains, read_domains
from .sdtm import SUBJECT, expand_doses, first_doses, prepare_ex, prepare_pc, sdtm_to_modeling, upper_domains

#: The tables that are read.
MODELFIT_TABLES, NCA_TABLES = ["pc", "adsl", "ex", "lb", "vs"], ["pc", "dm", "ex"]


def _read(spark: SparkSession, db: str | dict | None, tables: list[str], format: str) -> dict[str, DataFrame]:
    return read_domains(spark, db, tables, format) if db is not None else {t: v for t, v in example_domains(spark).items() if t in tables}


def get_data_for_modelfit(spark: SparkSession, db: str | dict | None = None, data: dict[str, DataFrame] | None = None, format: str = "parquet", **options) -> DataFrame:
    """Read pc, adsl, ex, lb and vs, or take them from ``data``, and convert to a modeling table; without either, of the example study."""
    return sdtm_to_modeling(data or _read(spark, db, MODELFIT_TABLES, format), **options)


def get_data_for_nca(spark: SparkSession, db: str | dict | None = None, data: dict[str, DataFrame] | None = None, format: str = "parquet") -> DataFrame:
    """Read pc, dm and ex, or take them from ``data``: a row per concentration with its subject's first dose; without either, of the example study.

    TIME is in hours since that dose, CONC the reported text, GROUP the arm.
    """
    domains = upper_domains(data or _read(spark, db, NCA_TABLES, format))
    domains.setdefault("adsl", domains["dm"])
    firsts = first_doses(expand_doses(prepare_ex(domains)))
    rows = prepare_pc(domains).join(firsts, [*SUBJECT, "DRUG"])
    arms = domains["dm"].select(*SUBJECT, F.col("ARM").alias("GROUP"))
    return rows.select(*SUBJECT, "DRUG", hours_between(F.col("ADTM"), F.col("FANLDTM")).alias("TIME"), F.col("PCSTRESC").alias("CONC"), F.col("EXDOSE_first").cast("double").alias("DOSE")).join(arms, SUBJECT, "left")
