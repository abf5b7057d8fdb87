"""Event-style modeling tables: dose rows (EVID 1), observations (EVID 0), others (EVID 2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import r_ifelse, upper_names


@dataclass(frozen=True)
class Dictionary:
    """Physical names of a dataset's logical columns."""

    subject_id: str = "USUBJID"
    time: str = "TIME"
    dose: str = "DOSE"
    conc: str = "CONC"
    group: str | None = None


def modeling_to_modeling(df: DataFrame, dictionary: Dictionary | None = None, keep_existing_group: bool = False) -> DataFrame:
    """Names in upper case, DV zero off observations, MDV added where absent, and GROUP.

    GROUP is the dictionary's group column (its upper-case name), else 1; an
    existing GROUP is overwritten unless ``keep_existing_group``.  A null EVID
    gives null DV and MDV.
    """
    out = upper_names(df)
    observed = F.col("EVID") == 0
    names = {c.upper() for c in df.columns}
    new = {"DV": r_ifelse(observed, F.col("DV").cast("double"), F.lit(0.0))}
    if "MDV" not in names:
        new["MDV"] = r_ifelse(observed, F.lit(0), F.lit(1))
    if not (keep_existing_group and "GROUP" in names):
        new["GROUP"] = F.col(dictionary.group.upper()) if dictionary and dictionary.group else F.lit(1)
    return out.withColumns(new)


def modeling_to_nca(df: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """Observation rows with DOSE: the amount of the subject's latest dose at or before the row's time.

    Other events are dropped.  Rows before any dose have a null DOSE; of doses
    at one time the one with the greatest amount counts.
    """
    out = upper_names(df).where(F.col("EVID").isin(0, 1))
    frame = Window.partitionBy("ID").orderBy(F.col("TIME").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max(F.when((F.col("EVID") == 1) & F.col("TIME").isNotNull(), F.struct("TIME", "AMT"))).over(frame)
    return out.withColumn("DOSE", F.when(F.col("TIME").isNotNull(), latest["AMT"])).where("EVID = 0")
