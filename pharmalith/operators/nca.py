"""From one row per concentration to event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import is_blq_text, number_rows, try_number
from ..sources.shared import written
from .modeling import Dictionary

#: DV of a sample below quantification, dropped at the end.
BELOW = -99.0
_DOUBLES = (T.DoubleType, T.FloatType, T.DecimalType)


def event_rows(df: DataFrame, dictionary: Dictionary, dose_compartment: int = 1, obs_compartment: int = 1, covariates: Sequence[str] = (), order_by: str | None = None) -> DataFrame:
    """Dose rows (the first row of each subject and group, at time 0) and sample rows, with ID by first appearance."""
    group = dictionary.group or "GROUP"
    if "ID" in covariates:
        raise ValueError("a covariate can't be named ID")
    if group not in df.columns:
        df = df.withColumn(group, F.lit(1))
    order = F.col(order_by).cast("long") if order_by else F.monotonically_increasing_id()
    base = df.withColumn("_ord", order)
    keyed = [F.col(dictionary.subject_id).alias("ORIGID"), F.col(group).alias("GROUP")]
    extra = [F.col(c) for c in covariates]
    ids = number_rows(base.groupBy(F.col(dictionary.subject_id).alias("_subject")).agg(F.min("_ord").alias("_first")), ["_first"], "ID").select("_subject", F.col("ID").cast("int").alias("ID"))
    conc = F.col(dictionary.conc)
    if isinstance(df.schema[dictionary.conc].dataType, T.StringType):
        dv = F.when(is_blq_text(conc), F.lit(BELOW)).otherwise(try_number(conc))
    else:
        dv = conc.cast("double")
    samples = base.select(*keyed, F.col(dictionary.time).cast("double").alias("TIME"), dv.alias("DV"), F.lit(0.0).alias("AMT"), F.lit(0.0).alias("EVID"), F.lit(0.0).alias("MDV"), F.lit(float(obs_compartment)).alias("CMT"), *extra, F.lit(1).alias("_src"), "_ord")
    first = base.groupBy(*keyed).agg(F.min(F.struct("_ord", F.col(dictionary.dose).cast("double").alias("AMT"), *extra)).alias("x"))
    doses = first.select(
        "ORIGID", "GROUP", F.lit(0.0).alias("TIME"), F.lit(0.0).alias("DV"), F.col("x.AMT").alias("AMT"), F.lit(1.0).alias("EVID"), F.lit(1.0).alias("MDV"), F.lit(float(dose_compartment)).alias("CMT"), *[F.col(f"x.{c}").alias(c) for c in covariates], F.lit(0).alias("_src"), F.col("x._ord").alias("_ord")
    )
    both = doses.unionByName(samples)
    return both.join(ids, both["ORIGID"].eqNullSafe(ids["_subject"]), "left").drop("_subject")


def place(group: str = "GROUP") -> "F.Column":
    """A row's place: by group, ID, time, doses first, then as it came; nulls last."""
    last = lambda c: [F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(f"{c}_at")]
    return F.struct(*last(group), *last("ID"), *last("TIME"), (-F.col("EVID")).alias("events"), F.col("_src"), F.col("_ord"))


def recode_by_first_place(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by 1, 2, ... in the order in which its values first appear; null gets a code too.

    All columns' values are gathered in one aggregate, numbered together, and
    joined back one by one.
    """
    if not columns:
        return df
    df = written(df.withColumn("_place", place()), "placed")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("value")) for k, c in enumerate(columns)])
    firsts = df.select("_place", F.explode(pairs).alias("x")).groupBy("x.k", "x.value").agg(F.min("_place").alias("place"))
    numbered = written(number_rows(firsts, ["k", "place"], "n").select("k", "value", "n"), "codes")
    starts = {r.k: r.first for r in numbered.groupBy("k").agg(F.min("n").alias("first")).collect()}
    for k, c in enumerate(columns):
        codes = numbered.where(F.col("k") == k).select(F.col("value").alias("_value"), (F.col("n") - starts.get(k, 0) + 1).cast("int").alias("_code"))
        df = df.join(codes, F.col(c).cast("string").eqNullSafe(F.col("_value")), "left").withColumn(c, F.col("_code")).drop("_value", "_code")
    return df.drop("_place")


def nca_to_modeling(df: DataFrame, dictionary: Dictionary, dose_compartment: int = 1, obs_compartment: int = 1, covariates: Sequence[str] = (), order_by: str | None = None, ordered: bool = False) -> DataFrame:
    """Event rows from concentration rows: ID, TIME, CMT, EVID, MDV, DV, AMT, GROUP, ORIGID, covariates.

    Columns that are not doubles become codes by first appearance.  Samples
    below quantification (text with ``<`` or a letter) and without a number are
    dropped after coding, so codes may have gaps; dose rows stay.
    """
    rows = event_rows(df, dictionary, dose_compartment, obs_compartment, covariates, order_by)
    names = ["ID", "TIME", "CMT", "EVID", "MDV", "DV", "AMT", "GROUP", "ORIGID", *covariates]
    coded = recode_by_first_place(rows, [c for c in names if not isinstance(rows.schema[c].dataType, _DOUBLES)])
    out = coded.where(F.col("DV") != BELOW)
    if ordered:
        out = out.orderBy(F.col("GROUP").asc_nulls_last(), F.col("ID").asc_nulls_last(), F.col("TIME").asc_nulls_last(), F.desc("EVID"), "_src", "_ord")
    return out.select(*names)
