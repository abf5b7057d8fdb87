"""Made example data: a small study's domains, and event rows with times near nominal ones.

The same on every run: values are hashes of the row's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SUBJECTS = 60
#: Nominal hours of the samples.
HOURS = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 12.0, 24.0)


def _unit(stream: int, *columns: str) -> Column:
    """In [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(stream), *columns), F.lit(1_000_003)) / F.lit(1_000_003.0)


def example_domains(spark: SparkSession, subjects: int = SUBJECTS) -> dict[str, DataFrame]:
    """``pc, ex, adsl, dm, vs, lb`` of a study of one drug, a dose a subject, with samples up to a day."""
    at = lambda hours: F.date_format(F.timestamp_seconds(F.lit(1577865600) + F.col("id") % 9 * 86400 + F.round(hours * 3600).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
    people = spark.range(1, subjects + 1).select(
        "id", F.lit("01").alias("STUDYID"), F.concat(F.lit("01-7"), (F.col("id") % 3).cast("string"), F.lit("-"), (F.col("id") + 1000).cast("string")).alias("USUBJID"),
        F.element_at(F.array(F.lit("PLACEBO"), F.lit("LOW DOSE"), F.lit("HIGH DOSE")), (F.col("id") % 3 + 1).cast("int")).alias("ARM"),
    )
    who = ["STUDYID", "USUBJID"]
    adsl = people.select(
        *who, (F.col("id") + 1000).cast("string").alias("SUBJID"), F.concat(F.lit("7"), (F.col("id") % 3).cast("string")).alias("SITEID"), F.floor(20 + 50 * _unit(1, "id")).cast("double").alias("AGE"), F.when(_unit(2, "id") < 0.5, "F").otherwise("M").alias("SEX"),
        F.element_at(F.array(F.lit("WHITE"), F.lit("ASIAN"), F.lit("BLACK OR AFRICAN AMERICAN")), (F.floor(3 * _unit(3, "id")) + 1).cast("int")).alias("RACE"), F.when(_unit(4, "id") < 0.2, "HISPANIC OR LATINO").otherwise("NOT HISPANIC OR LATINO").alias("ETHNIC"), "ARM", F.col("ARM").alias("ACTARM"),
        F.element_at(F.array(F.lit("USA"), F.lit("DEU")), (F.col("id") % 2 + 1).cast("int")).alias("COUNTRY"),
    )
    dose = F.when(F.col("ARM") == "PLACEBO", 0.0).when(F.col("ARM") == "LOW DOSE", 50.0).otherwise(100.0)
    ex = people.select(
        *who, F.lit("EX").alias("DOMAIN"), F.lit(1).alias("EXSEQ"), F.lit("DRUGX").alias("EXTRT"), dose.alias("EXDOSE"), F.lit("mg").alias("EXDOSU"), F.lit("ONCE").alias("EXDOSFRQ"), F.lit("TABLET").alias("EXDOSFRM"), F.lit("ORAL").alias("EXROUTE"), at(F.lit(0.0)).alias("EXSTDTC"), at(F.lit(0.0)).alias("EXENDTC"),
        F.lit("DAY 1").alias("VISIT"), F.lit(1.0).alias("VISITNUM"), F.lit(1).alias("VISITDY"),
    )
    hour = F.col("nominal") + F.when(F.col("nominal") > 0, 0.2 * _unit(5, "id", "nominal")).otherwise(-0.1)
    value = F.round(dose * (F.exp(-0.1 * hour) - F.exp(-1.2 * hour)) * (0.7 + 0.6 * _unit(6, "id", "nominal")), 3)
    samples = people.withColumn("nominal", F.explode(F.array(*[F.lit(h) for h in HOURS]))).withColumn("value", F.when(value >= 1, value))
    pc = samples.select(
        *who, F.lit("PC").alias("DOMAIN"), F.lit("DRUGX").alias("PCTESTCD"), F.lit("DRUGX").alias("PCTEST"), at(hour).alias("PCDTC"), F.col("nominal").alias("PCTPTNUM"), F.coalesce(F.col("value").cast("string"), F.lit("<BLQ")).alias("PCSTRESC"), F.col("value").alias("PCSTRESN"), F.lit("ug/ml").alias("PCSTRESU"), F.lit(1.0).alias("PCLLOQ"),
    )
    sign = lambda name, low, width, stream: F.struct(F.lit(name).alias("name"), F.round(low + width * _unit(stream, "id"), 1).alias("value"))
    vs = people.select("*", F.explode(F.array(sign("Height", 150.0, 40.0, 7), sign("Weight", 50.0, 50.0, 8))).alias("x")).select(
        *who, F.col("x.name").alias("VSTEST"), F.upper("x.name").alias("VSTESTCD"), F.col("x.value").cast("string").alias("VSSTRESC"), F.col("x.value").alias("VSSTRESN"), F.lit("Y").alias("VSBLFL")
    )
    lb = people.select("*", F.explode(F.array(sign("CREAT", 55.0, 60.0, 9), sign("ALT", 8.0, 40.0, 10), sign("AST", 8.0, 35.0, 11), sign("BILI", 4.0, 15.0, 12))).alias("x")).select(*who, F.col("x.name").alias("LBTESTCD"), F.col("x.value").alias("LBSTRESN"), F.lit("Y").alias("LBBLFL"))
    return {"pc": pc, "ex": ex, "adsl": adsl, "dm": adsl, "vs": vs, "lb": lb}


def nm_data_timepoints(spark: SparkSession) -> DataFrame:
    """3,600 event rows of 20 columns, with TIME a little after 0, 21, 42 and 63."""
    rows = spark.range(3600)
    subject, nth = F.floor(F.col("id") / 20), F.col("id") % 20
    cycle = F.floor(nth / 5)
    late = F.when(nth == 0, 0.0).otherwise(0.8 * _unit(20, "id"))
    dosed = nth % 5 == 0
    return rows.select(
        (subject + 1).cast("int").alias("ID"), (21 * cycle + late).alias("TIME"), F.when(dosed, 0.0).otherwise(F.round(5 + 90 * _unit(21, "id"), 2)).alias("DV"), F.when(dosed, 100.0).otherwise(0.0).alias("AMT"), dosed.cast("int").alias("EVID"), dosed.cast("int").alias("MDV"), F.lit(1).alias("CMT"),
        F.lit(0).alias("SS"), F.lit(0.0).alias("II"), F.lit(0.0).alias("RATE"), (cycle + 1).cast("int").alias("CYCLE"), F.lit("ng/mL").alias("DVU"), F.lit("DRUGX").alias("DRUG"), (subject % 3 + 1).cast("int").alias("GROUP"), F.floor(20 + subject % 50).cast("double").alias("AGE"),
        (subject % 2 + 1).cast("int").alias("SEX"), (50 + subject % 45).cast("double").alias("WT"), (150 + subject % 40).cast("double").alias("HT"), (subject % 4 + 1).cast("int").alias("RACE"), (60 + subject % 70).cast("double").alias("CRCL"),
    )
