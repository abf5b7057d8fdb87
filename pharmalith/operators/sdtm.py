"""From study domains (pc, ex, adsl, vs, lb) to a population modeling table.

Two plans.  ``sdtm_to_modeling`` gives the 18 output columns and computes what
they and their rows depend on, nothing else.  ``sdtm_to_adppk`` gives the full
derivation: previous dose, relative times, analysis variables and covariates.

Both deal doses and samples by subject once: the first dose, the dose before and
the windows per subject and drug are all within that partitioning.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import coded_by_level, hours_between, to_datetime, upper_names

Domains = dict[str, DataFrame]

SUBJECT = ["STUDYID", "USUBJID"]
#: The subject table's columns that derivations may need, and the columns of the modeling table.
ADSL_VARS = ["TRTSDT", "TRTSDTM", "TRT01P", "TRT01A"]
OUTPUT = ["ID", "TIME", "DV", "MDV", "EVID", "SS", "II", "AMT", "SEXN", "AGE", "WT", "ROUTE", "FORM", "COHORT", "SITEID", "RACE", "ETHNIC", "COUNTRY"]
#: Parameters by code, as (name, number).
PARAMETERS = {"DRUGX": ("concentration of DrugX", 1), "DOSE": ("DrugX Dose", 2)}
#: Helper columns that the full derivation leaves out, by name, beginning and end, in any case.
HELPERS = {"DOMAIN", "DRUG"}
HELPER_STARTS = ("MIN", "MAX", "EX", "PC", "VISIT", "AVISIT", "PARAM", "TRT", "ATPT")
HELPER_ENDS = ("FIRST", "PREV", "DTM", "DT", "TM", "TMF")
#: The subject's columns of the full derivation.
COVARIATES = [
    "STUDYIDN", "SITEID", "SITEIDN", "USUBJIDN", "SUBJID", "SUBJIDN", "AGE", "SEX", "SEXN", "COHORT", "COHORTC", "RACE", "RACEN", "ETHNIC", "ETHNICN", "COUNTRY", "COUNTRYN",
    "HTBL", "WTBL", "CREATBL", "ALTBL", "ASTBL", "TBILBL", "BMIBL", "BSABL", "CRCLBL", "EGFRBL",
]

_HOURS = {"MINUTE": 1 / 60, "HOUR": 1.0, "DAY": 24.0, "WEEK": 168.0, "MONTH": 730.5, "YEAR": 8766.0}


def _frequencies() -> dict[str, float]:
    """Hours between doses of every dosing frequency that says them, by the rules that the public terms are made by; a single dose has none."""
    out = {"ONCE": 0.0, "1 TIME": 0.0}
    # times in a unit, and every so many units
    for unit, hours in _HOURS.items():
        out |= {f"EVERY {unit}": hours, f"1 TIME PER {unit}": hours, f"EVERY OTHER {unit}": 2 * hours}
        out |= {f"{n} TIMES PER {unit}": hours / n for n in range(2, 13)} | {f"EVERY {n} {unit}S": n * hours for n in range(2, 61)}
        out |= {f"{n} DAYS PER {unit}": hours / n for n in range(1, 31)} if unit in ("MONTH", "YEAR") else {}
    for letter, unit in (("H", "HOUR"), ("D", "DAY"), ("W", "WEEK"), ("M", "MONTH"), ("Y", "YEAR"), ("MIN", "MINUTE")):
        out |= {f"Q{n}{letter}": n * _HOURS[unit] for n in range(1, 100)} | {f"Q{letter}": _HOURS[unit]}
    # names of their own
    out |= {"BID": 12.0, "TID": 8.0, "QID": 6.0, "QOD": 48.0, "QAM": 24.0, "QPM": 24.0, "QHS": 24.0, "QN": 24.0, "QS": 168.0, "BIS": 84.0, "BIM": 365.25, "PA": 8766.0}
    out |= {f"EVERY {x}": 24.0 for x in ("MORNING", "AFTERNOON", "EVENING", "NIGHT")}
    return out


FREQUENCIES = _frequencies()


def with_dosing_interval(df: DataFrame, frequency: str, out: str) -> DataFrame:
    """Adds the hours between doses; zero for a single dose or a missing frequency.

    A frequency that doesn't say them raises when it is computed.  The lookup is
    joined as what it is, a fixed table of about a thousand rows.
    """
    table = F.explode(F.from_json(F.lit(json.dumps(FREQUENCIES)), "map<string,double>")).alias("_term", "_hours")
    joined = df.join(F.broadcast(df.sparkSession.range(1, numPartitions=1).select(table)), F.upper(F.trim(frequency)) == F.col("_term"), "left")
    text = F.concat(F.lit("no interval is known for the dosing frequency "), F.col(frequency))
    hours = F.when(F.col(frequency).isNull(), F.lit(0.0)).when(F.col("_hours").isNull(), F.raise_error(text).cast("double")).otherwise(F.col("_hours"))
    return joined.withColumn(out, hours).drop("_term", "_hours")


def upper_domains(data: Domains) -> Domains:
    """Domains by lower-case name, with upper-case columns."""
    return {k.lower(): upper_names(v) for k, v in data.items()}


def _with_adsl(df: DataFrame, adsl: DataFrame) -> DataFrame:
    """Left join of the subject's treatment columns that ADSL has and ``df`` has not."""
    own = [c for c in ADSL_VARS if c in adsl.columns and c not in df.columns]
    return df.join(adsl.select(*SUBJECT, *own), SUBJECT, "left") if own else df


def prepare_pc(data: Domains) -> DataFrame:
    """Samples: date and time, drug, nominal time (negative ones are 0), EVID 0."""
    pc = _with_adsl(data["pc"], data["adsl"])
    at = to_datetime(F.col("PCDTC"))
    nominal = F.when(F.col("PCTPTNUM") < 0, F.lit(0.0)).otherwise(F.col("PCTPTNUM").cast("double"))
    return pc.withColumns({"ADTM": at, "ADT": F.to_date(at), "EVID": F.lit(0), "DRUG": F.col("PCTEST"), "NFRLT": nominal})


def prepare_ex(data: Domains) -> DataFrame:
    """Dosing records above zero: start and end (the start where missing), nominal time of the visit, EVID 1."""
    ex = _with_adsl(data["ex"].where("EXDOSE > 0"), data["adsl"])
    start = to_datetime(F.col("EXSTDTC"))
    end = F.coalesce(to_datetime(F.col("EXENDTC")), start)
    return ex.withColumns({"ASTDTM": start, "AENDTM": end, "ASTDT": F.to_date(start), "AENDT": F.to_date(end), "EVID": F.lit(1), "NFRLT": (24 * (F.col("VISITDY") - 1)).cast("double")})


def expand_doses(ex: DataFrame, first_day_only: bool = True) -> DataFrame:
    """One row per dose of a record: ADTM, ADT, NFRLT, AVISITN, AVISIT, DRUG.

    A single dose (ONCE, or no frequency) is one row; others are as many as
    fit into the days from start to end, both counted, rounded up.  An unknown
    frequency raises.  With ``first_day_only`` the doses after nominal day 1 are
    never made.
    """
    step = F.col("_step")
    ex = with_dosing_interval(ex, "EXDOSFRQ", "_step")
    days = F.coalesce(F.datediff("AENDT", "ASTDT") + 1, F.lit(1))
    n = F.when(step == 0, F.lit(1)).otherwise(F.greatest(F.ceil(days * 24 / step - 1e-9), F.lit(1))).cast("int")
    if first_day_only:
        # doses k with NFRLT + k * step in [0, 24)
        left = F.when(step > 0, F.ceil((24 - F.col("NFRLT")) / step)).otherwise(F.lit(1))
        n = F.when(F.col("NFRLT") >= 24, F.lit(0)).otherwise(F.least(n, left)).cast("int")
    rows = ex.withColumn("_n", n).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    shift = F.col("_k") * step
    at = F.when(F.col("_k") == 0, F.col("ASTDTM")).otherwise((F.timestamp_micros(F.unix_micros(F.col("ASTDTM").cast("timestamp")) + (shift * 3600000000).cast("long"))).cast("timestamp_ntz"))
    rows = rows.withColumns({"ADTM": at, "NFRLT": F.col("NFRLT") + shift})
    day = F.floor(F.col("NFRLT") / 24) + 1
    out = rows.withColumns({"ADT": F.to_date("ADTM"), "AVISITN": day.cast("int"), "AVISIT": F.concat(F.lit("Day "), day.cast("string")), "DRUG": F.col("EXTRT")}).drop("_n", "_k", "_step")
    return out.where("AVISITN = 1") if first_day_only else out


def first_doses(doses: DataFrame) -> DataFrame:
    """Per subject and drug: the first dose's time and amount (by ADTM, EXSEQ)."""
    first = F.min(F.struct("ADTM", "EXSEQ", "EXDOSE"))
    dated = doses.where("ADTM is not null").groupBy(*SUBJECT, "DRUG").agg(first.alias("x"))
    return dated.select(*SUBJECT, "DRUG", F.col("x.ADTM").alias("FANLDTM"), F.col("x.EXDOSE").alias("EXDOSE_first"))


def previous_dose(samples: DataFrame, doses: DataFrame) -> DataFrame:
    """Samples with the subject's last dose strictly before, of any drug: ADTM_prev, EXDOSE_prev, AVISIT_prev, AENDTM_prev.

    Of doses at one time the one with the greatest EXSEQ counts.
    """
    return asof_strict(samples, doses, "USUBJID", "ADTM", {"ADTM": "ADTM_prev", "EXDOSE": "EXDOSE_prev", "AVISIT": "AVISIT_prev", "AENDTM": "AENDTM_prev"}, "EXSEQ")


def previous_nominal(samples: DataFrame, doses: DataFrame) -> DataFrame:
    """Samples with the subject's greatest nominal dose time strictly below their own: NFRLT_prev."""
    return asof_strict(samples, doses, "USUBJID", "NFRLT", {"NFRLT": "NFRLT_prev"}, None)


def asof_strict(left: DataFrame, right: DataFrame, key: str, at: str, take: dict[str, str], tie: str | None) -> DataFrame:
    """As-of join backward, strict, by a window over the union: each row of ``left`` meets the last of ``right`` before it.

    One shuffle by key and no pairs.  ``at`` is a time or a number; equal times
    are not before.  Null times meet nothing.
    """
    number = (lambda c: F.unix_micros(c.cast("timestamp"))) if dict(left.dtypes)[at].startswith("timestamp") else (lambda c: c.cast("double"))
    near = F.struct(F.col(at).alias("_when"), *([F.col(tie).alias("_tie")] if tie else []), *[F.col(c).alias(f"_{c}") for c in take])
    marked = left.withColumns({"_side": F.lit(1), "_at": number(F.col(at)), "_right": F.lit(None).cast(right.select(near.alias("x")).schema["x"].dataType)})
    other = right.where(F.col(at).isNotNull()).select(F.col(key), F.lit(0).alias("_side"), number(F.col(at)).alias("_at"), near.alias("_right"))
    both = marked.unionByName(other, allowMissingColumns=True)
    frame = Window.partitionBy(key).orderBy("_at")
    before = frame.rangeBetween(Window.unboundedPreceding, -1) if dict(left.dtypes)[at].startswith("timestamp") else None
    if before is None:
        # ranges of doubles have no least step: order by distinct times, then take those below
        both = both.withColumn("_step", F.dense_rank().over(frame))
        before = Window.partitionBy(key).orderBy("_step").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_found", F.when(F.col("_at").isNotNull(), F.max("_right").over(before))).where("_side = 1")
    return found.withColumns({new: F.col(f"_found._{c}") for c, new in take.items()}).drop("_side", "_at", "_right", "_found", "_step")


def timeline(data: Domains, full: bool = False) -> DataFrame:
    """Samples and doses of each subject and drug with AFRLT; with ``full`` also previous doses and the times relative to them.

    Samples of drugs never dosed are left out, and so are doses after the day
    of the last sample.  Samples and doses are dealt by subject once; first,
    previous and last rows are windows there, and so are those that follow.
    """
    samples = prepare_pc(data)
    day = F.floor(F.col("NFRLT") / 24) + 1
    samples = samples.withColumns({"AVISITN": day.cast("int"), "AVISIT": F.concat(F.lit("Day "), day.cast("string"))})
    both = samples.unionByName(expand_doses(prepare_ex(data)), allowMissingColumns=True).repartition("USUBJID")
    dose, drug = F.col("EVID") == 1, Window.partitionBy(*SUBJECT, "DRUG")
    first = F.min(F.when(dose & F.col("ADTM").isNotNull(), F.struct("ADTM", "EXSEQ", "EXDOSE"))).over(drug)
    both = both.withColumn("_first", first).where(dose | F.col("_first").isNotNull()).withColumn("EXDOSE_first", F.when(~dose, F.col("_first.EXDOSE"))).drop("_first")
    if full:
        both = _previous(both, dose)
    own = Window.partitionBy("USUBJID", "DRUG")
    both = both.withColumns({"FANLDTM": F.min(F.when(dose, F.col("ADTM"))).over(own), "min_NFRLT": F.min("NFRLT").over(own), "maxdate": F.max(F.when(F.col("EVID") == 0, F.col("ADT"))).over(own)})
    out = both.where("ADT <= maxdate").withColumn("AFRLT", hours_between(F.col("ADTM"), F.col("FANLDTM")))
    if not full:
        return out
    since = hours_between(F.col("ADTM"), F.col("ADTM_prev"))
    return out.withColumns(
        {
            "APRLT": F.when(dose, F.lit(0.0)).when(since.isNull(), F.col("AFRLT")).otherwise(since),
            "NPRLT": F.when(dose, F.lit(0.0)).when(F.col("NFRLT_prev").isNull(), F.col("NFRLT") - F.col("min_NFRLT")).otherwise(F.col("NFRLT") - F.col("NFRLT_prev")),
            "ROUTE": F.col("EXROUTE"), "FORM": F.col("EXDOSFRM"),
        }
    )


def _previous(both: DataFrame, dose: Column) -> DataFrame:
    """Adds to samples what ``previous_dose`` and ``previous_nominal`` add, where samples and doses are in one table."""
    at = F.unix_micros(F.col("ADTM").cast("timestamp"))
    near = F.when(dose & F.col("_at").isNotNull(), F.struct(F.col("ADTM").alias("a"), F.col("EXSEQ").alias("b"), F.col("EXDOSE").alias("c"), F.col("AVISIT").alias("d"), F.col("AENDTM").alias("e")))
    before = Window.partitionBy("USUBJID").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    # ranges of doubles have no least step: nominal times are ranked first
    ranked = Window.partitionBy("USUBJID").orderBy("NFRLT")
    below = Window.partitionBy("USUBJID").orderBy("_rank").rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_at", at).withColumns({"_near": F.max(near).over(before), "_rank": F.dense_rank().over(ranked)})
    out = out.withColumn("_below", F.max(F.when(dose, F.col("NFRLT"))).over(below))
    sample = ~dose
    taken = {new: F.when(sample & F.col("_at").isNotNull(), F.col(f"_near.{c}")) for new, c in (("ADTM_prev", "a"), ("EXDOSE_prev", "c"), ("AVISIT_prev", "d"), ("AENDTM_prev", "e"))}
    return out.withColumns({**taken, "NFRLT_prev": F.when(sample & F.col("NFRLT").isNotNull(), F.col("_below"))}).drop("_at", "_near", "_rank", "_below")


def analysis_variables(rows: DataFrame) -> DataFrame:
    """Dose and observation variables of a full timeline."""
    dose = F.col("EVID") == 1
    dv = F.when(~dose, F.col("PCSTRESN").cast("double"))
    below = F.col("PCSTRESC") == "<BLQ"
    return rows.withColumns(
        {
            "DOSEA": F.when(dose, F.col("EXDOSE")).when(F.col("EXDOSE_prev").isNull(), F.col("EXDOSE_first")).otherwise(F.col("EXDOSE_prev")),
            "PARAMCD": F.when(dose, F.lit("DOSE")).otherwise(F.col("PCTESTCD")), "ALLOQ": F.col("PCLLOQ"), "CMT": F.when(dose, F.lit(1)).otherwise(F.lit(2)),
            "BLQFL": F.when(below, F.lit("Y")).otherwise(F.lit("N")), "BLQFN": F.when(below, F.lit(1)).otherwise(F.lit(0)),
            "AMT": F.when(dose, F.col("EXDOSE").cast("double")), "DV": dv, "AVAL": dv, "DVL": F.when(dv != 0, F.ln(dv)), "MDV": F.when(dose | dv.isNull(), F.lit(1)).otherwise(F.lit(0)),
            "AVALU": F.when(~dose, F.col("PCSTRESU")), "UDTC": F.date_format("ADTM", "yyyy-MM-dd'T'HH:mm:ss"), "II": F.lit(0.0), "SS": F.lit(0.0),
        }
    )


def unique_events(rows: DataFrame) -> DataFrame:
    """``rows``, which raise when they are computed if two of a subject tie in AFRLT and EVID. No pass of its own."""
    key = [*SUBJECT, "AFRLT", "EVID"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    text = F.concat_ws(" ", F.lit("events are not unique by subject, AFRLT and EVID:"), *[F.col(c).cast("string") for c in key])
    return rows.withColumn("_n", n).withColumn("EVID", F.when(F.col("_n") > 1, F.raise_error(text).cast("int")).otherwise(F.col("EVID"))).drop("_n")


def number_observations(rows: DataFrame, validate: bool = True) -> DataFrame:
    """ASEQ: a row's number within its subject by AFRLT and EVID. With ``validate`` rows that tie raise (see ``unique_events``)."""
    order = Window.partitionBy(*SUBJECT).orderBy(F.col("AFRLT").asc_nulls_last(), "EVID")
    return (unique_events(rows) if validate else rows).withColumn("ASEQ", F.row_number().over(order))


def coded_subjects(adsl: DataFrame) -> DataFrame:
    """ADSL with numbers out of USUBJID, sex codes, codes by sorted level, and the cohort."""
    part = lambda k: F.try_element_at(F.split("USUBJID", "-"), F.lit(k)).try_cast("double")
    out = adsl.withColumns({"STUDYIDN": part(1), "SITEIDN": part(2), "USUBJIDN": part(3), "SUBJIDN": F.col("SUBJID").cast("string").try_cast("double"), "SEXN": sex_code()})
    out = coded_by_level(out, {c: f"{c}N" for c in ("RACE", "ETHNIC", "ARM", "ACTARM", "COUNTRY")})
    return out.withColumns({"COHORT": F.col("ARMN"), "COHORTC": F.col("ARM")})


def sex_code() -> Column:
    return F.when(F.col("SEX") == "M", F.lit(1)).when(F.col("SEX") == "F", F.lit(2)).otherwise(F.lit(3))


def baseline_vitals(vs: DataFrame, validate: bool = True) -> DataFrame:
    """HTBL and WTBL per subject, in one pass. With ``validate`` a subject with two heights, or two baseline weights, raises when computed."""
    def only(value: Column, what: str) -> Column:
        most = F.max(value)
        return F.when(F.count(value) > 1, F.raise_error(F.concat(F.lit(f"more than one {what} of "), F.first("USUBJID"))).cast("double")).otherwise(most) if validate else most

    height = F.when(F.col("VSTESTCD") == "HEIGHT", F.col("VSSTRESN").cast("double"))
    weight = F.when((F.col("VSTESTCD") == "WEIGHT") & (F.col("VSBLFL") == "Y"), F.col("VSSTRESN").cast("double"))
    return vs.groupBy(*SUBJECT).agg(only(height, "height").alias("HTBL"), only(weight, "baseline weight").alias("WTBL"))


def baseline_labs(lb: DataFrame) -> DataFrame:
    """CREATBL, ALTBL, ASTBL and TBILBL per subject, wide."""
    kept = lb.where((F.col("LBBLFL") == "Y") & F.col("LBTESTCD").isin("CREAT", "ALT", "AST", "BILI"))
    wide = kept.groupBy(*SUBJECT).pivot("LBTESTCD", ["CREAT", "ALT", "AST", "BILI"]).agg(F.max(F.col("LBSTRESN").cast("double")))
    return wide.withColumnsRenamed({"CREAT": "CREATBL", "ALT": "ALTBL", "AST": "ASTBL", "BILI": "TBILBL"})


def body_and_renal(subjects: DataFrame) -> DataFrame:
    """BMIBL, BSABL (Mosteller), CRCLBL (Cockcroft-Gault) and EGFRBL (CKD-EPI 2021); creatinine in micromoles a litre."""
    h, w, age, mg = F.col("HTBL"), F.col("WTBL"), F.col("AGE").cast("double"), F.col("CREATBL") / 88.42
    female = F.col("SEX") == "F"
    ratio = mg / F.when(female, 0.7).otherwise(0.9)
    return subjects.withColumns(
        {
            "BMIBL": w / F.pow(h / 100, F.lit(2.0)), "BSABL": F.sqrt(h * w / 3600), "CRCLBL": (140 - age) * w * F.when(female, 0.85).otherwise(1.0) / (72 * mg),
            "EGFRBL": 142 * F.pow(F.least(ratio, F.lit(1.0)), F.when(female, -0.241).otherwise(-0.302)) * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2)) * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0),
        }
    )


def covariates(data: Domains, validate: bool = True) -> DataFrame:
    """A row per subject with all codes, vitals, labs and derived metrics."""
    out = coded_subjects(data["adsl"]).join(baseline_vitals(data["vs"], validate), SUBJECT, "left").join(baseline_labs(data["lb"]), SUBJECT, "left")
    return body_and_renal(out)


def without_helpers(df: DataFrame) -> DataFrame:
    """Leaves out the columns that only help the derivation (``HELPERS`` and the like)."""
    helper = lambda c: c.upper() in HELPERS or c.upper().startswith(HELPER_STARTS) or c.upper().endswith(HELPER_ENDS)
    return df.drop(*[c for c in df.columns if helper(c)])


def sdtm_to_adppk(data: Domains, validate: bool = True, parameters: dict[str, tuple[str, int]] = PARAMETERS, helpers: bool = False) -> DataFrame:
    """The full derivation, a row per event: event columns, PROJID, and the subject's ``COVARIATES``.

    ``parameters`` names the codes' PARAM and PARAMN.  These and other columns
    on the way are left out unless ``helpers``.
    """
    data = upper_domains(data)
    rows = number_observations(analysis_variables(timeline(data, full=True)), validate)
    name, number = (F.create_map(*[F.lit(x) for k, v in parameters.items() for x in (k, v[i])]) for i in (0, 1))
    rows = rows.withColumns({"PARAM": F.try_element_at(name, F.col("PARAMCD")), "PARAMN": F.try_element_at(number, F.col("PARAMCD")), "PROJID": F.col("DRUG"), "PROJIDN": F.lit(1)})
    if not helpers:
        rows = without_helpers(rows)
    shared = {c for c in rows.columns if c not in SUBJECT}
    subjects = covariates(data, validate).select(*SUBJECT, *[c for c in COVARIATES if c not in shared])
    out = rows.join(subjects, SUBJECT, "left")
    return out.withColumns({"ROUTE": F.lower("ROUTE"), "FORM": F.lower("FORM")}).where(~(F.col("DV").isNull() & (F.col("EVID") == 0)))


def sdtm_to_modeling(data: Domains, dictionary: object = None, validate: bool = True, ordered: bool = False) -> DataFrame:
    """The 18 columns of the modeling table. ``dictionary`` is accepted and not used.

    With ``validate``, events of a subject that tie in AFRLT and EVID raise
    when the rows are computed, and so do repeated vitals, within the one plan.
    """
    data = upper_domains(data)
    rows = unique_events(timeline(data)) if validate else timeline(data)
    dose = F.col("EVID") == 1
    dv = F.when(~dose, F.col("PCSTRESN").cast("double"))
    subjects = data["adsl"].select(*SUBJECT, F.col("SUBJID").alias("ID"), sex_code().alias("SEXN"), F.col("AGE").cast("double").alias("AGE"), F.col("ARM").alias("COHORT"), "SITEID", "RACE", "ETHNIC", "COUNTRY")
    subjects = subjects.join(baseline_vitals(data["vs"], validate).select(*SUBJECT, F.col("WTBL").alias("WT")), SUBJECT, "left")
    events = rows.select(
        *SUBJECT, F.col("NFRLT").alias("TIME"), dv.alias("DV"), F.when(dose | dv.isNull(), F.lit(1)).otherwise(F.lit(0)).alias("MDV"), "EVID", F.lit(0.0).alias("SS"), F.lit(0.0).alias("II"), F.when(dose, F.col("EXDOSE").cast("double")).alias("AMT"),
        F.lower("EXROUTE").alias("ROUTE"), F.lower("EXDOSFRM").alias("FORM"), "AFRLT",
    ).where(~(F.col("DV").isNull() & (F.col("EVID") == 0)))
    out = events.join(subjects, SUBJECT, "left")
    if ordered:
        part = lambda k: F.try_element_at(F.split("USUBJID", "-"), F.lit(k)).try_cast("double").asc_nulls_last()
        out = out.orderBy(part(1), part(3), F.col("AFRLT").asc_nulls_last(), "EVID")
    return out.select(*OUTPUT)
