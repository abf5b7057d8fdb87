"""A query per operator over the study views, and DuckDB SQL with the same result where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import normalized_route, to_datetime
from ..operators import demographics, layouts, modeling, nca, nominal, route, sampling, sdtm, study_data
from .adapters import duckdb_views, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NCA = modeling.Dictionary(subject_id="USUBJID", time="TIME", dose="DOSE", conc="CONC", group="GRP")
LIMITS = {"WT": (50.0, 90.0), "AGE": (20.0, 60.0)}
NUMERIC = ["WT", "HT", "AGE"]


def _register(sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = with_steps(sql)
        return query

    return add


def _domains(spark: SparkSession, sf_dir: str) -> sdtm.Domains:
    adsl = view(spark, sf_dir, "adsl")
    return sdtm.upper_domains({"adsl": adsl, "dm": adsl, **{t: view(spark, sf_dir, t) for t in ("vs", "lb", "ex", "pc")}})


_DTM = "CASE WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({0} AS timestamp) END"
_HOURS = "(epoch_us({0}) - epoch_us({1})) / 3.6e9"
_ROUND = "CASE WHEN abs({0} - floor({0} * 10) / 10) < abs({0} - ceil({0} * 10) / 10) THEN floor({0} * 10) / 10 WHEN abs({0} - floor({0} * 10) / 10) > abs({0} - ceil({0} * 10) / 10) THEN ceil({0} * 10) / 10 WHEN cast(floor({0} * 10) as bigint) % 2 = 0 THEN floor({0} * 10) / 10 ELSE ceil({0} * 10) / 10 END"
_TEXT = "regexp_replace(printf('%.1f', " + _ROUND + "), '\\.0$', '')"
_ROUTE = "CASE WHEN lower({0}) IN ('subcutaneous', 'sc') THEN 'sc' WHEN lower({0}) IN ('intramuscular', 'im') THEN 'im' WHEN lower({0}) IN ('intravenous', 'iv') THEN 'iv' ELSE 'oral' END"
_UNIFORM = "((('0x' || substr(md5({row} || '-' || '{stream}' || '-' || '{seed}'), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)"

#: Steps that several oracles share.
STEPS = {
    "pcp": f"SELECT *, {_DTM.format('PCDTC')} AS ADTM, cast({_DTM.format('PCDTC')} as date) AS ADT, PCTEST AS DRUG, CASE WHEN PCTPTNUM < 0 THEN 0.0 ELSE PCTPTNUM END AS NFRLT FROM pc",
    "exp0": f"SELECT *, {_DTM.format('EXSTDTC')} AS ASTDTM, coalesce({_DTM.format('EXENDTC')}, {_DTM.format('EXSTDTC')}) AS AENDTM, cast(24 * (VISITDY - 1) as double) AS N0 FROM ex WHERE EXDOSE > 0",
    "exs": "SELECT *, CASE EXDOSFRQ WHEN 'QD' THEN 24 WHEN 'BID' THEN 12 WHEN 'TID' THEN 8 WHEN 'Q6H' THEN 6 WHEN 'QOD' THEN 48 WHEN 'QW' THEN 168 WHEN '3 TIMES PER WEEK' THEN 56 ELSE 0 END AS step, coalesce(date_diff('day', cast(ASTDTM as date), cast(AENDTM as date)) + 1, 1) AS days FROM exp0",
    "exk": "SELECT *, unnest(range(0, CASE WHEN step = 0 THEN 1 ELSE greatest((days * 24 + step - 1) // step, 1) END)) AS k FROM exs",
    "exd": "SELECT *, ASTDTM + (k * step) * INTERVAL 1 HOUR AS ADTM, cast(ASTDTM + (k * step) * INTERVAL 1 HOUR as date) AS ADT, N0 + k * step AS NFRLT, cast(floor((N0 + k * step) / 24) as int) + 1 AS AVISITN, EXTRT AS DRUG FROM exk",
    "ex1": "SELECT * FROM exd WHERE AVISITN = 1",
    "firsts": "SELECT STUDYID, USUBJID, DRUG, min(ADTM) AS FANLDTM, arg_min(EXDOSE, (ADTM, EXSEQ)) AS EXDOSE_first FROM ex1 WHERE ADTM IS NOT NULL GROUP BY ALL",
    "obs": "SELECT p.*, f.EXDOSE_first FROM pcp p JOIN firsts f USING (STUDYID, USUBJID, DRUG)",
    "prev": "SELECT o.USUBJID, o.ADTM, o.NFRLT, o.PCTPTNUM, d.ADTM AS ADTM_prev, d.EXDOSE AS EXDOSE_prev, d.AENDTM AS AENDTM_prev FROM obs o LEFT JOIN LATERAL (SELECT * FROM ex1 e WHERE e.USUBJID = o.USUBJID AND e.ADTM < o.ADTM ORDER BY e.ADTM DESC, e.EXSEQ DESC LIMIT 1) d ON true",
    "prevn": "SELECT o.USUBJID, o.ADTM, o.NFRLT, max(e.NFRLT) AS NFRLT_prev FROM obs o LEFT JOIN ex1 e ON e.USUBJID = o.USUBJID AND e.NFRLT < o.NFRLT GROUP BY ALL",
    "tl": """SELECT STUDYID, USUBJID, DRUG, 0 AS EVID, ADTM, ADT, NFRLT, PCSTRESN, PCSTRESC, PCTESTCD, PCLLOQ, PCSTRESU, NULL AS EXDOSE, EXDOSE_first, NULL AS EXROUTE, NULL AS EXDOSFRM FROM obs
        UNION ALL SELECT STUDYID, USUBJID, DRUG, 1, ADTM, ADT, NFRLT, NULL, NULL, NULL, NULL, NULL, EXDOSE, NULL, EXROUTE, EXDOSFRM FROM ex1""",
    "tlw": "SELECT *, min(CASE WHEN EVID = 1 THEN ADTM END) OVER w AS FANLDTM, min(NFRLT) OVER w AS min_NFRLT, max(CASE WHEN EVID = 0 THEN ADT END) OVER w AS maxdate FROM tl WINDOW w AS (PARTITION BY USUBJID, DRUG)",
    "tline": f"SELECT *, {_HOURS.format('ADTM', 'FANLDTM')} AS AFRLT FROM tlw WHERE ADT <= maxdate",
    "bvs": "SELECT STUDYID, USUBJID, max(CASE WHEN VSTESTCD = 'HEIGHT' THEN VSSTRESN END) AS HTBL, max(CASE WHEN VSTESTCD = 'WEIGHT' AND VSBLFL = 'Y' THEN VSSTRESN END) AS WTBL FROM vs GROUP BY ALL",
    "blb": "SELECT STUDYID, USUBJID, max(LBSTRESN) FILTER (LBTESTCD = 'CREAT') AS CREATBL, max(LBSTRESN) FILTER (LBTESTCD = 'ALT') AS ALTBL, max(LBSTRESN) FILTER (LBTESTCD = 'AST') AS ASTBL, max(LBSTRESN) FILTER (LBTESTCD = 'BILI') AS TBILBL FROM lb WHERE LBBLFL = 'Y' AND LBTESTCD IN ('CREAT', 'ALT', 'AST', 'BILI') GROUP BY ALL",
    "ncarows": """SELECT u.*, row_number() OVER (ORDER BY g IS NULL, g, sid, t, -evid, src, ord) AS pos FROM (
          SELECT s.sid, n.GRP AS g, n.USUBJID AS ORIGID, n.TIME AS t, CASE WHEN regexp_matches(lower(n.CONC), '[<a-z]') THEN -99.0 ELSE try_cast(n.CONC AS double) END AS dv, 0.0 AS amt, 0 AS evid, 1 AS src, n.ORD AS ord FROM nca n JOIN ncaids s ON s.USUBJID = n.USUBJID
          UNION ALL SELECT s.sid, n.GRP, n.USUBJID, 0.0, 0.0, arg_min(n.DOSE, n.ORD), 1, 0, min(n.ORD) FROM nca n JOIN ncaids s ON s.USUBJID = n.USUBJID GROUP BY s.sid, n.GRP, n.USUBJID) u""",
    "wide": "SELECT USUBJID, arg_min(VSSTRESC, ORD) FILTER (lower(VSTEST) = 'weight') AS weight, arg_min(VSSTRESC, ORD) FILTER (lower(VSTEST) = 'height') AS height FROM vs GROUP BY USUBJID",
    "demo": "SELECT coalesce(a.USUBJID, w.USUBJID) AS USUBJID, w.weight, w.height, a.SEX AS sex, a.AGE AS age, a.RACE AS race, a.ETHNIC AS ethnic, a.ARM AS arm FROM adsl a FULL JOIN wide w ON a.USUBJID = w.USUBJID",
    "contv": "SELECT 'age' AS name, age AS v FROM demo UNION ALL SELECT 'height', try_cast(height AS double) FROM demo UNION ALL SELECT 'weight', try_cast(weight AS double) FROM demo",
    "conts": "SELECT name, avg(v) AS m, stddev_samp(v) AS s, median(v) AS d, min(v) AS lo, max(v) AS hi FROM contv GROUP BY name",
    "cont": f"SELECT name, unnest(['mean', 'sd', 'median', 'min_max']) AS statistic, unnest([{_TEXT.format('m')}, {_TEXT.format('s')}, {_TEXT.format('d')}, {_TEXT.format('lo')} || ' - ' || {_TEXT.format('hi')}]) AS value, unnest([1, 2, 3, 4]) AS nth FROM conts",
    "cate": "SELECT name, level, cast(count(*) as varchar) AS value FROM (SELECT unnest(['sex', 'race', 'ethnic', 'arm']) AS name, unnest([sex, race, ethnic, arm]) AS level FROM demo) WHERE level IS NOT NULL GROUP BY ALL",
    "kstat": "SELECT count(TIME) AS n, min(TIME) AS lo, max(TIME) AS hi, stddev_samp(TIME) AS sd, quantile_cont(TIME, 0.75) - quantile_cont(TIME, 0.25) AS iqr FROM samples",
    "kbw": "SELECT *, 0.7 * 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS h FROM kstat",
    "kgrid": "SELECT unnest(range(0, 512)) AS i, * FROM kbw",
    "kcells": "SELECT TIME AS t, count(*) AS c FROM samples GROUP BY TIME",
    "kdens": "SELECT i, any_value(lo - 3 * h + i * ((hi + 3 * h) - (lo - 3 * h)) / 511) AS gx, sum(c * exp(-0.5 * pow((lo - 3 * h + i * ((hi + 3 * h) - (lo - 3 * h)) / 511 - t) / h, 2))) AS y FROM kgrid CROSS JOIN kcells GROUP BY i",
    "kdelta": "SELECT *, coalesce(lead(y) OVER (ORDER BY i) - y, 0) AS delta FROM kdens",
    "kpeaks": "SELECT i, gx FROM (SELECT *, coalesce(lag(delta) OVER (ORDER BY i), 0) AS before FROM kdelta) WHERE delta < 0 AND before >= 0",
    "ktimes": "SELECT row_number() OVER (ORDER BY i) AS nth, CASE WHEN i = (SELECT max(i) FROM kpeaks) THEN ceil(gx) ELSE floor(gx) END AS nominal FROM kpeaks",
    "levels": "SELECT *, dense_rank() OVER (ORDER BY RACE) AS RACEN, dense_rank() OVER (ORDER BY ETHNIC) AS ETHNICN, dense_rank() OVER (ORDER BY COUNTRY) AS COUNTRYN, dense_rank() OVER (ORDER BY ARM) AS COHORT, ARM AS COHORTC FROM adsl",
    "pool": "SELECT row_number() OVER (ORDER BY c_custkey) AS nth, * FROM covs WHERE WT BETWEEN 50 AND 90 AND AGE BETWEEN 20 AND 60",
}
STEPS = {"ncaids": "SELECT USUBJID, row_number() OVER (ORDER BY min(ORD)) AS sid FROM nca GROUP BY USUBJID", **STEPS}


def with_steps(sql: str) -> str:
    """The views and steps that a query needs, before it."""
    every = {**duckdb_views(), **STEPS}
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)):
            if name in every and name not in needed:
                needed.add(name)
                need(every[name])

    need(sql)
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in every.items() if k in needed)
    if not ctes:
        return sql
    return f"WITH {ctes},\n{sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes}\n{sql}"


@_register("""SELECT cast(dense_rank() OVER (ORDER BY gid) as int) AS ID, t AS TIME, 1.0::double AS CMT, cast(evid as double) AS EVID, cast(evid as double) AS MDV, dv AS DV, amt AS AMT, cast(dense_rank() OVER (ORDER BY gg) as int) AS "GROUP", cast(dense_rank() OVER (ORDER BY go) as int) AS ORIGID
    FROM (SELECT *, min(pos) OVER (PARTITION BY sid) AS gid, min(pos) OVER (PARTITION BY g) AS gg, min(pos) OVER (PARTITION BY ORIGID) AS go FROM ncarows) QUALIFY dv <> -99""")
def nca_to_modeling(spark, sf_dir):
    return nca.nca_to_modeling(view(spark, sf_dir, "nca"), NCA, order_by="ORD")


@_register("""SELECT id AS ID, time AS TIME, evid AS EVID, CASE WHEN evid IS NULL THEN NULL WHEN evid = 0 THEN dv ELSE 0 END AS DV, amt AS AMT, CASE WHEN evid IS NULL THEN NULL WHEN evid = 0 THEN 0 ELSE 1 END AS MDV, 1 AS "GROUP" FROM eventrows""")
def modeling_to_modeling(spark, sf_dir):
    return modeling.modeling_to_modeling(view(spark, sf_dir, "eventrows"))


@_register("""SELECT o.id AS ID, o.time AS TIME, o.evid AS EVID, o.dv AS DV, o.amt AS AMT, (SELECT arg_max(d.amt, (d.time, d.amt)) FROM eventrows d WHERE d.evid = 1 AND d.id = o.id AND d.time <= o.time) AS DOSE FROM eventrows o WHERE o.evid = 0""")
def modeling_to_nca(spark, sf_dir):
    return modeling.modeling_to_nca(view(spark, sf_dir, "eventrows"))


@_register("SELECT * FROM (VALUES ('domains', 'sdtm'), ('eventrows', 'modeling'), ('nca', 'nca')) t(dataset, layout)")
def detect_type(spark, sf_dir):
    found = {"domains": _domains(spark, sf_dir), "eventrows": view(spark, sf_dir, "eventrows"), "nca": view(spark, sf_dir, "nca")}
    return spark.createDataFrame([(k, layouts.detect_dataset_type(v)) for k, v in found.items()], "dataset string, layout string")


@_register(f"SELECT USUBJID, first_spelling, n_spellings, {_ROUTE.format('first_spelling')} AS route FROM (SELECT USUBJID, arg_min(EXROUTE, EXSEQ) FILTER (EXROUTE IS NOT NULL) AS first_spelling, count(DISTINCT EXROUTE) AS n_spellings FROM ex GROUP BY USUBJID)")
def route_first(spark, sf_dir):
    return route.first_route(view(spark, sf_dir, "ex"), "EXROUTE", "EXSEQ", ["USUBJID"])


@_register(f"SELECT EXROUTE, {_ROUTE.format('EXROUTE')} AS route, count(*) AS n FROM ex GROUP BY ALL")
def route_normalize(spark, sf_dir):
    return view(spark, sf_dir, "ex").groupBy("EXROUTE", normalized_route(F.col("EXROUTE")).alias("route")).agg(F.count("*").alias("n"))


@_register("SELECT USUBJID AS usubjid, weight, height FROM wide")
def demographics_vitals_pivot(spark, sf_dir):
    return demographics.vitals_wide(view(spark, sf_dir, "vs"), ["weight", "height"], "ORD")


def _demo(spark, sf_dir):
    return demographics.subject_demographics(_domains(spark, sf_dir), order_by="ORD")[0]


@_register("SELECT name, statistic, value FROM cont")
def demographics_continuous(spark, sf_dir):
    return demographics.continuous_summary(_demo(spark, sf_dir), ["weight", "height", "age"])


@_register("SELECT name, level, value FROM cate")
def demographics_categorical(spark, sf_dir):
    return demographics.categorical_summary(_demo(spark, sf_dir), ["sex", "race", "ethnic", "arm"])


@_register("""SELECT CASE WHEN nth = 1 THEN name ELSE '' END AS "Demographic", statistic AS "Statistic", value AS "Value/count" FROM cont
    UNION ALL SELECT CASE WHEN row_number() OVER (PARTITION BY name ORDER BY level) = 1 THEN name ELSE '' END, level, value FROM cate""")
def demographics_table(spark, sf_dir):
    return demographics.create_demographics_table(_domains(spark, sf_dir), order_by="ORD")


@_register("""SELECT name, level, cast(sum(n) as varchar) AS value FROM (SELECT 'sex' AS name, sex AS level, count(*) AS n FROM demo WHERE sex IS NOT NULL GROUP BY sex
    UNION ALL SELECT 'sex', unnest(['F', 'M', 'U', 'UNDIFFERENTIATED']), 0) GROUP BY ALL""")
def demographics_levels(spark, sf_dir):
    return demographics.categorical_summary(_demo(spark, sf_dir), ["sex"], levels={"SEX": ["F", "M", "U", "UNDIFFERENTIATED"]})


@_register("""WITH g AS (SELECT arm, 'age' AS name, avg(age) AS m, stddev_samp(age) AS s, median(age) AS d, min(age) AS lo, max(age) AS hi FROM demo GROUP BY arm)
    SELECT arm, CASE WHEN nth = 1 THEN name ELSE '' END AS "Demographic", statistic AS "Statistic", value AS "Value/count" FROM (
      SELECT arm, name, unnest(['mean', 'sd', 'median', 'min_max']) AS statistic, unnest([{m}, {s}, {d}, {lo} || ' - ' || {hi}]) AS value, unnest([1, 2, 3, 4]) AS nth FROM g)""".format(m=_TEXT.format("m"), s=_TEXT.format("s"), d=_TEXT.format("d"), lo=_TEXT.format("lo"), hi=_TEXT.format("hi")))
def demographics_by_group(spark, sf_dir):
    return demographics.create_demographics_table(_domains(spark, sf_dir), ["age"], group="arm")


@_register("SELECT nth, cast(nominal as bigint) AS nominal FROM ktimes")
def nominal_timepoints(spark, sf_dir):
    values = nominal.get_nominal_timepoints(view(spark, sf_dir, "samples"), "TIME", adjust=0.7)
    return spark.createDataFrame([(k + 1, v) for k, v in enumerate(values)], "nth long, nominal long")


@_register("""SELECT TIME, l_linenumber, NOMINAL_TIME, count(*) AS n FROM (
      SELECT s.TIME, s.l_linenumber, (SELECT arg_min(nominal, (abs(nominal - s.TIME), -nominal)) FROM ktimes) AS NOMINAL_TIME FROM samples s) GROUP BY ALL""")
def add_nominal_timepoints(spark, sf_dir):
    out = nominal.add_nominal_timepoints(view(spark, sf_dir, "samples"), "TIME", adjust=0.7)
    return out.groupBy("TIME", "l_linenumber", "NOMINAL_TIME").agg(F.count("*").alias("n"))


@_register("SELECT AGE, cast(CASE WHEN AGE >= 65 THEN 80 WHEN AGE >= 40 THEN 50 WHEN AGE >= 25 THEN 30 ELSE 20 END as double) AS nearest, count(*) AS n FROM adsl GROUP BY ALL")
def match_closest(spark, sf_dir):
    return nominal.match_closest(view(spark, sf_dir, "adsl"), "AGE", [20, 30, 50, 80], "nearest").groupBy("AGE", "nearest").agg(F.count("*").alias("n"))


@_register(f"SELECT EXSEQ, EXSTDTC, {_DTM.format('EXSTDTC')} AS ASTDTM, {_DTM.format('EXENDTC')} AS AENDTM FROM ex")
def iso_datetimes(spark, sf_dir):
    return view(spark, sf_dir, "ex").select("EXSEQ", "EXSTDTC", to_datetime(F.col("EXSTDTC")).alias("ASTDTM"), to_datetime(F.col("EXENDTC")).alias("AENDTM"))


@_register("SELECT USUBJID, DRUG, ADTM, ADT, NFRLT, PCSTRESN, PCSTRESC FROM pcp")
def pc_prepared(spark, sf_dir):
    return sdtm.prepare_pc(_domains(spark, sf_dir)).select("USUBJID", "DRUG", "ADTM", "ADT", "NFRLT", "PCSTRESN", "PCSTRESC")


@_register("SELECT USUBJID, EXSEQ, EXDOSE, ASTDTM, AENDTM, N0 AS NFRLT FROM exp0")
def ex_prepared(spark, sf_dir):
    return sdtm.prepare_ex(_domains(spark, sf_dir)).select("USUBJID", "EXSEQ", "EXDOSE", "ASTDTM", "AENDTM", "NFRLT")


@_register("SELECT USUBJID, EXSEQ, ADTM, ADT, NFRLT, AVISITN, 'Day ' || AVISITN AS AVISIT FROM exd")
def single_dose_expand(spark, sf_dir):
    return sdtm.expand_doses(sdtm.prepare_ex(_domains(spark, sf_dir)), first_day_only=False).select("USUBJID", "EXSEQ", "ADTM", "ADT", "NFRLT", "AVISITN", "AVISIT")


@_register("SELECT * FROM firsts")
def first_dose(spark, sf_dir):
    return sdtm.first_doses(sdtm.expand_doses(sdtm.prepare_ex(_domains(spark, sf_dir))))


def _sides(spark, sf_dir):
    data = _domains(spark, sf_dir)
    doses = sdtm.expand_doses(sdtm.prepare_ex(data))
    return sdtm.prepare_pc(data).join(sdtm.first_doses(doses).drop("FANLDTM"), [*sdtm.SUBJECT, "DRUG"]), doses


@_register("SELECT USUBJID, ADTM, ADTM_prev, EXDOSE_prev, AENDTM_prev FROM prev")
def prev_dose_asof(spark, sf_dir):
    return sdtm.previous_dose(*_sides(spark, sf_dir)).select("USUBJID", "ADTM", "ADTM_prev", "EXDOSE_prev", "AENDTM_prev")


@_register("SELECT USUBJID, ADTM, NFRLT, NFRLT_prev FROM prevn")
def prev_nominal_dose(spark, sf_dir):
    return sdtm.previous_nominal(*_sides(spark, sf_dir)).select("USUBJID", "ADTM", "NFRLT", "NFRLT_prev")


@_register(f"""SELECT t.USUBJID, t.DRUG, t.EVID, t.ADTM, AFRLT,
      CASE WHEN EVID = 1 THEN 0.0 WHEN ADTM_prev IS NULL THEN AFRLT ELSE {_HOURS.format('t.ADTM', 'ADTM_prev')} END AS APRLT,
      CASE WHEN EVID = 1 THEN 0.0 WHEN NFRLT_prev IS NULL THEN t.NFRLT - min_NFRLT ELSE t.NFRLT - NFRLT_prev END AS NPRLT
    FROM tline t LEFT JOIN prev p ON EVID = 0 AND p.USUBJID = t.USUBJID AND p.ADTM = t.ADTM LEFT JOIN prevn q ON EVID = 0 AND q.USUBJID = t.USUBJID AND q.ADTM = t.ADTM""")
def relative_times(spark, sf_dir):
    return sdtm.timeline(_domains(spark, sf_dir), full=True).select("USUBJID", "DRUG", "EVID", "ADTM", "AFRLT", "APRLT", "NPRLT")


_ANALYSIS = """CASE WHEN EVID = 1 THEN EXDOSE WHEN EXDOSE_prev IS NULL THEN EXDOSE_first ELSE EXDOSE_prev END AS DOSEA, PCLLOQ AS ALLOQ, CASE WHEN EVID = 1 THEN 1 ELSE 2 END AS CMT, CASE WHEN PCSTRESC = '<BLQ' THEN 'Y' ELSE 'N' END AS BLQFL,
      CASE WHEN PCSTRESC = '<BLQ' THEN 1 ELSE 0 END AS BLQFN, cast(CASE WHEN EVID = 1 THEN EXDOSE END as double) AS AMT, cast(PCSTRESN as double) AS DV, cast(PCSTRESN as double) AS AVAL, floor(CASE WHEN PCSTRESN <> 0 THEN ln(PCSTRESN) END * 1000000) AS DVL,
      CASE WHEN EVID = 1 OR PCSTRESN IS NULL THEN 1 ELSE 0 END AS MDV, PCSTRESU AS AVALU, strftime(t.ADTM, '%Y-%m-%dT%H:%M:%S') AS UDTC, 0.0::double AS II, 0.0::double AS SS"""
_WITH_PREVIOUS = "tline t LEFT JOIN prev p ON EVID = 0 AND p.USUBJID = t.USUBJID AND p.ADTM = t.ADTM LEFT JOIN prevn q ON EVID = 0 AND q.USUBJID = t.USUBJID AND q.ADTM = t.ADTM"


def _micro(df: DataFrame, *columns: str) -> DataFrame:
    """Millionths, rounded down: the engines' logarithms and powers differ in the last digits."""
    return df.withColumns({c: F.floor(F.col(c) * 1000000).cast("double") for c in columns})


@_register(f"SELECT t.USUBJID, t.EVID, t.ADTM, CASE WHEN EVID = 1 THEN 'DOSE' ELSE PCTESTCD END AS PARAMCD, {_ANALYSIS} FROM {_WITH_PREVIOUS}")
def analysis_vars(spark, sf_dir):
    rows = sdtm.analysis_variables(sdtm.timeline(_domains(spark, sf_dir), full=True))
    return _micro(rows, "DVL").select("USUBJID", "EVID", "ADTM", "PARAMCD", "DOSEA", "ALLOQ", "CMT", "BLQFL", "BLQFN", "AMT", "DV", "AVAL", "DVL", "MDV", "AVALU", "UDTC", "II", "SS")


@_register("SELECT USUBJID, AFRLT, EVID, cast(row_number() OVER (PARTITION BY STUDYID, USUBJID ORDER BY AFRLT NULLS LAST, EVID) as int) AS ASEQ FROM tline")
def obs_number(spark, sf_dir):
    return sdtm.number_observations(sdtm.timeline(_domains(spark, sf_dir))).select("USUBJID", "AFRLT", "EVID", "ASEQ")


@_register("""SELECT USUBJID, cast(split_part(USUBJID, '-', 1) as double) AS STUDYIDN, cast(split_part(USUBJID, '-', 2) as double) AS SITEIDN, cast(split_part(USUBJID, '-', 3) as double) AS USUBJIDN, CASE SEX WHEN 'M' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS SEXN,
      dense_rank() OVER (ORDER BY RACE) AS RACEN, dense_rank() OVER (ORDER BY ETHNIC) AS ETHNICN, dense_rank() OVER (ORDER BY ARM) AS ARMN, dense_rank() OVER (ORDER BY COUNTRY) AS COUNTRYN, dense_rank() OVER (ORDER BY ARM) AS COHORT FROM adsl""")
def covariates_coded(spark, sf_dir):
    return sdtm.coded_subjects(_domains(spark, sf_dir)["adsl"]).select("USUBJID", "STUDYIDN", "SITEIDN", "USUBJIDN", "SEXN", "RACEN", "ETHNICN", "ARMN", "COUNTRYN", "COHORT")


@_register("SELECT * FROM bvs")
def baseline_vitals(spark, sf_dir):
    return sdtm.baseline_vitals(_domains(spark, sf_dir)["vs"])


@_register("SELECT * FROM blb")
def baseline_labs_pivot(spark, sf_dir):
    return sdtm.baseline_labs(_domains(spark, sf_dir)["lb"])


_SUBJECTS = "(SELECT * FROM adsl LEFT JOIN bvs USING (STUDYID, USUBJID) LEFT JOIN blb USING (STUDYID, USUBJID))"


@_register(f"""SELECT USUBJID, floor(WTBL / pow(HTBL / 100, 2.0) * 10000) AS BMI4, floor(sqrt(HTBL * WTBL / 3600) * 10000) AS BSA4, floor((140 - AGE) * WTBL * CASE WHEN SEX = 'F' THEN 0.85 ELSE 1.0 END / (72 * (CREATBL / 88.42)) * 1000) AS CRCL3,
      floor(142 * pow(least(CREATBL / 88.42 / CASE WHEN SEX = 'F' THEN 0.7 ELSE 0.9 END, 1.0), CASE WHEN SEX = 'F' THEN -0.241 ELSE -0.302 END) * pow(greatest(CREATBL / 88.42 / CASE WHEN SEX = 'F' THEN 0.7 ELSE 0.9 END, 1.0), -1.2) * pow(0.9938, AGE) * CASE WHEN SEX = 'F' THEN 1.012 ELSE 1.0 END * 1000) AS EGFR3 FROM {_SUBJECTS}""")
def derived_body_renal(spark, sf_dir):
    out = sdtm.covariates(_domains(spark, sf_dir))
    scaled = lambda c, by: F.floor(F.col(c) * by).cast("double")
    return out.select("USUBJID", scaled("BMIBL", 10000).alias("BMI4"), scaled("BSABL", 10000).alias("BSA4"), scaled("CRCLBL", 1000).alias("CRCL3"), scaled("EGFRBL", 1000).alias("EGFR3"))


_MODELING = """SELECT SUBJID AS ID, NFRLT AS TIME, cast(PCSTRESN as double) AS DV, CASE WHEN EVID = 1 OR PCSTRESN IS NULL THEN 1 ELSE 0 END AS MDV, EVID, 0.0::double AS SS, 0.0::double AS II, cast(CASE WHEN EVID = 1 THEN EXDOSE END as double) AS AMT, CASE SEX WHEN 'M' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS SEXN, AGE, WTBL AS WT,
      lower(EXROUTE) AS ROUTE, lower(EXDOSFRM) AS FORM, ARM AS COHORT, SITEID, RACE, ETHNIC, COUNTRY
    FROM tline LEFT JOIN adsl USING (STUDYID, USUBJID) LEFT JOIN bvs USING (STUDYID, USUBJID) WHERE NOT (PCSTRESN IS NULL AND EVID = 0)"""


@_register(_MODELING)
def sdtm_to_modeling(spark, sf_dir):
    return layouts.reformat_data(_domains(spark, sf_dir), output_type="modeling")


@_register(_MODELING)
def data_for_modelfit(spark, sf_dir):
    return study_data.get_data_for_modelfit(spark, data=_domains(spark, sf_dir))


_BODY = """floor(WTBL / pow(HTBL / 100, 2.0) * 10000) AS BMIBL, floor(sqrt(HTBL * WTBL / 3600) * 10000) AS BSABL, floor((140 - AGE) * WTBL * CASE WHEN SEX = 'F' THEN 0.85 ELSE 1.0 END / (72 * (CREATBL / 88.42)) * 1000) AS CRCLBL,
      floor(142 * pow(least(CREATBL / 88.42 / CASE WHEN SEX = 'F' THEN 0.7 ELSE 0.9 END, 1.0), CASE WHEN SEX = 'F' THEN -0.241 ELSE -0.302 END) * pow(greatest(CREATBL / 88.42 / CASE WHEN SEX = 'F' THEN 0.7 ELSE 0.9 END, 1.0), -1.2) * pow(0.9938, AGE) * CASE WHEN SEX = 'F' THEN 1.012 ELSE 1.0 END * 1000) AS EGFRBL"""


def _events(spark, sf_dir, **options) -> DataFrame:
    out = _micro(sdtm.sdtm_to_adppk(_domains(spark, sf_dir), **options), "DVL")
    return out.withColumns({c: F.floor(F.col(c) * by).cast("double") for c, by in (("BMIBL", 10000), ("BSABL", 10000), ("CRCLBL", 1000), ("EGFRBL", 1000))})


@_register(f"""SELECT * FROM (SELECT t.STUDYID, t.USUBJID, EVID, t.NFRLT, AFRLT, CASE WHEN EVID = 1 THEN 0.0 WHEN ADTM_prev IS NULL THEN AFRLT ELSE {_HOURS.format('t.ADTM', 'ADTM_prev')} END AS APRLT,
      CASE WHEN EVID = 1 THEN 0.0 WHEN NFRLT_prev IS NULL THEN t.NFRLT - min_NFRLT ELSE t.NFRLT - NFRLT_prev END AS NPRLT, lower(EXROUTE) AS ROUTE, lower(EXDOSFRM) AS FORM, {_ANALYSIS},
      cast(row_number() OVER (PARTITION BY t.STUDYID, t.USUBJID ORDER BY AFRLT NULLS LAST, EVID) as int) AS ASEQ, t.DRUG AS PROJID, 1 AS PROJIDN,
      cast(split_part(t.USUBJID, '-', 1) as double) AS STUDYIDN, SITEID, cast(split_part(t.USUBJID, '-', 2) as double) AS SITEIDN, cast(split_part(t.USUBJID, '-', 3) as double) AS USUBJIDN, SUBJID, cast(SUBJID as double) AS SUBJIDN, AGE, SEX, CASE SEX WHEN 'M' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS SEXN,
      COHORT, COHORTC, RACE, RACEN, ETHNIC, ETHNICN, COUNTRY, COUNTRYN, HTBL, WTBL, CREATBL, ALTBL, ASTBL, TBILBL, {_BODY}
    FROM {_WITH_PREVIOUS} LEFT JOIN levels l ON l.STUDYID = t.STUDYID AND l.USUBJID = t.USUBJID LEFT JOIN bvs b ON b.STUDYID = t.STUDYID AND b.USUBJID = t.USUBJID LEFT JOIN blb c ON c.STUDYID = t.STUDYID AND c.USUBJID = t.USUBJID) WHERE NOT (DV IS NULL AND EVID = 0)""")
def sdtm_to_adppk(spark, sf_dir):
    return _events(spark, sf_dir)


@_register("SELECT PARAMCD, PARAM, PARAMN, EVID, count(*) AS n FROM (SELECT EVID, CASE WHEN EVID = 1 THEN 'DOSE' ELSE PCTESTCD END AS PARAMCD, CASE WHEN EVID = 1 THEN 'DrugX Dose' WHEN PCTESTCD = 'DRUGX' THEN 'concentration of DrugX' END AS PARAM, CASE WHEN EVID = 1 THEN 2 WHEN PCTESTCD = 'DRUGX' THEN 1 END AS PARAMN FROM tline WHERE NOT (PCSTRESN IS NULL AND EVID = 0)) GROUP BY ALL")
def parameters(spark, sf_dir):
    return _events(spark, sf_dir, helpers=True).groupBy("PARAMCD", "PARAM", "PARAMN", "EVID").agg(F.count("*").alias("n"))


@_register(f"""WITH units AS (SELECT * FROM (VALUES ('MINUTE', 'MIN', 1.0 / 60), ('HOUR', 'H', 1), ('DAY', 'D', 24), ('WEEK', 'W', 168), ('MONTH', 'M', 730.5), ('YEAR', 'Y', 8766)) u(word, letter, h)),
    terms AS (SELECT unnest([{', '.join(f"'{x}'" for x in sdtm.FREQUENCIES)}]) AS term),
    parts AS (SELECT term, try_cast(nullif(regexp_extract(term, '[0-9]+'), '') as double) AS n, CASE WHEN term LIKE 'Q%' THEN 'every' WHEN term LIKE '% PER %' THEN 'per' WHEN term LIKE 'EVERY OTHER %' THEN 'other' ELSE 'every' END AS kind,
      CASE WHEN term LIKE '% PER %' THEN regexp_extract(term, ' PER (.*)$', 1) WHEN term LIKE 'EVERY %' THEN rtrim(regexp_extract(term, '([A-Z]+)$', 1), 'S') END AS word, CASE WHEN term LIKE 'Q%' THEN regexp_extract(term, '^Q[0-9]*([A-Z]+)$', 1) END AS letter FROM terms)
    SELECT term, floor(coalesce(CASE term WHEN 'ONCE' THEN 0 WHEN '1 TIME' THEN 0 WHEN 'BID' THEN 12 WHEN 'TID' THEN 8 WHEN 'QID' THEN 6 WHEN 'QOD' THEN 48 WHEN 'QAM' THEN 24 WHEN 'QPM' THEN 24 WHEN 'QHS' THEN 24 WHEN 'QN' THEN 24 WHEN 'QS' THEN 168 WHEN 'BIS' THEN 84 WHEN 'BIM' THEN 365.25
        WHEN 'PA' THEN 8766 WHEN 'EVERY MORNING' THEN 24 WHEN 'EVERY AFTERNOON' THEN 24 WHEN 'EVERY EVENING' THEN 24 WHEN 'EVERY NIGHT' THEN 24 END, CASE kind WHEN 'per' THEN h / n WHEN 'other' THEN 2 * h ELSE h * coalesce(n, 1) END)::double * 1000 + 0.01) AS hours3
    FROM parts LEFT JOIN units ON parts.word = units.word OR parts.letter = units.letter""")
def dose_frequencies(spark, sf_dir):
    terms = spark.createDataFrame([(x,) for x in sdtm.FREQUENCIES], "term string")
    return sdtm.with_dosing_interval(terms, "term", "hours").select("term", F.floor(F.col("hours") * 1000 + 0.01).cast("double").alias("hours3"))


@_register(f"SELECT p.STUDYID, p.USUBJID, p.DRUG, {_HOURS.format('p.ADTM', 'f.FANLDTM')} AS TIME, p.PCSTRESC AS CONC, f.EXDOSE_first AS DOSE, a.ARM AS \"GROUP\" FROM pcp p JOIN firsts f USING (STUDYID, USUBJID, DRUG) LEFT JOIN adsl a USING (STUDYID, USUBJID)")
def data_for_nca(spark, sf_dir):
    return study_data.get_data_for_nca(spark, data=_domains(spark, sf_dir))


@_register("SELECT c_custkey, WT, HT, AGE, CRCL, SEX FROM pool")
def conditional_filter(spark, sf_dir):
    return sampling.conditional_filter(view(spark, sf_dir, "covs"), LIMITS)


@_register("SELECT a AS a, b AS b, floor(v * 100000) AS v5 FROM (SELECT unnest(['mean', 'mean', 'mean', 'WT', 'WT', 'WT', 'HT', 'HT', 'AGE']) AS a, unnest(['WT', 'HT', 'AGE', 'WT', 'HT', 'AGE', 'HT', 'AGE', 'AGE']) AS b, unnest([avg(WT), avg(HT), avg(AGE), covar_samp(WT, WT), covar_samp(WT, HT), covar_samp(WT, AGE), covar_samp(HT, HT), covar_samp(HT, AGE), covar_samp(AGE, AGE)]) AS v FROM covs)")
def mvn_params(spark, sf_dir):
    mean, cov = sampling.moments(view(spark, sf_dir, "covs"), NUMERIC)
    rows = [("mean", n, float(m)) for n, m in zip(NUMERIC, mean)] + [(a, NUMERIC[j], float(cov[i, j])) for i, a in enumerate(NUMERIC) for j in range(i, 3)]
    return spark.createDataFrame(rows, "a string, b string, v double").select("a", "b", F.floor(F.col("v") * 100000).cast("double").alias("v5"))


@_register("SELECT c_custkey, WT, HT, AGE, CRCL, SEX FROM (SELECT unnest(range(0, 2000)) AS id) d JOIN pool ON nth = (('0x' || substr(md5(d.id || '-0-7'), 1, 8))::bigint % (SELECT count(*) FROM pool)) + 1")
def bootstrap_sample(spark, sf_dir):
    return sampling.sample_covariates(view(spark, sf_dir, "covs"), "bootstrap", n_subjects=2000, conditional=LIMITS, seed=7, order_by=["c_custkey"])


def _normal(k: int) -> str:
    u = [_UNIFORM.format(row="id", stream=s, seed=7) for s in (2 * k, 2 * k + 1)]
    return f"(sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]}))"


def _mvn(value: str, out: str) -> str:
    """Draws of WT and HT with the factor written out."""
    return f"""WITH m AS (SELECT avg({value.format('WT')}) AS m1, avg({value.format('HT')}) AS m2, covar_samp({value.format('WT')}, {value.format('WT')}) AS s11, covar_samp({value.format('WT')}, {value.format('HT')}) AS s12, covar_samp({value.format('HT')}, {value.format('HT')}) AS s22 FROM covs),
      z AS (SELECT {_normal(0)} AS z0, {_normal(1)} AS z1 FROM (SELECT unnest(range(0, 1000)) AS id))
    SELECT floor({out.format('m1 + sqrt(s11) * z0')} * 10000) AS WT4, floor({out.format('m2 + s12 / sqrt(s11) * z0 + sqrt(s22 - s12 / sqrt(s11) * (s12 / sqrt(s11))) * z1')} * 10000) AS HT4 FROM z CROSS JOIN m"""


def _drawn(spark, sf_dir, log: bool) -> DataFrame:
    out = sampling.sample_covariates(view(spark, sf_dir, "covs").select("WT", "HT"), "mvtnorm", n_subjects=1000, exponential=log, seed=7)
    return out.select(F.floor(F.col("WT") * 10000).cast("double").alias("WT4"), F.floor(F.col("HT") * 10000).cast("double").alias("HT4"))


@_register(_mvn("{0}", "({0})"))
def mvn_sample(spark, sf_dir):
    return _drawn(spark, sf_dir, False)


@_register(_mvn("ln({0})", "exp({0})"))
def log_mvn_sample(spark, sf_dir):
    return _drawn(spark, sf_dir, True)


@_register()
def impute_missing(spark, sf_dir):
    return sampling.impute_missing(view(spark, sf_dir, "covs").drop("c_custkey"), ["SEX"], seed=7)


@_register()
def mice_sample(spark, sf_dir):
    return sampling.sample_covariates(view(spark, sf_dir, "covs").drop("c_custkey"), "mice", cat_covs=["SEX"], conditional={"WT": (50.0, 90.0)}, seed=7)


def _moments_like(out: DataFrame, like: DataFrame, names: list[str]) -> DataFrame:
    """One row: counts, and whether means, spreads and the share of F are near ``like``'s: within a tenth of a spread (a fifth for spreads), or four standard errors in a small table."""
    want = like.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_samp))], F.avg((F.col("SEX") == "F").cast("double")).alias("f"), F.count("*").alias("rows")).first()
    error = 4 * (2 / max(want["rows"], 1)) ** 0.5  # of the difference of two means, in spreads
    near = [(F.abs(F.avg(c) - F.lit(want[f"m_{c}"])) < max(0.1, error) * want[f"s_{c}"]).alias(f"mean_{c}") for c in names] + [(F.abs(F.stddev_samp(c) / F.lit(want[f"s_{c}"]) - 1) < max(0.2, error)).alias(f"spread_{c}") for c in names]
    nulls = F.sum(F.greatest(*[F.col(c).isNull().cast("int") for c in out.columns])).cast("long")
    return out.agg(F.count("*").alias("n"), nulls.alias("n_null"), *near, (F.abs(F.avg((F.col("SEX") == "F").cast("double")) - F.lit(want["f"])) < max(0.08, error / 2)).alias("share_F"))


_NEAR = ", ".join(f"true AS {k}_{c}" for k in ("mean", "spread") for c in ("HT", "AGE", "CRCL"))


@_register(f"SELECT count(*) AS n, 0::bigint AS n_null, {_NEAR}, true AS \"share_F\", floor(sum(CRCL)) AS observed FROM covs")
def impute_moments(spark, sf_dir):
    """Imputed rows: none is null, what was observed is as it was, and distributions are like the observed ones."""
    data = view(spark, sf_dir, "covs")
    out = sampling.impute_missing(data.drop("c_custkey"), ["SEX"], seed=7)
    # WT, HT, AGE and SEX have no nulls: rows match their originals by them
    kept = out.join(data.where("CRCL is not null").select("WT", "HT", "AGE", F.col("CRCL").alias("seen")), ["WT", "HT", "AGE"]).where("CRCL = seen").agg(F.floor(F.sum("seen")).cast("double").alias("observed")).first()[0]
    return _moments_like(out, data, ["HT", "AGE", "CRCL"]).withColumn("observed", F.lit(kept))


@_register(f"SELECT count(*) AS n, 0::bigint AS n_null, {_NEAR}, true AS \"share_F\", true AS inside FROM covs")
def mice_moments(spark, sf_dir):
    """Simulated rows: as many as there are, within the limits, with distributions like those of the rows within the limits."""
    data = view(spark, sf_dir, "covs").drop("c_custkey")
    out = sampling.sample_covariates(data, "mice", cat_covs=["SEX"], conditional={"WT": (50.0, 90.0)}, seed=7)
    inside = out.agg(F.min("WT").alias("low"), F.max("WT").alias("high")).first()
    return _moments_like(out, data.where("WT between 50 and 90"), ["HT", "AGE", "CRCL"]).withColumn("inside", F.lit(inside.low >= 50 and inside.high <= 90))
