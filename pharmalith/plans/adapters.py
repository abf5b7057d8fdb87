"""Study tables made from the general test tables, in SQL that both engines run.

Each view's text names the tables and views it reads in braces.  Spark gets
them as DataFrames, DuckDB as common table expressions; ``MICROS(x)`` is the
one spelling that differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "orders", "lineitem", "events")

_SUBJECT = "'01-' || cast(c_nationkey as string) || '-' || cast(c_custkey as string)"

VIEWS = {
    "adsl": f"""
        SELECT '01' AS STUDYID, {_SUBJECT} AS USUBJID, cast(c_custkey as string) AS SUBJID, cast(c_nationkey as string) AS SITEID, cast(18 + c_custkey % 63 as double) AS AGE,
          CASE WHEN c_custkey % 10 = 0 THEN 'U' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS SEX, r_name AS RACE, CASE WHEN c_custkey % 3 = 0 THEN 'HISPANIC' ELSE 'NOT HISPANIC' END AS ETHNIC,
          c_mktsegment AS ARM, c_mktsegment AS ACTARM, n_name AS COUNTRY
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "vs": f"""
        SELECT '01' AS STUDYID, {_SUBJECT} AS USUBJID, VSTEST, upper(VSTEST) AS VSTESTCD, text AS VSSTRESC, cast(text as double) AS VSSTRESN, VSBLFL, c_custkey * 10 + nth AS ORD
        FROM (
          SELECT c_custkey, c_nationkey, 'Height' AS VSTEST, cast(150 + c_custkey % 50 as string) || '.' || cast(c_custkey % 10 as string) AS text, 'Y' AS VSBLFL, 0 AS nth FROM {{customer}} WHERE c_custkey % 11 <> 0
          UNION ALL SELECT c_custkey, c_nationkey, 'Weight', cast(45 + c_custkey % 60 as string) || '.' || cast(c_custkey % 7 as string), 'Y', 1 FROM {{customer}} WHERE c_custkey % 11 <> 0
          UNION ALL SELECT c_custkey, c_nationkey, 'Weight', '199.9', 'N', 2 FROM {{customer}} WHERE c_custkey % 13 = 0
        )""",
    "lb": f"""
        SELECT '01' AS STUDYID, {_SUBJECT} AS USUBJID, LBTESTCD, cast(base + c_custkey % width as double) / 2 AS LBSTRESN, LBBLFL
        FROM {{customer}} CROSS JOIN (
          SELECT 'CREAT' AS LBTESTCD, 100 AS base, 120 AS width, 'Y' AS LBBLFL UNION ALL SELECT 'ALT', 20, 70, 'Y' UNION ALL SELECT 'AST', 22, 64, 'Y' UNION ALL SELECT 'BILI', 8, 30, 'Y' UNION ALL SELECT 'CREAT', 900, 7, 'N' UNION ALL SELECT 'GLUC', 8, 9, 'Y'
        ) WHERE c_custkey % 17 <> 0""",
    "ex": f"""
        SELECT '01' AS STUDYID, {_SUBJECT} AS USUBJID, k AS EXSEQ, CASE WHEN c_custkey % 2 = 0 THEN 'DRUGX' ELSE 'DRUGY' END AS EXTRT, cast((k % 5) * 50 as double) AS EXDOSE, 'mg' AS EXDOSU,
          CASE k % 8 WHEN 0 THEN 'ONCE' WHEN 1 THEN 'QD' WHEN 2 THEN 'BID' WHEN 3 THEN 'TID' WHEN 4 THEN 'Q6H' WHEN 5 THEN 'QOD' WHEN 6 THEN 'QW' ELSE '3 TIMES PER WEEK' END AS EXDOSFRQ, CASE WHEN c_custkey % 2 = 0 THEN 'TABLET' ELSE 'Capsule' END AS EXDOSFRM,
          CASE WHEN k % 6 = 0 THEN 'Oral' WHEN k % 6 = 1 THEN 'SUBCUTANEOUS' WHEN k % 6 = 3 THEN 'iv' WHEN k % 6 = 4 THEN 'Intramuscular' WHEN k % 6 = 5 THEN 'unknown' END AS EXROUTE,
          CASE WHEN k % 19 = 0 THEN NULL WHEN k % 17 = 0 THEN substr(cast(day as string), 1, 7) ELSE cast(day as string) END AS EXSTDTC,
          CASE WHEN k % 4 = 0 THEN NULL ELSE cast(cast(day + INTERVAL '3' DAY as date) as string) END AS EXENDTC, CASE WHEN k % 7 = 0 THEN 8 ELSE 1 END AS VISITDY
        FROM (SELECT o_custkey, cast(o_orderdate as date) AS day, min(o_orderkey) AS k FROM {{orders}} GROUP BY o_custkey, cast(o_orderdate as date)) JOIN {{customer}} ON o_custkey = c_custkey""",
    "pc": f"""
        SELECT '01' AS STUDYID, {_SUBJECT} AS USUBJID, CASE WHEN c_custkey % 3 = 0 THEN 'METAB' ELSE 'DRUGX' END AS PCTESTCD, CASE WHEN c_custkey % 2 = 0 THEN 'DRUGX' ELSE 'DRUGY' END AS PCTEST, cast(day as string) || 'T' || lpad(cast(l_linenumber as string), 2, '0') || ':00:00' AS PCDTC,
          cast(l_linenumber - 2 as double) AS PCTPTNUM, CASE WHEN v < 5 THEN '<BLQ' ELSE cast(cast(v as bigint) as string) END AS PCSTRESC, CASE WHEN v < 5 THEN NULL ELSE v END AS PCSTRESN, 'ng/mL' AS PCSTRESU, cast(5 as double) AS PCLLOQ
        FROM (
          SELECT o_custkey, cast(o_orderdate as date) AS day, l_linenumber, min(cast(l_quantity as double)) AS v
          FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey, cast(o_orderdate as date), l_linenumber
        ) JOIN {{customer}} ON o_custkey = c_custkey""",
    "nca": """
        SELECT cast(e.user_id as string) AS USUBJID, cast(MICROS(e.ts) - MICROS(f.first_ts) as double) / 3600000000 AS TIME, CASE WHEN e.value < 1 THEN '<LLOQ' WHEN e.value IS NULL THEN NULL ELSE cast(cast(floor(e.value * 100) as bigint) as string) END AS CONC,
          cast(100 * (1 + e.user_id % 3) as double) AS DOSE, cast(e.user_id % 2 as int) AS GRP, e.event_id AS ORD
        FROM {events} e JOIN (SELECT user_id, min(ts) AS first_ts FROM {events} GROUP BY user_id) f ON e.user_id = f.user_id""",
    "eventrows": """
        SELECT e.user_id AS id, cast(MICROS(e.ts) as double) / 3600000000 AS time, CASE WHEN e.event_id % 97 = 0 THEN NULL WHEN e.event_type = 'purchase' THEN 1 WHEN e.event_type = 'error' THEN 2 ELSE 0 END AS evid,
          cast(floor(e.value * 100) as double) AS dv, CASE WHEN e.event_type = 'purchase' THEN cast(floor(e.value) as double) ELSE cast(0 as double) END AS amt
        FROM {events} e""",
    "samples": "SELECT cast((l_linenumber - 1) * 21 as double) + cast(l_quantity as double) / 40 AS TIME, l_orderkey, l_linenumber FROM {lineitem}",
    "covs": """
        SELECT c_custkey, cast(40 + c_custkey % 60 + c_acctbal / 2000 as double) AS WT, cast(150 + (c_custkey % 60) / 2 + c_custkey % 17 as double) AS HT, cast(18 + c_custkey % 63 as double) AS AGE,
          CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE cast(60 + c_custkey % 71 as double) END AS CRCL, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS SEX
        FROM {customer}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = re.sub(r"MICROS\(([\w.]+)\)", r"unix_micros(cast(\1 as timestamp))", VIEWS[name])
    return spark.sql(text.replace("{{", "{").replace("}}", "}"), **{t: view(spark, sf_dir, t) for t in set(re.findall(r"\{+(\w+)\}+", VIEWS[name]))})


def duckdb_views() -> dict[str, str]:
    """The views' text for DuckDB, which has the tables by name."""
    return {k: re.sub(r"\{+(\w+)\}+", r"\1", re.sub(r"MICROS\(([\w.]+)\)", r"epoch_us(\1)", v)) for k, v in VIEWS.items()}
