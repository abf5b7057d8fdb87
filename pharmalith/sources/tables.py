"""Reading study tables and writing result tables."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, db: str | dict, table: str, format: str = "parquet") -> DataFrame:
    """A table of a study: from a folder of files, or by JDBC options.

    ``db`` is a folder (``<db>/<table>.<format>``, format parquet or csv; CSV
    has headers and NA for null), or a dict of JDBC options without ``dbtable``.
    """
    if isinstance(db, dict):
        return spark.read.format("jdbc").options(**db).option("dbtable", table).load()
    if format == "csv":
        return spark.read.csv(f"{db}/{table}.csv", header=True, nullValue="NA")
    if format != "parquet":
        raise ValueError(f"unknown format {format!r}")
    return spark.read.parquet(f"{db}/{table}.parquet")


def read_domains(spark: SparkSession, db: str | dict, tables: list[str], format: str = "parquet") -> dict[str, DataFrame]:
    """Several tables by lower-case name."""
    return {t.lower(): read_table(spark, db, t, format) for t in tables}


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, unquoted, nulls as NA; for result tables of a few hundred rows.

    A value with a comma, a quote or a line break would not read back, so it raises.
    """
    rows = df.collect()
    text = io.StringIO()
    out = csv.writer(text, quoting=csv.QUOTE_NONE, lineterminator="\n")
    try:
        out.writerow(df.columns)
        for row in rows:
            out.writerow(["NA" if v is None else v for v in row])
    except csv.Error as e:
        raise ValueError(f"a value can't be written unquoted: {e}") from e
    with open(path, "w", encoding="utf-8") as file:
        file.write(text.getvalue())
