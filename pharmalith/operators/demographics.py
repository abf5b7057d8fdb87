"""A summary table of continuous and categorical demographics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import number_text, round_one, try_number
from ..sources import write_csv

#: What is summarised by default.
DEFAULT = ("weight", "height", "sex", "age", "race", "ethnic", "arm")
#: Columns that may come from the subject table.
FROM_DM = ("age", "sex", "race", "ethnic", "arm", "actarm", "country", "siteid", "studyid", "domain", "armcd")
#: Statistics, in their order.
STATISTICS = ("mean", "sd", "median", "min_max")


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def vitals_wide(vs: DataFrame, names: Sequence[str], order_by: str | None = None) -> DataFrame:
    """A row per subject with the first text value of each named vital sign, by ``order_by`` or as read."""
    order = F.col(order_by.lower()).cast("long") if order_by else F.monotonically_increasing_id()
    rows = _lower(vs).withColumn("_ord", order).where(F.lower("vstest").isin(list(names)))
    # one aggregate: the least place decides for each vital
    firsts = [F.min(F.when(F.lower("vstest") == n, F.struct("_ord", F.col("vsstresc").cast("string").alias("value"))))["value"].alias(n) for n in names]
    return rows.groupBy("usubjid").agg(*firsts)


def subject_demographics(data: dict[str, DataFrame], demographics: Sequence[str] = DEFAULT, group: str | None = None, order_by: str | None = None) -> tuple[DataFrame, list[str]]:
    """A row per subject with the demographics found, and their names: vitals first, then the subject table's.

    Unknown names are skipped; none found raises.  A name found in both raises.
    Of a subject's several rows the first by ``order_by`` counts, in each table
    that has that column; without it rows count as read.
    """
    data = {k.lower(): v for k, v in data.items()}
    wanted = list(dict.fromkeys(d.lower() for d in demographics))
    vs, dm = data.get("vs"), data.get("dm")
    has = {r[0] for r in _lower(vs).select(F.lower("vstest")).where(F.lower("vstest").isin(wanted)).distinct().collect()} if vs is not None else set()
    from_vs = [d for d in wanted if d in has]
    in_dm = [c.lower() for c in dm.columns] if dm is not None else []
    from_dm = [d for d in wanted if d in FROM_DM and d in in_dm]
    if both := set(from_vs) & set(from_dm):
        raise ValueError(f"found in both tables: {sorted(both)}")
    if not from_vs + from_dm:
        raise ValueError(f"no demographics found among {wanted}")
    extra = [group.lower()] if group and group.lower() not in from_dm else []
    if dm is not None:
        own = order_by.lower() if order_by and order_by.lower() in in_dm else None
        low = _lower(dm).withColumn("_ord", F.col(own).cast("long") if own else F.monotonically_increasing_id())
        columns = [*from_dm, *extra]
        subjects = low.groupBy("usubjid").agg(F.min(F.struct("_ord", *columns)).alias("x")).select("usubjid", *[F.col(f"x.{c}").alias(c) for c in columns])
        if from_vs:
            subjects = subjects.join(vitals_wide(vs, from_vs, order_by), "usubjid", "full")
    else:
        subjects = vitals_wide(vs, from_vs, order_by)
    return subjects.select("usubjid", *from_vs, *from_dm, *extra), from_vs + from_dm


def split_kinds(subjects: DataFrame, names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Continuous and categorical names: numeric columns, and texts that all spell numbers, are continuous. One pass over the data."""
    texts = [n for n in names if not isinstance(subjects.schema[n].dataType, T.NumericType)]
    if not texts:
        return list(names), []
    counts = subjects.agg(*[F.count(n).alias(f"{n}_n") for n in texts], *[F.count(try_number(F.col(n).cast("string"))).alias(f"{n}_k") for n in texts]).first()
    categorical = [n for n in texts if counts[f"{n}_n"] == 0 or counts[f"{n}_n"] != counts[f"{n}_k"]]
    return [n for n in names if n not in categorical], categorical


def continuous_summary(subjects: DataFrame, names: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """mean, sd, median and min_max of each name, as text with one decimal; long."""
    values = subjects.select(*group, *[try_number(F.col(n).cast("string")).alias(n) for n in names]).unpivot(list(group), list(names), "name", "value")
    stats = values.groupBy(*group, "name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))
    text = lambda c: number_text(round_one(F.col(c)))
    wide = stats.select(*group, "name", text("mean").alias("mean"), text("sd").alias("sd"), text("median").alias("median"), F.concat(text("low"), F.lit(" - "), text("high")).alias("min_max"))
    return wide.unpivot([*group, "name"], list(STATISTICS), "statistic", "value")


def categorical_summary(subjects: DataFrame, names: Sequence[str], group: Sequence[str] = (), levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Counts of each level of each name, nulls left out; long, in one aggregate.

    ``levels`` names all levels that a column may have: those that no subject
    has count 0 (in each group), as levels of a factor do.
    """
    rows = subjects.select(*group, *[F.col(n).cast("string").alias(n) for n in names]).unpivot(list(group), list(names), "name", "level").where("level is not null")
    counts = rows.groupBy(*group, "name", "level").agg(F.count("*").alias("n"))
    given = [(n.lower(), x) for n, own in (levels or {}).items() if n.lower() in names for x in own]
    if given:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("level")) for n, x in given])).alias("x")
        groups = subjects.select(*group).distinct() if group else subjects.sparkSession.range(1).select()
        counts = counts.unionByName(groups.select(*group, pairs).select(*group, "x.name", "x.level", F.lit(0).cast("long").alias("n"))).groupBy(*group, "name", "level").agg(F.sum("n").alias("n"))
    return counts.select(*group, "name", "level", F.col("n").cast("string").alias("value"))


def create_demographics_table(data: dict[str, DataFrame], demographics: Sequence[str] = DEFAULT, group: str | None = None, path: str | None = None, order_by: str | None = None, levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Demographic, Statistic, Value/count: continuous ones by name, then categorical ones as asked for, levels sorted.

    A demographic's name stands on its first row only.  ``group`` adds a
    summary per value of that column, first column of the result.  ``levels``
    adds levels that nobody has (see ``categorical_summary``).  ``path`` also
    writes CSV.  Which vitals and kinds there are decides the result's
    shape, so two small jobs run first.
    """
    subjects, names = subject_demographics(data, demographics, group, order_by)
    keys = [group.lower()] if group else []
    continuous, categorical = split_kinds(subjects, [n for n in names if n not in keys])
    parts = []
    if continuous:
        stat = F.array_position(F.array(*[F.lit(s) for s in STATISTICS]), F.col("statistic"))
        parts.append(continuous_summary(subjects, continuous, keys).select(*keys, F.lit(0).alias("_section"), F.lit(0).cast("long").alias("_name"), "name", stat.alias("_stat"), "statistic", "value"))
    if categorical:
        at = F.array_position(F.array(*[F.lit(n) for n in categorical]), F.col("name"))
        parts.append(categorical_summary(subjects, categorical, keys, levels).select(*keys, F.lit(1).alias("_section"), at.alias("_name"), "name", F.lit(0).cast("long").alias("_stat"), F.col("level").alias("statistic"), "value"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = ["_section", "_name", "name", "_stat", "statistic"]
    first = F.row_number().over(Window.partitionBy(*keys, "name").orderBy(*order)) == 1
    out = rows.withColumn("_first", first).orderBy(*keys, *order).select(*keys, F.when(F.col("_first"), F.col("name")).otherwise("").alias("Demographic"), F.col("statistic").alias("Statistic"), F.col("value").alias("Value/count"))
    if path:
        write_csv(out, path)
    return out
