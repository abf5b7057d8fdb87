"""Expressions that keep missing values, rounding and parsing as statistical software has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Sessions must use UTC, so that wall-clock differences are real ones.
UTC_CONF = {"spark.sql.session.timeZone": "UTC"}


def r_ifelse(condition: Column, yes: Column, no: Column) -> Column:
    """``yes`` or ``no``; a null condition gives null."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def try_number(column: Column) -> Column:
    """The number that a text spells, null if none."""
    return column.try_cast("double")


def round_one(column: Column) -> Column:
    """To one decimal: the nearer of the two neighbours in binary, the even one at a tie."""
    tens = F.floor(column * 10)
    low, high = tens / 10, F.ceil(column * 10) / 10
    even = F.when(tens % 2 == 0, low).otherwise(high)
    return F.when(F.abs(column - low) < F.abs(high - column), low).when(F.abs(column - low) > F.abs(high - column), high).otherwise(even)


def number_text(column: Column) -> Column:
    """Text of a number with one decimal at most; whole numbers have none."""
    return F.when(column.isNotNull(), F.regexp_replace(F.format_string("%.1f", column), r"\.0$", ""))


def to_datetime(column: Column) -> Column:
    """Date and time of ISO text. A missing time is midnight; a partial date is null."""
    return F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}"), column.try_cast("timestamp_ntz"))


def hours_between(end: Column, start: Column) -> Column:
    """Hours with fractions between two datetimes."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def is_blq_text(column: Column) -> Column:
    """Whether a text concentration is no plain number: a ``<`` or any letter."""
    return F.lower(column).rlike("[<a-z]")


#: Spellings of routes.
ROUTES = {"oral": "oral", "subcutaneous": "sc", "sc": "sc", "intramuscular": "im", "im": "im", "intravenous": "iv", "iv": "iv"}


def normalized_route(column: Column) -> Column:
    """oral, sc, im or iv; anything else, null too, is oral."""
    out = F
    for k, (spelling, route) in enumerate(ROUTES.items()):
        out = out.when(F.lower(column) == spelling, route) if k else F.when(F.lower(column) == spelling, route)
    return out.otherwise("oral")


def nearest_cut(column: Column, values: list[float]) -> Column:
    """The value nearest to the column; at a midpoint the later one. ``values`` ascend; null stays null."""
    if not values:
        raise ValueError("no values to match with")
    cuts = F.array(*[F.lit((a + b) / 2) for a, b in zip(values, values[1:])]).cast("array<double>")
    at = F.size(F.filter(cuts, lambda c: column >= c)) + 1
    return F.when(column.isNotNull(), F.element_at(F.array(*[F.lit(float(v)) for v in values]), at))


#: Levels of all columns together that are put into the plan; more are numbered over ranges and joined.
FEW_LEVELS = 20_000


def coded_by_level(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds integer codes 1, 2, ... by sorted distinct value; ``columns`` maps a column to its code's name.

    Null stays null.  Levels are few by nature (arms, races, countries): one
    job gathers those of all columns.
    """
    from .numbering import number_rows

    names = list(columns)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("value")) for k, c in enumerate(names)])
    found = df.select(F.explode(pairs).alias("x")).select("x.k", "x.value").where("value is not null").distinct().limit(FEW_LEVELS + 1).collect()
    if len(found) > FEW_LEVELS:
        for name, code in columns.items():
            levels = number_rows(df.select(F.col(name).alias("_level")).where("_level is not null").distinct(), ["_level"], code)
            df = df.join(levels, F.col(name) == F.col("_level"), "left").drop("_level")
        return df

    def code_of(k: int, name: str) -> Column:
        # sorted as the engine sorts the column's type
        kind = df.schema[name].dataType
        levels = F.array_sort(F.array(*[F.lit(r.value).cast(kind) for r in found if r.k == k]))
        return F.when(F.col(name).isNotNull(), F.array_position(levels, F.col(name)))

    return df.withColumns({columns[c]: code_of(k, c) if any(r.k == k for r in found) else F.lit(None).cast("long") for k, c in enumerate(names)})


def upper_names(df: DataFrame) -> DataFrame:
    """Column names in upper case; raises if two then clash."""
    names = [c.upper() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names clash in upper case: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names)
