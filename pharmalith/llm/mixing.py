"""Mixing sources to target weights, by pivotal dependent rounding.

Every row of a source has the same expected number of copies, target / size of
the source, at most 2.  Its whole part is taken; the fractional parts of a
source's rows are rounded together.  Rows meet in descending size.  Of a pair,
words move from one row to the other until one of the two is integral: either
way, as far as the first of the two limits, and the way is drawn so that both
rows keep their expected copies (up with probability down / (up + down)).  The
row that is left fractional meets the next one.  So each row is taken as often
as its fraction says, and the words of a source stay what they were, but for
its last row, which is rounded by itself.  Rows without words move none; each
is rounded by itself.

The pairs form a tree: leaves hold about ``LEAF`` rows of one source, a hot
source having many; the row left over in each leaf goes to the next level with
its fraction, ``FAN_IN`` leaves together, until one row of the source is left.
Random numbers are hashes of the row and the level, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import number_rows
from .shared import materialise

WEIGHTS = (5, 2, 1)
#: Words that the mix takes, as a share of all words.
SHARE = 1.5
#: Times that a source, and so a row, may be taken at most.
MOST = 2.0
LEAF = 2048
FAN_IN = 256
SEED = 42
#: Fractions nearer than this to 0 or 1 are integral.
NEAR = 1e-9
#: Occurrences of equal rows that are made from one row at a time.
TOGETHER = 4096

#: `[^\x20\x09-\x0D]+`
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(column):
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(_WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of each source by code point, null last, counted over ranges of sources."""
    ordered = materialise(sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "sources")
    sizes = sorted(tuple(x) for x in ordered.groupBy("part").agg(F.count("*"), F.min("row")).collect())  # a row per task
    before, start = 0, []
    for part, n, first in sizes:
        start.append((part, before - first))
        before += n
    shift = F.create_map(*[F.lit(x) for pair in start for x in pair]) if start else F.create_map(F.lit(0), F.lit(0))
    return ordered.withColumn("rank", F.col("row") + shift[F.col("part")]).drop("part", "row")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, n, source_size, target`` from ``source, n, source_size`` rows, one per source.

    A target is the weight's share of what is left after the sources that stop
    at ``most`` times their size.  Each pass finds more sources that stop, until
    a pass finds none; only sums come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialise(_ranked(sources).withColumn("weight", weight), "weights")
    limit = F.col("source_size") * F.lit(float(most))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * min(share, most)
    level, stopped = 0.0, -1
    while True:
        stops = limit <= F.col("weight") * F.lit(level)
        n, full, open_weight = table.agg(F.sum(stops.cast("long")), F.sum(F.when(stops, limit)), F.sum(F.when(~stops, F.col("weight")))).first()
        if n is None or n == stopped or not open_weight:
            break
        stopped = n
        level = max(level, (total - (full or 0.0)) / open_weight)
    out = F.least(limit, F.col("weight") * F.lit(level)) if stopped >= 0 and open_weight else limit
    return table.select("source", "n", "source_size", out.alias("target"))


def _settle(final: bool):
    """Rounds the rows of each sorted group (source, leaf); leaves the last fractional row undecided unless ``final``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = first_u = waiting = None  # waiting: the fractional row of the group, and its fraction now
        fraction = 0.0
        names = ["row", "source", "leaf", "size", "fraction", "u", "extra"]

        def closed() -> tuple:
            """The last row of a group, rounded by the random number of the first one, which no pair uses."""
            return (*waiting[:4], fraction, waiting[5], int(first_u < fraction) if final else None)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[1], row[2]) != group:
                    if waiting is not None:
                        out.append(closed())
                    group, waiting = (row[1], row[2]), None
                size, mine, u = row[3], row[4], row[5]
                if not size:
                    out.append((*row, int(u < mine)))
                elif mine <= NEAR or mine >= 1 - NEAR:
                    out.append((*row, int(mine > 0.5)))
                elif waiting is None:
                    waiting, fraction, first_u = row, mine, u
                else:
                    of = waiting[3]
                    up = min((1 - fraction) * of, mine * size)  # words that the waiting row may get
                    down = min(fraction * of, (1 - mine) * size)  # and may give
                    move = up if u * (up + down) < down else -down
                    fraction, mine = fraction + move / of, mine - move / size
                    if NEAR < fraction < 1 - NEAR:
                        out.append((*row, int(mine > 0.5)))
                    elif NEAR < mine < 1 - NEAR:
                        out.append((*waiting, int(fraction > 0.5)))
                        waiting, fraction = row, mine
                    else:  # both at once
                        out += [(*waiting, int(fraction > 0.5)), (*row, int(mine > 0.5))]
                        waiting = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names)
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(closed(), _TYPES)], names)

    return run


_SCHEMA = "row struct<id:long,size:long,nth:long,times:long>, source string, leaf long, size double, fraction double, u double, extra int"
_TYPES = [pa.struct([("id", pa.int64()), ("size", pa.int64()), ("nth", pa.int64()), ("times", pa.int64())]), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]


def _occurrences(alike: DataFrame) -> DataFrame:
    """A row per occurrence, ``nth`` from 1; none is made of more than ``TOGETHER`` at a time."""
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / TOGETHER))))
    start = F.col("part") * TOGETHER
    return parts.withColumn("nth", F.explode(F.sequence(start + 1, F.least(start + TOGETHER, F.col("times"))))).drop("part")


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, leaf: int = LEAF, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """``id, source, size, nth, times, source_size, target, copies`` from ``id, source, size`` rows, a row for each.

    Equal rows are numbered (``nth`` of ``times``) and rounded each for itself.
    Rows of size zero take copies by their own fraction.  Sources may be null;
    null ids are ids like any other.  An empty table gives no rows.
    """
    alike = materialise(rows.groupBy("id", "source", "size").agg(F.count("*").alias("times")), "sizes")
    of = materialise(targets(alike.groupBy("source").agg(F.sum("times").alias("n"), F.sum(F.col("size") * F.col("times")).alias("source_size")), weights, share, most), "targets")
    most_rows = of.agg(F.max("n")).first()[0] or 0
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of = of.withColumn("copies", copies).withColumn("leaves", F.ceil(F.col("n") / leaf))

    def random(level: int, *columns: str):
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *[F.coalesce(c, F.lit(-1)) for c in columns], F.coalesce("source", F.lit(""))), 11) / F.lit(float(1 << 53))

    # sources are dealt out by leaf below; here AQE may split a hot one
    level = _occurrences(alike.join(of.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))).select(
        F.struct("id", F.col("size"), "nth", "times").alias("row"), "source", F.pmod(F.xxhash64("id", "size", "nth"), F.col("leaves")).alias("leaf"),
        F.col("size").cast("double").alias("size"), (F.col("copies") - F.floor("copies")).alias("fraction"), random(0, "id", "size", "nth").alias("u"),
    )
    leaves, decided, depth = math.ceil(most_rows / leaf), [], 0
    while True:
        final = leaves <= 1
        sorted_rows = level.repartition("source", "leaf").sortWithinPartitions("source", "leaf", F.desc("size"), "row.id", "row.nth")
        done = materialise(sorted_rows.mapInArrow(_settle(final), _SCHEMA), "rounded")
        decided.append(done.where("extra is not null").select("row", "source", "extra"))
        if final:
            break
        depth += 1
        level = done.where("extra is null").select("row", "source", F.floor(F.col("leaf") / fan_in).alias("leaf"), "size", "fraction", random(depth, "row.id", "row.size", "row.nth").alias("u"))
        leaves = math.ceil(leaves / fan_in)
    extra = decided[0]
    for x in decided[1:]:
        extra = extra.unionAll(x)
    out = extra.join(of.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return out.select("row.id", "source", "row.size", "row.nth", "row.times", "source_size", "target", (F.floor("copies") + F.col("extra")).alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows of one id, source and size are numbered in the order of their
    contents, over ranges, to meet the numbers of the mix.  Null texts have no
    words; columns of any name pass through; an empty table stays empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    taken = mix(rows, **options).select(F.col("id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), F.col("nth").alias("mix_nth"), "times", "copies")
    # positional names, so that no column of the documents can clash with these
    held = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    of = {name: F.col(f"c{k}") for k, name in enumerate(docs.columns)}
    key = [of[id_col].cast("long"), of[source_col].cast("string"), word_count(of[text_col])]
    same = key[0].eqNullSafe(F.col("mix_id")) & key[1].eqNullSafe(F.col("mix_source")) & (key[2] == F.col("mix_size"))
    found = held.join(taken.where("times = 1 and copies > 0"), same)
    repeated = taken.where("times > 1")
    if repeated.limit(1).count():
        of_many = held.join(repeated.where("mix_nth = 1").select("mix_id", "mix_source", "mix_size"), same, "left_semi")
        numbered = number_rows(of_many, [*key, F.xxhash64(*held.columns)], "place")
        first = numbered.groupBy(key[0].alias("mix_id"), key[1].alias("mix_source"), key[2].alias("mix_size")).agg(F.min("place").alias("first"))
        copies = repeated.where("copies > 0").join(
            first.select(F.col("mix_id").alias("a"), F.col("mix_source").alias("b"), F.col("mix_size").alias("c"), "first"), F.col("mix_id").eqNullSafe(F.col("a")) & F.col("mix_source").eqNullSafe(F.col("b")) & (F.col("mix_size") == F.col("c"))
        ).select((F.col("first") + F.col("mix_nth") - 1).alias("at"), "copies")
        found = found.select(*held.columns, "copies").unionAll(numbered.join(copies, F.col("place") == F.col("at")).select(*held.columns, "copies"))
    joined = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select(*held.columns).toDF(*docs.columns)


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    return mix(rows).select(F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


__all__ = ["apply_mix", "mix", "op8", "targets", "word_count"]
