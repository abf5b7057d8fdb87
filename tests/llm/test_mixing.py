import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pharmalith.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by the rule's words: stop sources above their limit, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    free, left, out = set(order), share * sum(sizes.values()), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def check(got, near):
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
    want = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near


def sized(spark, rows, **k):
    out = mixing.mix(spark.createDataFrame(rows, "id long, source string, size long"), **k)
    return out.withColumn("taken", F.col("copies") * F.col("size")).collect()


@pytest.mark.parametrize("leaf, fan_in", [(1024, 64), (64, 2)])
def test_random_sources(spark, leaf, fan_in):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "a", "b", "ç", "Z", None]), int(rng.paretovariate(1.1) * 20) % 5000) for k in range(800)]
    got = sized(spark, rows, leaf=leaf, fan_in=fan_in)
    assert len(got) == 800
    check(got, 5000 if leaf < 100 else 60)  # the last of many small leaves may be a long row
    assert sorted(map(str, got)) == sorted(map(str, sized(spark, rows[::-1], leaf=leaf, fan_in=fan_in)))


def test_whole_table(spark, table):
    docs = table("documents")
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    got = mixing.op8(spark, docs).collect()
    assert {r.doc_id: r["size"] for r in got} == size
    check([type("R", (), {**r.asDict(), "source": source[r.doc_id], "__getitem__": lambda self, k: getattr(self, k)})() for r in got], max(size.values()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op8(spark, docs.repartition(5)).collect()))


def settled(sizes, fractions, seed, leaves=1):
    """Copies of each row of one group after all levels, the random numbers by numpy."""
    rng, n = np.random.default_rng(seed), len(sizes)
    rows = [({"id": k, "size": s, "nth": 1, "times": 1}, "a", k % leaves, float(s), f) for k, (s, f) in enumerate(zip(sizes, fractions))]
    got = {}
    while True:
        rows.sort(key=lambda r: (r[2], -r[3], r[0]["id"]))
        columns = zip(*[(*r, u) for r, u in zip(rows, rng.random(n))])
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, mixing._TYPES)], ["row", "source", "leaf", "size", "fraction", "u"])
        out = [r for b in mixing._settle(leaves == 1)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert len(out) == len(rows)
        got |= {r[0]["id"]: r[6] for r in out if r[6] is not None}
        rows = [(*r[:2], 0, r[3], r[4]) for r in out if r[6] is None]
        if leaves == 1:
            return np.array([got[k] for k in range(n)])
        leaves = 1


@pytest.mark.parametrize("leaves", [1, 3])
@pytest.mark.parametrize("sizes, fractions", [([7] * 8, 0.75), ([50, 40, 30, 20, 10, 5], 0.75), ([10] * 6, 0.9), ([1000, 3, 2, 1, 0, 0], 0.3), ([100, 90, 1], [0.2, 0.5, 0.999])])
def test_each_row_keeps_its_expectation(sizes, fractions, leaves):
    """Over 2,000 draws each row's own mean is its fraction, and the words hardly move."""
    fractions = np.broadcast_to(fractions, len(sizes))
    draws = np.array([settled(sizes, fractions.tolist(), seed, leaves) for seed in range(10**6, 10**6 + 2000)])
    error = np.sqrt(fractions * (1 - fractions) / len(draws))
    assert (np.abs(draws.mean(axis=0) - fractions) <= 4 * error).all()
    off = np.abs(draws @ np.array(sizes) - fractions @ np.array(sizes))
    assert off.max() <= max(sizes)


def test_equal_rows_are_rounded_each_for_itself(spark):
    """1,000 rows without an id and of one size take the target's words, not all or none."""
    rows = [(None, "a", 5)] * 1000 + [(k, "b", 5) for k in range(1000)]
    got = sized(spark, rows)
    assert len(got) == 2000
    check(got, 5)
    assert {r.copies for r in got if r.source == "a"} == {1, 2} or {r.copies for r in got if r.source == "a"} == {2}


def test_equal_rows_of_the_table_take_what_the_mix_says(spark):
    docs = spark.createDataFrame([(None, f"word{k % 7} x y", "a") for k in range(300)] + [(k, "p q r", "b") for k in range(300)], "doc_id long, text string, source string")
    rows = docs.selectExpr("cast(doc_id as long) id", "source", "3L size")
    taken = mixing.mix(rows, weights=(1, 3), share=0.75, most=1.0).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    mixed = mixing.apply_mix(docs, weights=(1, 3), share=0.75, most=1.0).collect()
    assert {r.source: r.n for r in taken} == {s: sum(r.source == s for r in mixed) for s in "ab"}
    assert max(sum(r.text == f"word{k} x y" for r in mixed) for k in range(7)) <= 43


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "a", 1), (3, "x y", None, 2), (3, "x y", None, 2), (None, "z " * 100_000, "b", 3)], "doc_id long, text string, source string, copies int")
    got = mixing.op8(spark, docs).collect()
    assert len(got) == 5 and {(r["size"], r.source_size) for r in got} == {(0, 0), (2, 4), (100_000, 100_000)}
    assert mixing.op8(spark, docs.limit(0)).collect() == []
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    taken = {(r.doc_id, r["size"]): r.taken for r in got}
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in got) and taken
    only_empty = mixing.op8(spark, docs.where("doc_id < 3")).collect()
    assert [(r.target, r.taken) for r in only_empty] == [(0.0, 0), (0.0, 0)]
