import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pharmalith.llm import neardups, simtexts

from .test_neardups import brute, made

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("sizes", [{}, {"block": 4}, {"block_texts": 3}, {"block_texts": 3, "most_blocks": 1}])
def test_components_are_those_of_brute_force(spark, sizes):
    """With whole buckets and crowded ones, and each way to verify groups."""
    docs = made()
    assert {r.id: r.component_id for r in simtexts.near_duplicates(spark.createDataFrame(docs, SCHEMA), **sizes).collect()} == brute(docs)


def test_components_of_the_table(spark, table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert {r.id: r.component_id for r in simtexts.near_duplicates(table("documents")).collect()} == brute(docs)


def test_the_stage_is_simhash(spark, monkeypatch):
    """No band key is joined, and what goes is what brute force says."""
    def never(*_):
        raise AssertionError("MinHash bands")

    monkeypatch.setattr(neardups, "MINHASH", never)
    monkeypatch.setattr(neardups, "_met_in_batch", never)
    docs = made(120, 9)
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "").collect()
    assert {r.doc_id for r in left} == set(brute(docs).values())


def test_a_dense_group_of_chains(spark):
    """400 texts one word apart from the one before, far apart at the ends; buckets in cells too."""
    rng, words, docs = random.Random(3), [f"w{k}" for k in range(200)], []
    for k in range(400):
        words[rng.randrange(200)] = f"y{k}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, SCHEMA)
    for block in (simtexts.BLOCK, 16):
        assert {r.component_id for r in simtexts.near_duplicates(df, block=block).collect()} == {0}


@pytest.mark.parametrize("texts", [1000, 1 << 26])
@pytest.mark.parametrize("shared, own, other", [(4, 1, 0), (8, 2, 0), (8, 1, 1), (16, 2, 2), (80, 10, 10), (240, 60, 0), (800, 100, 100)])
def test_sets_of_likeness_0_8_meet(texts, shared, own, other):
    """Of 600 pairs at the limit at most one is lost, in small sets and large ones."""
    rng, sets = np.random.default_rng(shared + other), []
    for _ in range(600):
        x = rng.integers(0, 1 << 63, shared + own + other, dtype=np.uint64)
        sets += [x[: shared + own], np.concatenate([x[:shared], x[shared + own :]])]
    rows = simtexts.keys(sets, *simtexts.shape(texts))
    a, b = rows[::2], rows[1::2]
    near = simtexts._apart(a[:, :4], b[:, :4]) <= simtexts.RADIUS
    meet = np.array([len(np.intersect1d(x, y)) > 0 for x, y in zip(a[:, 4:], b[:, 4:])])
    assert (near & meet).sum() >= 599
    assert (simtexts._apart(a[1:, :4], a[:-1, :4]) > simtexts.RADIUS).all()


def test_votes_are_sums_over_shingles(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 3, 5000, 2, 40)]
    whole = simtexts.votes(sets, 40)
    for x, sums in zip(sets, whole):
        assert (sum(simtexts.votes([x[k : k + 1]], 40)[0] for k in range(len(x))) == sums).all()
    monkeypatch.setattr(simtexts, "_SHINGLES", 7)
    assert (simtexts.votes(sets, 40) == whole).all()


def test_links_span_what_is_near_in_each_bucket():
    """The same components as all pairs within buckets, whatever the batches; small groups and large ones."""
    rng = np.random.default_rng(5)
    n = 900
    key = np.sort(rng.choice([*[1] * 5, *[2] * 40, *range(3, 40)], n))
    base = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
    prints = base[rng.integers(0, 3, n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, 4)).astype(np.uint64))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b].view(np.int64)) for c in (key, np.arange(n), *prints.T.copy())], ["key", "node", "f0", "f1", "f2", "f3"]) for a, b in ((0, 5), (5, 5), (5, 300), (300, 301), (301, n))]
    got = [r for b in simtexts._near_in_buckets(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    want = [(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and simtexts._apart(prints[i], prints[j]) <= simtexts.RADIUS]
    assert set(got) <= set(want)

    def components(pairs):
        root = list(range(n))
        for a, b in pairs:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        for k in range(n):
            root[k] = root[root[k]]
        return root

    assert len(got) < n < len(want)
    links = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*want)], ["a", "b"])
    forest = [r for b in simtexts._forest(iter([links[:50], links[50:]])) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert set(forest) <= set(want) and len(forest) < n and components(forest) == components(want)
    assert components(got) == components(want)
