import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pharmalith.llm import neardups


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1))))


def brute(docs):
    """Least id of each component of pairs with Jaccard likeness 0.8 or more, compared pair by pair."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def made(n=240, seed=4):
    """Texts, copies with a few words changed (likeness from about 0.6 to 1), and chains of such copies."""
    rng, docs = random.Random(seed), []
    for k in range(n):
        if k % 3 and docs:
            words = rng.choice(docs[-40:])[1].split()
            for _ in range(rng.randrange(5)):
                if words:
                    words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        else:
            words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 1, 3, 5, 9, 40, 90, 200]))]
        docs.append((k, " ".join(words)))
    return docs


@pytest.mark.parametrize("sizes", [{}, {"block_texts": 3}, {"block_texts": 3, "most_blocks": 1}])
def test_components_are_those_of_brute_force(spark, sizes):
    """In one cell for each group, in several, and in cells of the bands' buckets."""
    docs = made()
    got = {r.id: r.component_id for r in neardups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **sizes).collect()}
    assert got == brute(docs)


def test_classes_and_components_of_the_table(spark, table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    got = neardups.near_duplicates(table("documents")).collect()
    assert {r.id: r.component_id for r in got} == brute(docs)
    first = {}
    for d, t in sorted(docs):
        first.setdefault(shingles(t), d)
    assert {r.id: r.class_id for r in got} == {d: first[shingles(t)] for d, t in docs}


def test_a_dense_group_of_chains(spark):
    """400 texts one word apart from the one before, far apart at the ends; and the same with small blocks."""
    rng, words, docs = random.Random(3), [f"w{k}" for k in range(200)], []
    for k in range(400):
        words[rng.randrange(200)] = f"y{k}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for sizes in ({}, {"block_texts": 50, "most_blocks": 3}):
        assert {r.component_id for r in neardups.near_duplicates(df, **sizes).collect()} == {0}


def test_links_of_bands_span_each_bucket():
    """Joined within batches and then in buckets, members of one key end up in one component, whatever the batches."""
    rng = np.random.default_rng(1)
    nodes, keys = np.arange(300), rng.integers(0, 40, (300, 3)).astype("<u8")
    batches = [pa.RecordBatch.from_arrays([pa.array(nodes[a:b]), pa.array([k.tobytes() for k in keys[a:b]], pa.binary())], ["node", "keys"]) for a, b in ((0, 100), (100, 110), (110, 300))]
    rows = [r for b in neardups._met_in_batch(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sum(r[2] is None for r in rows) <= 3 * 40
    rows.sort(key=lambda r: r[:2])
    parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 7])], ["key", "node", "least"]) for a in range(0, len(rows), 7)]
    root = list(range(300))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    def joined(pairs):
        root[:] = range(300)
        for x, y in pairs:
            x, y = top(x), top(y)
            root[max(x, y)] = min(x, y)
        return [top(x) for x in range(300)]

    got = joined([r for b in neardups._met_in_bucket(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns))])
    of_key = {}
    for n, ks in zip(nodes.tolist(), keys.tolist()):
        for k in ks:
            of_key.setdefault(k, []).append(n)
    assert got == joined([(m[0], x) for m in of_key.values() for x in m[1:]])


def test_pipeline_stage_leaves_no_two_alike(spark, table):
    """The stage on the table and on copies with every 45th word changed, about 0.8 alike."""
    docs = [(r.doc_id, r.text) for r in table("documents").collect()] + made(90)
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    base = " ".join(f"b{k}" for k in range(300))
    docs += [(len(docs) + j, " ".join(f"c{j}" if j and k % 45 == j else w for k, w in enumerate(base.split()))) for j in range(4)]
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    assert left == set(brute(docs).values())


def test_spanning_links_of_odd_sets():
    some = [np.array(x, dtype=np.uint64) for x in ([], [1, 2, 3, 4, 5], [], [1, 2, 3, 4, 9], [1, 2, 3, 4], [7], [7], [])]
    assert {frozenset(x) for x in neardups.spanning_links(some)} == {frozenset(x) for x in ((1, 4), (3, 4), (5, 6))}
    assert neardups.spanning_links([]) == [] and neardups.spanning_links(some[:1]) == []


def test_bitmap_loses_no_member(spark, monkeypatch):
    rows = neardups.hashed_rows(spark.createDataFrame([(k if k % 3 else None, f"text {k}") for k in range(3000)], "doc_id long, text string"), "doc_id", "text")
    members = rows.where("length(text) = 6").select("id", "h")
    want = sorted(r.text for r in rows.where("length(text) = 6").collect())
    for bits in (neardups.MOST_BITS, 15):
        monkeypatch.setattr(neardups, "MOST_BITS", bits)
        got = [r.text for r in neardups._with_hash_in(rows, members).collect()]
        assert set(want) <= set(got) and len(got) < 1500
    assert neardups._with_hash_in(rows, members.limit(0)).collect() == []
