import hashlib
import random
import re

from pharmalith.llm import decontaminate

LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for s in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[s : s + size]), set()).add(str(name))
    lengths, out = {len(k) for k in windows}, {}
    for doc_id, text in docs:
        w, found = words(text), set()
        hit = [False] * len(w)
        for m in lengths:
            for k in range(len(w) - m + 1):
                if names := windows.get(tuple(w[k : k + m])):
                    found |= names
                    hit[k : k + m] = [True] * m
        out[doc_id] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    return out


def run(spark, docs, items, **k):
    out = decontaminate.find_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **k)
    return {r.id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in out.collect()}


def test_whole_table(spark, table):
    docs, items = ([(r[0], r[1]) for r in table(t).select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.op6(spark, table("documents"), table("benchmark")).collect()}
    assert got == brute(docs, items) and any(v[4] for v in got.values())


def test_random_words_of_a_small_alphabet(spark):
    """Many overlapping and repeated windows, of all lengths, also in several blocks of patterns."""
    rng = random.Random(1)
    text = lambda n, a: " ".join(rng.choice(a) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14]), "xyz")) for k in range(2, 30)] + [(40, None), (41, "--- ///"), (3, text(12, "ab")), (3, text(12, "ab"))]
    items = [(a, b) for a, b in items if b is None or len(b.split()) != 1]
    docs = [(k, text(rng.choice([0, 1, 3, 9, 10, 30, 300, 700]), "xyz" if k % 3 else "ab")) for k in range(60)] + [(99, None), (98, "")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_bytes=40) == want


def test_edges(spark):
    item = "Alpha beta, GAMMA delta; epsilon zeta eta theta iota kappa lambda"
    docs = [(1, item), (2, item.upper()), (3, "é " + item.replace(" ", "\n")), (4, "alpha beta gamma delta epsilon zeta eta theta iota"), (5, "y " * 200_000 + item), (6, item.replace("zeta", "zéta"))]
    items = [(7, item), (None, "solo words"), (8, "ÄB äb")]
    got = run(spark, docs, items)
    assert [got[k][1] for k in range(1, 7)] == [11, 11, 11, 0, 11, 0]
    assert run(spark, docs, []) == {k: (v[0], 0, 0, hashlib.sha256(b"").hexdigest(), False) for k, v in got.items()}
    assert run(spark, [], items) == {}


def test_filter_keeps_clean_rows_whole(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "s", 1), (2, "clean", None, None), (2, "clean", None, None), (3, None, "t", 3)], "doc_id long, text string, n_hit string, id int")
    bench = spark.createDataFrame([(1, "b c d e f g h i j l")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 3]
    bench = spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 2, 3]


def test_tables_of_a_large_benchmark_still_move_the_search():
    """100,000 windows: most entries of the table are not zero, buckets are short, and the search finds what is planted."""
    import numpy as np
    import pyarrow as pa

    from pharmalith.llm.bytewords import ALNUM, text_buffer, words_of

    rng = random.Random(6)
    items = [(str(k), " ".join(f"w{rng.randrange(50_000)}" for _ in range(209))) for k in range(500)]
    names, groups = decontaminate.build_patterns(items)
    (patterns,) = groups
    assert len(patterns.text) == 100_000 and (patterns.shift == 0).mean() < 0.1 and np.unique(patterns.tails, return_counts=True)[1].max() < 8
    plain = [f"w{rng.randrange(50_000)}" for _ in range(5000)]
    plain[1000:1000] = items[7][1].split()[50:65]
    data, offsets = text_buffer(pa.array([" ".join(plain)], pa.string()))
    doc = words_of(data, offsets, ALNUM)
    at, which = patterns.search(doc, doc.hashes())
    assert sorted(at.tolist()) == list(range(1000, 1006)) and {names[i] for p in which for i in patterns.items[p]} == {"7"}
