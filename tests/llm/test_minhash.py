import hashlib
import re

import numpy as np

from pharmalith.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(got, rows):
    ring = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    errors = []
    by_id = {r.doc_id: r for r in got}
    for k, (doc_id, text) in enumerate(ring):
        text, following, r = text or "", ring[(k + 1) % len(ring)][1] or "", by_id[doc_id]
        new = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.edited_fingerprint == minhash.hex_of(minhash.signatures_of([new])[0]) and r.fingerprint == minhash.hex_of(minhash.signatures_of([text])[0])
        errors += [r.near_edited - likeness(text, new), r.near_next - likeness(text, following)]
    return np.array(errors)


def test_whole_table(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    errors = check(minhash.op5(spark, table("documents")).collect(), rows)
    assert np.abs(errors).max() < 0.2 and errors.std() < 0.05


def test_small_tables_and_odd_texts(spark):
    texts = [None, "", " ", "one", "a b c d", "é" * 10, "x " * 100_000, "A b C d E f", "a b c d e f", "日本語 " * 50]
    for n in range(len(texts) + 1):
        rows = [(k * 7 % 97, t) for k, t in enumerate(texts[:n])]
        got = minhash.op5(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")).collect()
        check(got, rows)


def test_equal_texts_repeated_ids_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "other words are in this text")]
    got = minhash.op5(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 2


def test_null_and_repeated_ids_in_many_shards(spark):
    """A third of the rows without an id and a third with one id: shards cut them by their texts, and the ring stays whole."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(f"w{k}x{j}" for j in range(8))) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.fingerprint_with_edits(df, parts=12).collect()
    assert len(got) == 90 and {r.n_chars for r in got} <= {len(t) for _, t in rows}
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    ring = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = {hashlib.sha256((t[: len(t) - len(t) // 3] + ring[(k + 1) % 90][1][: len(t) // 3]).encode()).hexdigest() for k, (_, t) in enumerate(ring)}
    assert {r.edited_sha256 for r in got} == want
    placed = minhash.in_ring(minhash.hashed_rows(df, "doc_id", "text"), 12)
    sizes = [r["count"] for r in placed.where("guest = 0").groupBy("shard").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 25


def test_classes_and_components(spark):
    """Classes and components as by all pairs; texts of one id are told apart."""
    base = [f"w{k}" for k in range(100)]
    near = [*base[:50], "x", *base[51:]]
    rows = [(4, " ".join(base)), (9, " ".join(near)), (2, "quite other words are in this text"), (9, "and this one stands alone here too"), (5, " ".join(base).upper()), (8, None), (3, ""), (None, " ".join(near))]
    got = {(r.doc_id, r.n_chars): (r.class_id, r.component_id) for r in minhash.op5(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = {i: (len(t or ""), k) for k, (i, t) in enumerate(rows)}
    assert got[4, of[4][0]] == got[5, of[4][0]] == (4, 4) and got[9, len(rows[1][1])] == got[None, len(rows[1][1])] == (9, 4)
    assert got[2, of[2][0]] == (2, 2) and got[9, len(rows[3][1])] == (9, 9) and got[8, 0] == got[3, 0] == (3, 3)
