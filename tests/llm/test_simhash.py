import random
import re

import numpy as np
import pytest
import xxhash

from pharmalith.llm import simhash
from pharmalith.llm.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """``pairs``: (id, fingerprint); the least id that links of at most four bits reach."""
    up = {i: i for i, _ in pairs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(pairs):
        for j, b in pairs[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i, _ in pairs}


TEXTS = [
    None, "", "  \t\n", "one", "One", "one two three", "a b c d", "A  b\nc\td", "a b c d e f g h i j k l m n o p q r s t",
    "é ü ñ ß Ä a b c", "a b c d e f g h i j k l m n o p q r s u", "x" * 300_000 + " y z w", "a b c d", "w " * 50_000, "nb\xa0sp is a word here",
]


def test_matches_brute_force(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)]
    got = simhash.op1(spark, spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [(k, brute_fingerprint(t)) for k, t in enumerate(TEXTS)]
    want = brute_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{v:016x}", want[k]) for k, v in prints}


@pytest.mark.parametrize("block", [4096, 8])
def test_links_reach_what_brute_force_reaches(spark, block):
    """Chains and dense groups with flips in every segment; a small block forces the cells of crowded keys."""
    rng, fps = random.Random(7), []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(30):
            fps.append(base)
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                base ^= 1 << bit
    dense = rng.getrandbits(64)
    for _ in range(200):
        fp = dense
        for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
            fp ^= 1 << bit
        fps.append(fp)
    fps += [0, 0xF, 0x1F, (1 << 64) - 1, 0b10011 << 19, 1 << 63, 7 << 40]
    fps = list(dict.fromkeys(fps))
    signed = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(fps)]
    found = simhash.links(spark.createDataFrame(signed, "rep long, fp long"), block)
    comps = {r.node: r.component for r in connected_components(found, "a", "b").collect()}
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 4 for r in found.collect())
    assert {k: comps.get(k, k) for k in range(len(fps))} == brute_components(list(enumerate(fps)))


def test_each_kind_of_one_bit_neighbour_meets(spark):
    """Pairs that agree in no segment exactly: at least one flip in each."""
    pairs = []
    rng = random.Random(3)
    for k in range(60):
        fp = rng.getrandbits(64)
        low, mid, high = rng.randrange(21), 21 + rng.randrange(21), 42 + rng.randrange(22)
        extra = rng.choice([low, mid, high])
        other = fp ^ (1 << low) ^ (1 << mid) ^ (1 << high)
        other ^= 0 if k % 2 else 1 << ((extra + 1) % 64)
        pairs += [fp, other]
    signed = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(pairs)]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "rep long, fp long")).collect()}
    assert got == {(k, k + 1) for k in range(0, len(pairs), 2)}


def test_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.op1(spark, spark.createDataFrame([], schema)).collect() == []
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (None, "quite another text of words")]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.op1(spark, spark.createDataFrame(rows, schema)).collect() if r.component_id is not None)
    assert got == [(-1, 3), (3, 3), (5, 3), (5, 3)]


def test_bits_are_the_majority_of_the_shingles(spark):
    data = np.frombuffer(b"p q r s t", np.uint8)
    got = simhash.fingerprint_bits(data, np.array([0, len(data)]))
    assert int(got[0]) == brute_fingerprint("p q r s t")


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(k, 7) for k in range(8, 90)] + [(5, 5), (None, 3), (7, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in range(7, 90)}
