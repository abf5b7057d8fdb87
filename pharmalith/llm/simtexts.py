"""Near-duplicate texts by SimHash: multi-index hashing of wide fingerprints, then exact Jaccard likeness.

Features are a text's distinct five-word shingles.  Each gives every bit a vote
of -255 to 255, a byte of a hash, and a bit is set if its votes' sum is over
zero; votes of one and minus one would tie too often in texts of few shingles.
Texts of likeness 0.8 differ in 15 to 16 % of bits: 10 of 64, which is too many
for a ball around a short fingerprint, and random texts are too near at that.

So a fingerprint is as many bits as ``SEGMENTS`` segments need (21 of 16 bits;
more and wider ones for over four million texts, see ``shape``).  It is entered
in each segment's table under the segment's value, and under the values with
one or both of the two bits flipped whose votes were closest.  Those are the
bits that near texts differ in: two texts of likeness 0.8 meet in a segment of
16 bits with probability 0.37 (without flips: 0.07), and in none of all
segments with probability 0.0001 at most, by simulation for 5 to 90 shingles.
What meets is compared over the first ``COMPARED`` = 256 bits; at most
``RADIUS`` = 64 may differ, four standard deviations over the mean at likeness
0.8, and eight below that of texts with nothing in common.

A bucket gives links that span what is near in it, never all its pairs, and one
of many entries is cut into cells of about ``2 * BLOCK``, any two blocks sharing
a cell.  Links make groups, which module ``neardups`` verifies by exact
likeness.  Texts of equal shingle sets are entered once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import neardups
from .shared import materialise

COMPARED = 256
RADIUS = 64
#: Most probable loss of a pair of likeness 0.8 by the segments.
LOSS = 1e-4
FLIPS = 2
BLOCK = 4096
#: Groups of up to this many rows are compared pair by pair, all groups of a batch at once.
SMALL = 96
#: Links that a task thins out before components are found.
TASK_LINKS = 1 << 18
_SETS, _SHINGLES = 1024, 2048  # worked on at a time
_rng = np.random.default_rng(20250301)
_A = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS = tuple(f"f{k}" for k in range(COMPARED // 64))


def shape(n: int) -> tuple[int, int]:
    """Segments, and bits of each, for ``n`` texts: about 64 to 128 texts share a value, and no more pairs are lost than ``LOSS``."""
    bits = min(28, max(16, math.ceil(math.log2(max(n, 2))) - 6))
    met = 0.355 * 0.87 ** (bits - 16)  # simulated: 0.37 of 16 bits, 0.22 of 20, 0.12 of 24, 0.07 of 28
    return math.ceil(math.log(LOSS) / math.log1p(-met)), bits


def votes(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row per set of shingle hashes, none of them empty: the sum of its shingles' votes for each bit."""
    words = -(-bits // 8)
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    flat = np.concatenate(sets)
    out = np.zeros((len(sets), words * 8), dtype=np.int64)
    for low in range(0, len(flat), _SHINGLES):
        part = flat[low : low + _SHINGLES]
        with np.errstate(over="ignore"):
            x = part[:, None] * _A[:words] + _B[:words]
            x ^= x >> np.uint64(32)
            x *= _MIX
            x ^= x >> np.uint64(29)
        ballots = x.astype("<u8", copy=False).view(np.uint8)
        for k in range(int(np.searchsorted(ends, low, side="right")), len(sets)):
            first = ends[k] - size[k] - low
            if first >= len(part):
                break
            out[k] += ballots[max(first, 0) : ends[k] - low].sum(axis=0, dtype=np.uint32)
    return (2 * out - 255 * size[:, None])[:, :bits]


def keys(sets: list[np.ndarray], segments: int, bits: int) -> np.ndarray:
    """A row per set: the compared bits as 64-bit words, and the values that it is entered under."""
    return np.concatenate([_keys(sets[k : k + _SETS], segments, bits) for k in range(0, len(sets), _SETS)])


def _keys(sets: list[np.ndarray], segments: int, bits: int) -> np.ndarray:
    sums = votes(sets, segments * bits)
    lead = np.packbits(sums[:, :COMPARED] > 0, axis=1, bitorder="little").view("<u8")
    parts = sums.reshape(len(sets), segments, bits)
    own = (parts > 0) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64)) | np.arange(segments, dtype=np.uint64) << np.uint64(32)
    unsure = np.uint64(1) << np.argsort(np.abs(parts), axis=2, kind="stable")[:, :, :FLIPS].astype(np.uint64)
    values = own[:, :, None]
    for k in range(FLIPS):
        values = np.concatenate([values, values ^ unsure[:, :, k : k + 1]], axis=2)
    return np.concatenate([lead, values.reshape(len(sets), -1)], axis=1)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, node`` and the compared words for each table entry of ``node, keys``."""
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            rows = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(part.num_rows, -1)
            many = rows.shape[1] - len(_WORDS)
            node = part.column(0).to_numpy()
            columns = [rows[:, len(_WORDS) :].ravel(), np.repeat(node, many), *(np.repeat(rows[:, k], many) for k in range(len(_WORDS)))]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["key", "node", *_WORDS])


def met(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between classes whose fingerprints meet and are near, which span what is near in each bucket."""
    schema = ", ".join(f"{c} long" for c in ("key", "node", *_WORDS))
    full = keyed.where("size > 0").select("node", "keys")
    # which buckets are crowded is told from the entries of a part of all classes; it decides the cells, not what is compared
    one_in = min(16, max(1, block // 64))
    some = full.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).dropDuplicates(["node"])
    counted = some.mapInArrow(_entries, schema).groupBy("key").agg(F.ceil(F.count("*") * one_in / block).cast("int").alias("blocks"))
    crowded = materialise(counted.where("blocks > 1"), "crowded")
    rows = full.dropDuplicates(["node"]).mapInArrow(_entries, schema)
    if n := crowded.count():
        few = crowded.withColumnRenamed("key", "of")
        blocks = F.coalesce("blocks", F.lit(1))
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
        rows = rows.join(F.broadcast(few) if n <= 10_000 else few, F.col("key") == F.col("of"), "left").select("key", "blocks", F.explode(cells).alias("cell"), "node", *_WORDS)
        rows = rows.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", "cell")).alias("key"), "node", *_WORDS)
    links = materialise(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_near_in_buckets, "a long, b long").distinct(), "met")
    # a text of a large group has a link per bucket, most of which connect nothing more
    return links.coalesce(max(1, math.ceil(links.count() / TASK_LINKS))).mapInArrow(_forest, "a long, b long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links those that connect what earlier ones don't."""
    root: dict[int, int] = {}
    for batch in batches:
        keep = []
        for k, (p, q) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            while (r := root.get(p, p)) != p:
                root[p] = root.get(r, r)
                p = r
            while (r := root.get(q, q)) != q:
                root[q] = root.get(r, r)
                q = r
            if p != q:
                root[max(p, q)] = min(p, q)
                keep.append(k)
        if keep:
            yield batch.take(pa.array(keep))


def _near_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, last = [], None  # batches of the bucket that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if key[0] == key[-1] == last:
            kept.append(batch)
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if (out := _near(kept + [batch.slice(0, cut)])) is not None:
            yield out
        kept, last = [batch.slice(cut)], key[-1]
    if kept and (out := _near(kept)) is not None:
        yield out


def _near(batches: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    """Links that span what is near within each bucket of sorted rows."""
    key, node, *words = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(2 + len(_WORDS)))
    if len(key) < 2:
        return None
    prints = np.stack(words, axis=1).view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    # each row of a small group is paired with all rows after it
    group = np.repeat(small, size[small])
    nth = np.arange(len(group)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
    left, many = first[group] + nth, size[group] - nth - 1
    a = np.repeat(left, many)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
    near = _apart(prints[a], prints[b]) <= RADIUS
    found = [_thinned(a[near], b[near], len(key))] + [_reach(prints[first[g] : first[g] + size[g]]) + first[g] for g in np.flatnonzero(size > SMALL)]
    pairs = node[np.concatenate(found, axis=1)]
    if not pairs.shape[1]:
        return None
    pairs = np.unique(np.sort(pairs[:, pairs[0] != pairs[1]], axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _thinned(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of links ``a < b`` in ascending order of ``a`` those that connect what all do: each row's first one, and one for each two trees of these."""
    later, first = np.unique(b, return_index=True)
    root = np.arange(n)
    root[later] = a[first]
    while (root[root] != root).any():
        root = root[root]
    p, q = root[a], root[b]
    over = np.flatnonzero(p != q)
    _, between = np.unique(np.minimum(p, q)[over] * n + np.maximum(p, q)[over], return_index=True)
    keep = np.concatenate([first, over[between]])
    return np.stack([a[keep], b[keep]])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _reach(prints: np.ndarray) -> np.ndarray:
    """Spanning links of one group, by breadth-first search."""
    rest = np.arange(len(prints))
    out = [np.zeros((2, 0), np.int64)]
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = []
            step = max(1, (1 << 19) // len(rest))
            for low in range(0, len(front), step):
                some = front[low : low + step]
                near = _apart(prints[some][:, None], prints[rest][None]) <= RADIUS
                hit = near.any(axis=0)
                if hit.any():
                    out.append(np.stack([some[near[:, hit].argmax(axis=0)], rest[hit]]))
                    found.append(rest[hit])
                    rest = rest[~hit]
            front = np.concatenate(found) if found else rest[:0]
    return np.concatenate(out, axis=1)


def method(n: int, block: int = BLOCK) -> neardups.Method:
    """How ``neardups`` finds what to verify among ``n`` texts by SimHash."""
    segments, bits = shape(n)
    return neardups.Method(partial(keys, segments=segments, bits=bits), partial(met, block=block), len(_WORDS))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, **sizes) -> DataFrame:
    """``id, h, class_id, component_id`` as of ``neardups.near_duplicates``, with what meets found by SimHash."""
    return neardups.near_duplicates(docs, id_col, text_col, method=method(docs.count(), block), **sizes)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near duplicates the row with the least id, as ``neardups.keep_one`` does, with what meets found by SimHash."""
    return neardups.keep_one(docs, id_col, text_col, method=method(docs.count()))


__all__ = ["keep_one", "keys", "met", "method", "near_duplicates", "shape", "votes"]
