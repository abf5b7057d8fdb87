"""SimHash fingerprints and exact linking of near ones by multi-index hashing.

A fingerprint has 64 bits, cut into three segments.  Two fingerprints that
differ in at most ``RADIUS`` = 4 bits agree, but for one bit at most, in one
segment.  So every fingerprint is entered in a table under each segment's
value, and asks the table for its segments' Hamming balls of radius one.  Of
two values one bit apart exactly one has that bit clear, so only clear bits
are flipped: each pair meets once, and the balls are half as large.  What
meets is compared over all 64 bits.

Only distinct fingerprints are entered, so exact copies cost nothing.  A dense
group of near copies would still meet in one bucket: a bucket emits links that
span it, never all its pairs, and one with many members is cut into cells of
about ``2 * BLOCK`` rows, any two blocks sharing a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bytewords import NOT_SPACE, row_slices, text_buffer, words_of
from .components import connected_components
from .shared import materialise, one_of_each

SHINGLE = 4
SEED = 42
RADIUS = 4
#: (lowest bit, bits) of each segment
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BLOCK = 4096
#: Groups of up to this many rows are compared pair by pair, all groups of a batch at once.
SMALL = 96


def fingerprint_bits(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A fingerprint per row: the majority of each bit over all its shingles' XXH64."""
    words = words_of(data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    out = np.zeros(n, dtype=np.uint64)
    if not len(words.starts):
        return out
    # one space between the words of a row, so that each shingle is one slice
    inside = NOT_SPACE[words.data]
    keep = inside.copy()
    keep[:-1] |= inside[1:]
    flat = np.where(inside, words.data, np.uint8(0x20))[keep].tobytes()
    place = np.cumsum(keep) - 1
    starts, ends = place[words.starts], place[words.ends - 1] + 1
    per_row = np.diff(words.rows)
    count = np.where(per_row >= size, per_row - size + 1, np.minimum(per_row, 1))
    firsts = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(n), count)
    head = words.rows[:-1][row] + np.arange(firsts[-1]) - firsts[:-1][row]
    tail = head + np.minimum(size, per_row)[row] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[s:e], SEED) for s, e in zip(starts[head].tolist(), ends[tail].tolist())), np.uint64, len(head))
    full = np.flatnonzero(count)
    for low in range(0, len(full), 512):
        some = full[low : low + 512]
        own = hashes[firsts[some[0]] : firsts[some[-1] + 1]]
        at = firsts[some] - firsts[some[0]]
        # bits little-endian within and across bytes: column k is bit k
        votes = _votes(own, at)
        out[some] = (votes * 2 > count[some][:, None]) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    return out


def _votes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many hashes of each run (runs begin at ``at``) have each bit set."""
    bounds = np.append(at, len(hashes))
    votes = np.zeros((len(at), 64), dtype=np.int64)
    for k in range(len(at)):  # a run at a time keeps the unpacked bits small
        for low in range(bounds[k], bounds[k + 1], 65536):
            run = hashes[low : min(low + 65536, bounds[k + 1])]
            votes[k] += np.unpackbits(run.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return votes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (a signed long of the 64 bits) for every row. Null text has no words, so zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            fps = [fingerprint_bits(data, offsets[a : b + 1]) for a, b in row_slices(offsets)]
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _segment(k: int):
    low, bits = SEGMENTS[k]
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(k << 40))


def _probes(seg, bits: int):
    """Probes at the values with one of the segment's clear bits set."""
    clear = F.filter(F.array(*[F.lit(1 << b) for b in range(bits)]), lambda m: seg.bitwiseAND(m) == 0)
    return F.transform(clear, lambda m: F.struct(seg.bitwiseOR(m).alias("key"), F.lit(1).cast("byte").alias("role")))


def _entries():
    """Table entries (role 0) and ball probes (role 1) of a fingerprint."""
    own = [F.struct(_segment(k).alias("key"), F.lit(0).cast("byte").alias("role")) for k in range(len(SEGMENTS))]
    return F.concat(F.array(*own), *[_probes(_segment(k), bits) for k, (_, bits) in enumerate(SEGMENTS)])


def _crowded(reps: DataFrame, block: int) -> DataFrame:
    """Keys that may hold more than ``block`` entries or probes, with how many blocks each needs."""
    own = reps.select(F.explode(F.array(*[_segment(k) for k in range(len(SEGMENTS))])).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    large = own.where(F.col("n") * max(b for _, b in SEGMENTS) > block)
    probed = [
        large.where(F.shiftrightunsigned("key", 40) == k).select(
            F.explode(F.filter(F.array(*[F.struct(F.col("key").bitwiseOR(F.lit(1 << b)).alias("key"), F.col("key").bitwiseAND(F.lit(1 << b)).alias("had")) for b in range(bits)]), lambda x: x["had"] == 0)).alias("x"),
            "n",
        ).select("x.key", F.lit(0).cast("long").alias("own"), F.col("n").alias("probes"))
        for k, (_, bits) in enumerate(SEGMENTS)
    ]
    rows = large.select("key", F.col("n").alias("own"), F.lit(0).cast("long").alias("probes"))
    for x in probed:
        rows = rows.unionAll(x)
    # keys near `large` ones can have up to block / bits entries and as many unseen probes; the blocks' slack covers those
    out = rows.groupBy("key").agg(F.sum("own").alias("own"), F.sum("probes").alias("probes"))
    return out.where((F.col("own") > block) | (F.col("probes") > block)).select(
        "key", F.ceil(F.col("own") / block).cast("int").alias("nb_own"), F.ceil(F.col("probes") / block).cast("int").alias("nb_probes")
    )


def links(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between ids of distinct fingerprints that span every bucket.

    ``reps`` has one ``rep, fp`` row per distinct fingerprint.  Two fingerprints
    at most ``RADIUS`` apart are connected by the links, directly or through
    others; every link is itself between such a pair.
    """
    rows = reps.where("rep is not null").select("rep", "fp", F.explode(_entries()).alias("x")).select("x.key", "x.role", "fp", "rep")
    crowded = materialise(_crowded(reps, block), "crowded")
    if (n := crowded.count()) == 0:
        rows = rows.withColumn("cell", F.lit(0))
    else:
        own, probes = F.greatest(F.coalesce("nb_own", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("nb_probes", F.lit(1)), F.lit(1))
        b = F.when(F.col("role") == 0, F.pmod(F.xxhash64("fp"), own)).otherwise(F.pmod(F.xxhash64("fp"), probes)).cast("int")
        # an entry meets the entries of every block (cells i <= j) and the probes of every block (cells after those)
        cells = F.when(
            F.col("role") == 0,
            F.concat(
                F.transform(F.sequence(F.lit(0), own - 1), lambda j: F.least(b, j) * own + F.greatest(b, j)),
                F.transform(F.sequence(F.lit(0), probes - 1), lambda j: own * own + b * probes + j),
            ),
        ).otherwise(F.transform(F.sequence(F.lit(0), own - 1), lambda i: own * own + i * probes + b))
        few = F.broadcast(crowded) if n <= 10_000 else crowded
        rows = rows.join(few, "key", "left").withColumn("cells", F.when(F.col("nb_own").isNull(), F.array(F.lit(0))).otherwise(cells)).select("key", "role", "fp", "rep", F.explode("cells").alias("cell"))
    dealt = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "role").select("key", "cell", "role", "fp", "rep")
    return dealt.mapInArrow(_link_batches, "a long, b long").distinct()


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        key, cell = cols[0], cols[1]
        if not len(key):
            continue
        last = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if (key[0] != key[-1] or cell[0] != cell[-1]) else 0
        kept = [x[last:] for x in cols]
        if last and (out := _spanning(*[x[:last] for x in cols])) is not None:
            yield out
    if kept is not None and len(kept[0]) and (out := _spanning(*kept)) is not None:
        yield out


def _spanning(key, cell, role, fp, rep) -> pa.RecordBatch | None:
    """Links that span the groups (key, cell) of sorted rows: no more than rows, each verified."""
    fp = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.uint64)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    entries = np.add.reduceat((role == 0).astype(np.int64), first)
    ok = (entries > 0) & (size > 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.flatnonzero(ok & (size <= SMALL))
    if len(small):
        # entries come first in a group: each is paired with all rows after it
        n = entries[small]
        group = np.repeat(small, n)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        left = first[group] + nth
        many = size[group] - nth - 1
        a = np.repeat(left, many)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
        found.append((a[near], b[near]))
    for g in np.flatnonzero(ok & (size > SMALL)):
        found.append(_reach(fp[first[g] : first[g] + size[g]], int(entries[g]), int(first[g])))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    if not len(a):
        return None
    # drop links between what is connected already
    a, b = rep[a].tolist(), rep[b].tolist()
    root: dict[int, int] = {}
    out = []
    for x, y in zip(a, b):
        p, q = x, y
        while (r := root.get(p, p)) != p:
            root[p] = root.get(r, r)
            p = r
        while (r := root.get(q, q)) != q:
            root[q] = root.get(r, r)
            q = r
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((min(x, y), max(x, y)))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _reach(fp: np.ndarray, entries: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one group, by breadth-first search; probes are not compared with probes."""
    n = len(fp)
    free = np.ones(n, dtype=bool)
    a, b = [], []
    for seed in range(entries):
        if not free[seed]:
            continue
        free[seed] = False
        front = np.array([seed])
        while len(front):
            nxt = []
            for low in range(0, len(front), 256):
                part = front[low : low + 256]
                for some, limit in ((part[part < entries], n), (part[part >= entries], entries)):
                    rest = np.flatnonzero(free[:limit])
                    if not len(some) or not len(rest):
                        continue
                    near = np.bitwise_count(fp[some][:, None] ^ fp[rest][None, :]) <= RADIUS
                    hit = near.any(axis=0)
                    if hit.any():
                        got = rest[hit]
                        free[got] = False
                        a.append(some[near[:, hit].argmax(axis=0)] + base)
                        b.append(got + base)
                        nxt.append(got)
            front = np.concatenate(nxt) if nxt else np.zeros(0, np.int64)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``id, fp, component`` for every row: the least id that links reach.

    Texts without words have fingerprint zero and link like any other.  Rows
    with a null id link nothing; they take the component of their
    fingerprint's other rows, or null.  Repeated rows stay repeated.  An id is
    one document: where it has several texts, what is linked to any of them is
    in one component.  An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = materialise(prints.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    joined = materialise(links(reps, block), "links")
    comps = connected_components(joined, "a", "b")
    named = reps.join(comps, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component"))
    return prints.join(named, F.col("fp") == F.col("of"), "left").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near duplicates the row with the least id, with all its columns, whatever these are named.

    Rows that share that id are one document: one of them stays, the same on
    every run.  Rows without an id stay, for no link names them.
    """
    groups = near_duplicates(docs, id_col, text_col)
    return one_of_each(docs, materialise(groups.where("id = component").select(F.col("id").alias("kept_id")).distinct(), "kept"), id_col)


def op1(spark, docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


__all__ = ["fingerprints", "links", "keep_one", "near_duplicates", "op1"]
