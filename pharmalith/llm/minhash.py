"""MinHash fingerprints of word shingles, and near-duplicate texts by bands of them.

A shingle is ``SHINGLE`` consecutive words, hashed to 64 bits; a text of fewer
words, but not none, is one shingle.  Each of ``PERMUTATIONS`` universal hash
functions (multiply, add, keep the high half, all modulo 2**64) keeps its least
value over a text's shingles.  A fingerprint has the low 16 bits of each, so
two texts' fingerprints agree in about the share of shingles they have in
common; unlike minima agree by chance once in 65,536.  A text without words
has the fingerprint of no shingles: all ones.

Near duplicates (module ``neardups``): band keys of such minima are joined in
Spark, and what meets is verified by exact Jaccard likeness.  The classes and
components found travel to the texts with the ring below, so that texts are
shuffled once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytewords import NOT_SPACE, row_slices, shingle_hashes, text_buffer, words_of
from .neardups import hashed_rows, near_duplicates

SHINGLE = 5
PERMUTATIONS = 256
#: Text of a shard, about, and the most shards.
SHARD_BYTES = 256 << 20
MOST_SHARDS = 4096
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signatures(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A row of ``PERMUTATIONS`` 16-bit minima for each text."""
    doc = words_of(data, offsets, NOT_SPACE)
    shingles, firsts = shingle_hashes(doc.hashes(), doc.rows, size)
    out = np.full((len(offsets) - 1, PERMUTATIONS), 0xFFFF, dtype=np.uint16)
    full = np.flatnonzero(np.diff(firsts))
    if len(full):
        at = firsts[full]
        with np.errstate(over="ignore"):
            for k in range(PERMUTATIONS):
                least = np.minimum.reduceat(shingles * _A[k] + _B[k], at)
                out[full, k] = (least >> np.uint64(32)).astype(np.uint32).astype(np.uint16)
    return out


def signatures_of(texts: list[str]) -> np.ndarray:
    """Signatures of texts, worked on in slices of bounded size."""
    data, offsets = text_buffer(pa.array(texts, pa.string() if sum(map(len, texts)) < 1 << 28 else pa.large_string()))
    parts = [signatures(data, offsets[a : b + 1]) for a, b in row_slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), np.uint16)


def hex_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _shards(rows: DataFrame, parts: int) -> list[tuple[int | None, int]]:
    """Where shards of about equal numbers of rows begin, as (id, h) in ring order, the first shard's start left out.

    Ids are cut at quantiles; an id with rows for several shards is cut by the
    texts' hashes.  The driver holds a few values per shard.
    """
    if parts < 2:
        return []
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("id", [k / parts for k in range(1, parts)], 20 * parts)).first()
    starts: set[tuple[int | None, int]] = {(x, _LEAST) for x in cuts or []}
    each = max(n / parts, 1)
    for x, many in rows.groupBy("id").count().where(F.col("count") > 2 * each).collect():  # at most half as many as shards
        own = math.ceil(many / each)
        starts |= {(x, _LEAST + (k << 64) // own) for k in range(own)}
    return sorted(starts, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))


_LEAST = -(1 << 63)


def in_ring(rows: DataFrame, parts: int, notes: DataFrame | None = None) -> DataFrame:
    """``shard, guest, id, h, is_text, text, ...``: all ``id, h, text`` rows by descending id in shards, each followed by the first row after it.

    Shards are ranges of the order (id descending, null last, then the text's
    hash), so a row's successor is the row after it in its shard, or the guest
    at its end, which is the first row of the next shard (of the first one, for
    the last).  Texts are shuffled once; guests add a row per shard.  ``notes``
    (a row for each id and h, and columns of its own) come before the texts
    that they are about.
    """
    names = [c for c in notes.columns if c not in ("id", "h")] if notes is not None else []
    starts = _shards(rows, parts)
    places = F.array(*[F.struct(F.lit(x).cast("long").alias("id"), F.lit(h).cast("long").alias("h")) for x, h in starts]) if starts else None

    def past(s):
        after = F.when(s["id"].isNull(), F.col("id").isNull() & (F.col("h") >= s["h"])).when(F.col("id").isNull(), F.lit(True))
        return after.otherwise((F.col("id") < s["id"]) | (F.col("id") == s["id"]) & (F.col("h") >= s["h"]))

    shard = (F.size(F.filter(places, past)) if starts else F.lit(0)).cast("int").alias("shard")
    placed = rows.select(shard, "id", "h", "text")
    order = F.struct(F.col("id").isNull().alias("a"), F.bitwise_not("id").alias("b"), F.col("h").alias("c"))
    heads = sorted((x.shard, x.first.a, x.first.b, x.first.c) for x in placed.groupBy("shard").agg(F.min(order).alias("first")).collect())  # a row per shard
    if heads:
        head, before = [(False, None, None)] * (len(starts) + 1), [0] * (len(starts) + 1)
        for k, (at, *first) in enumerate(heads):
            head[at], before[at] = tuple(first), heads[k - 1][0]
        firsts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c")) for a, b, c in head])
        own = F.struct(F.col("shard"), F.lit(0).alias("guest"))
        there = F.struct(F.element_at(F.array(*[F.lit(x) for x in before]), F.col("shard") + 1).alias("shard"), F.lit(1).alias("guest"))
        is_head = order == F.element_at(firsts, F.col("shard") + 1)
        placed = placed.select(F.explode(F.when(is_head, F.array(own, there)).otherwise(F.array(own))).alias("x"), "id", "h", "text").select("x.shard", "x.guest", "id", "h", "text")
    else:
        placed = placed.select("shard", F.lit(0).alias("guest"), "id", "h", "text")
    every = placed.select("shard", "guest", "id", "h", F.lit(1).alias("is_text"), "text", *[F.lit(None).cast(notes.schema[c].dataType).alias(c) for c in names])
    if notes is not None:
        every = every.unionAll(notes.select(shard, F.lit(0), "id", "h", F.lit(0), F.lit(None).cast("string"), *names))
    return every.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", "guest", F.desc_nulls_last("id"), "h", "is_text")


def edited(text: str, following: str) -> str:
    """The last third (floor) of the code points replaced by the first as many of what follows."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text (see ``edited``), compare with both neighbours, and name near duplicates.

    Columns as ``op5`` returns them.  Null texts are empty; rows of one id
    follow one another by their texts' hashes, rows without an id come last;
    an only row follows itself; an empty table gives no rows.
    """
    rows = hashed_rows(docs, id_col, text_col)
    notes = near_duplicates(docs, id_col, text_col)
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = min(MOST_SHARDS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARD_BYTES)))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, component_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, note = None, None, None  # waiting: (id, text, note, signature) of the row whose successor comes next
        for batch in batches:
            _, offsets = text_buffer(batch.column(5))
            for first, last in row_slices(offsets):
                part = batch.slice(first, last - first)
                shards, guests, ids, hashes, is_text, texts, classes, components = (c.to_pylist() for c in part.columns)
                own = signatures_of([x for x in texts if x is not None])
                pairs, nth = [], 0
                for k, at in enumerate(shards):
                    if not is_text[k]:
                        note = (ids[k], hashes[k], classes[k], components[k])
                        continue
                    if at != shard:
                        shard, waiting = at, None
                    if waiting is not None:
                        pairs.append((*waiting, texts[k], own[nth]))
                    waiting = (ids[k], texts[k], note[2:], own[nth]) if not guests[k] else None
                    nth += 1
                if not pairs:
                    continue
                new = [edited(p[1], p[4]) for p in pairs]
                sig = signatures_of(new)
                mine, theirs = np.stack([p[3] for p in pairs]), np.stack([p[5] for p in pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
                        pa.array([hex_of(x) for x in mine]), pa.array([hex_of(x) for x in sig]), pa.array((mine == sig).mean(axis=1)), pa.array((mine == theirs).mean(axis=1)),
                        pa.array([p[2][0] for p in pairs], pa.int64()), pa.array([p[2][1] for p in pairs], pa.int64()),
                    ],
                    [x.split()[0] for x in schema.split(", ")],
                )

    return in_ring(rows, parts, notes).mapInArrow(run, schema)


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness, and the class and component of near duplicates that it is in."""
    return fingerprint_with_edits(docs)
