"""Near-duplicate texts: MinHash bands joined in Spark, then exact Jaccard likeness.

What meets may be found by another ``Method``; module ``simtexts`` has SimHash's.

A shingle is five words; a text of fewer, but not none, is one shingle.  Texts
of equal shingle sets are one class, named by the hash of its set.  ``BANDS``
band keys of ``ROWS`` least values each are joined in Spark: two classes of
likeness 0.8 share a key with probability 1 - (1 - 0.8**7)**40 = 0.9999, more
alike ones with more.  Each member of a key's bucket is joined to the bucket's
least, so a bucket gives no more rows than it has members; a worker first joins
what meets within its own rows, so a hot bucket sends on a row per batch.

Meeting gives groups.  Within a group every two texts share a cell, and the
cell links what is alike, by exact likeness, with no more links than texts.  A
group is cut into blocks of about ``BLOCK_TEXTS`` texts or ``BLOCK_SHINGLES``
shingles, whichever is less, and each text is copied once for every block of
its group.  A group of more than ``BANDS`` blocks, which texts may form that
are hardly alike, is cut by its bands instead: a text is then copied for each
bucket that it shares with others, and blocks are those of a bucket.

Only texts of classes that met are read again.  A bitmap of their hashes, of
bounded size, keeps most others from being shuffled; beyond about 100 million
classes that met it is full, and all texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from .bytewords import row_slices, shingle_sets, text_buffer
from .components import connected_components
from .shared import discard, materialise, one_of_each, open_fs

SHINGLE = 5
#: Likeness from which two texts are near duplicates.
LIKE = 0.8
BANDS = 40
ROWS = 7
#: Bits of the bitmap of texts that are read again: 16 for each, and at most this power of two (32 MB).
MOST_BITS = 28
BLOCK_TEXTS = 8192
BLOCK_SHINGLES = 500_000
_rng = np.random.default_rng(20250117)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` hashes for each set, none of them empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(sets), band + 1, dtype=np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = (key ^ (np.minimum.reduceat(flat * _A[k] + _B[k], at) >> np.uint64(32))) * _MIX
                key ^= key >> np.uint64(29)
            out[:, band] = key
    return out


def _longs(hashed: np.ndarray) -> pa.Array:
    return pa.array(hashed.astype(np.uint64).view(np.int64))


def _classes(rows: DataFrame, keys_of: Callable[[list[np.ndarray]], np.ndarray] = band_keys) -> DataFrame:
    """``id, h, node, size, keys`` of every row of ``id, h, text``: class, shingles, keys (none of an empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for first, last in row_slices(offsets):
                sets = shingle_sets(data, offsets[first : last + 1], SHINGLE)
                nodes = np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little") for x in sets], dtype=np.uint64)
                full = [x for x in sets if len(x)]
                keys = keys_of(full).astype("<u8") if full else np.zeros((0, 0), "<u8")
                packed, k = [], 0
                for x in sets:
                    packed.append(keys[k].tobytes() if len(x) else b"")
                    k += len(x) > 0
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _longs(nodes), pa.array([len(x) for x in sets], pa.int64()), pa.array(packed, pa.binary())], ["id", "h", "node", "size", "keys"])

    return rows.mapInArrow(run, "id long, h long, node long, size long, keys binary")


def _flat_keys(column: pa.Array, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a batch, without the first ``lead`` words of each row, and the row of each."""
    packed = [x[8 * lead :] for x in column.to_pylist()]
    return np.frombuffer(b"".join(packed), "<u8"), np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed])


def _met_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, node, least`` out of ``node, keys``: one member of each key, and links (``least`` not null) to it of the batch's others."""
    for batch in batches:
        key, row = _flat_keys(batch.column(1))
        node = batch.column(0).to_numpy()[row]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        if not len(key):
            continue
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (node[1:] == node[:-1])])
        key, node = key[~again], node[~again]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        least = node[first][np.cumsum(first) - 1]
        # a link needs no bucket: its node spreads it
        yield pa.RecordBatch.from_arrays([_longs(np.where(first, key, node.view(np.uint64))), pa.array(node), pa.array(least, mask=first)], ["key", "node", "least"])


def _met_in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` out of rows sorted by key and node: each member of a key with the key's least, and links as they came."""
    last_key = last_least = None
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        given = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        link = batch.column(2).fill_null(0).to_numpy()
        a, b = [node[given]], [link[given]]
        key, node = key[~given], node[~given]
        if len(key):
            first = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            starts = np.flatnonzero(first)
            run = np.cumsum(first)
            least = np.concatenate([[last_least if last_least is not None else 0], node[starts]])[run]
            a.append(node[node != least])
            b.append(least[node != least])
            last_key, last_least = key[-1], least[-1]
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _met_by_bands(keyed: DataFrame) -> DataFrame:
    """``a, b``: links that connect classes with a band key in common."""
    met = keyed.select("node", "keys").mapInArrow(_met_in_batch, "key long, node long, least long")
    return met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met_in_bucket, "a long, b long").distinct()


@dataclass(frozen=True)
class Method:
    """How classes that may be alike are found: 64-bit keys of shingle sets, and links between classes out of the written ``_classes``."""

    keys_of: Callable[[list[np.ndarray]], np.ndarray] = band_keys
    met: Callable[[DataFrame], DataFrame] = _met_by_bands
    #: words before the keys of a row that are not keys
    lead: int = 0


MINHASH = Method()


def spanning_links(sets: list[np.ndarray], threshold: float = LIKE) -> list[tuple[int, int]]:
    """Pairs of likeness ``threshold`` or more that connect all that such pairs connect: a breadth-first forest."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    if len(sets) < 2 or not size.sum():
        return []
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # what one set alone has is not shared
    lens = np.add.reduceat(np.append(shared, False).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]])) * (size > 0)
    ends = np.cumsum(lens)
    column = column[shared]
    own = [column[e - n : e] for e, n in zip(ends.tolist(), lens.tolist())]
    mark = np.zeros(len(count), dtype=bool)

    def like(one: int, many: np.ndarray, columns: np.ndarray, upto: np.ndarray) -> np.ndarray:
        mark[own[one]] = True
        seen = np.concatenate([[0], np.cumsum(mark[columns])])
        mark[own[one]] = False
        both = np.diff(seen[upto], prepend=0)
        return (both > 0) & (both + 1e-9 >= threshold * (size[one] + size[many] - both))

    out: list[tuple[int, int]] = []
    rest = np.flatnonzero(lens)
    columns = column

    def take(hit: np.ndarray) -> np.ndarray:
        """Take rows out of ``rest``."""
        nonlocal rest, columns
        got = rest[hit]
        columns, rest = columns[np.repeat(~hit, lens[rest])], rest[~hit]
        return got

    while len(rest) > 1:
        front = [int(take(np.arange(len(rest)) == 0)[0])]
        while front and len(rest):
            if len(front) * len(columns) <= len(rest) * int(lens[front].sum()):
                one = front.pop()
                hit = like(one, rest, columns, np.cumsum(lens[rest]))
                if hit.any():
                    got = take(hit).tolist()
                    out += [(one, x) for x in got]
                    front += got
            else:  # few are left: each looks for one of the front
                many = np.array(front)
                theirs, upto = np.concatenate([own[x] for x in front]), np.cumsum(lens[many])
                hit = np.zeros(len(rest), dtype=bool)
                for k, x in enumerate(rest.tolist()):
                    near = like(x, many, theirs, upto)
                    if near.any():
                        hit[k] = True
                        out.append((int(many[near.argmax()]), x))
                front = take(hit).tolist()
    return out


def _link(threshold: float):
    """Links within each cell of sorted rows ``cell, node, text``; a node that comes again is the same text."""

    def linked(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(nodes[a], nodes[b]) for a, b in spanning_links(sets, threshold)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, key = [], [], None
        for batch in batches:
            out = []
            data, offsets = text_buffer(batch.column(2))
            for first, last in row_slices(offsets):
                part = batch.slice(first, last - first)
                for cell, node, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(data, offsets[first : last + 1], SHINGLE)):
                    if cell != key:
                        out += linked(nodes, sets)
                        nodes, sets, key = [], [], cell
                    if not nodes or nodes[-1] != node:
                        nodes.append(node)
                        sets.append(own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if out := linked(nodes, sets):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _cells(members: DataFrame, by: list[str], block_texts: int, block_shingles: int, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``cell, node``: a row for every cell of each member of the groups named by ``by``.

    Groups of more than ``most`` blocks are left out and returned apart.
    """
    blocks = materialise(members.groupBy(*by).agg(F.ceil(F.greatest(F.count("*") / block_texts, F.sum("size") / block_shingles)).cast("long").alias("blocks"), F.count("*").alias("n")).where("n > 1"), "blocks")
    large = None
    if most is not None and blocks.where(F.col("blocks") > most).limit(1).count():
        large, blocks = blocks.where(F.col("blocks") > most), blocks.where(F.col("blocks") <= most)
    placed = members.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(F.col("block"), j) * F.col("blocks") + F.greatest(F.col("block"), j))
    return placed.select("node", *by, F.explode(every).alias("nth")).select(F.xxhash64(*by, "nth").alias("cell"), "node"), large


def hashed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, text`` of every row; ``h`` is the text's hash, and null texts are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _with_hash_in(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows (``id, h, text``) whose ``h`` may be one of the members'; no member is lost."""
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(16 * max(members.count(), 1)))))
    at = F.shiftrightunsigned("h", 64 - bits)
    table = members.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    uri = materialise(table, "bitmap")._written_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(uri)
        parts = pq.read_table(path, filesystem=fs)
        bitmap = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for part, own in zip(parts["part"].to_pylist(), parts["bits"].to_pylist()):
            bitmap[part * 4096 : (part + 1) * 4096] = np.frombuffer(own, np.uint8)
        for batch in batches:
            at = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            yield batch.filter(pa.array((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))

    return rows.mapInArrow(run, "id long, h long, text string")


def links(rows: DataFrame, keyed: DataFrame, classes: DataFrame, threshold: float = LIKE, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES, most_blocks: int = BANDS, method: Method = MINHASH) -> DataFrame:
    """``a, b``: verified links between classes, out of ``id, h, text`` rows, their ``_classes`` (a written table, which goes), and a row per class (``node, first, size``)."""
    groups = connected_components(method.met(keyed), "a", "b").select(F.col("node").alias("member"), F.col("component").alias("g"))
    members = materialise(classes.join(groups, F.col("node") == F.col("member")).select("node", "g", "size", "first.id", "first.h"), "members")
    cells, large = _cells(members, ["g"], block_texts, block_shingles, most_blocks)
    if large is not None:
        lead = method.lead
        of_large = keyed.join(members.select(F.col("node").alias("member"), F.col("g")).join(large.select("g"), "g", "left_semi"), F.col("node") == F.col("member")).select("node", "size", "keys")

        def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, row = _flat_keys(batch.column(2), lead)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), _longs(key)], ["node", "size", "key"])

        buckets = materialise(of_large.mapInArrow(exploded, "node long, size long, key long").distinct(), "buckets")
        cells = cells.unionAll(_cells(buckets, ["key"], block_texts, block_shingles)[0])
    discard(keyed)
    wanted = members.select(F.col("node").alias("of"), F.col("id").alias("first_id"), F.col("h").alias("first_h"))
    texts = _with_hash_in(rows, members).join(wanted, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))).select("of", "text")
    dealt = cells.join(texts, F.col("node") == F.col("of")).select("cell", "node", "text")
    return materialise(dealt.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_link(threshold), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = LIKE, method: Method = MINHASH, **sizes) -> DataFrame:
    """``id, h, class_id, component_id``, a row for each id and text (``h`` is the text's hash), a written table.

    ``class_id`` is the least id of the same shingles, ``component_id`` the
    least reached through texts of likeness ``threshold`` or more.  Texts
    without words are one class, like nothing else; null texts are empty.  Rows
    without an id link nothing themselves; they have their class's and
    component's least id, or null where no row of it has one.  Repeated rows
    are one; texts of one id are told apart; an empty table gives no rows.
    """
    rows = hashed_rows(docs, id_col, text_col)
    keyed = materialise(_classes(rows, method.keys_of), "keys")
    prints = materialise(keyed.drop("keys"), "classes")
    # a row of each class stands for it
    classes = materialise(prints.groupBy("node").agg(F.min("id").alias("class_id"), F.min(F.struct("id", "h")).alias("first"), F.min("size").alias("size")), "reps")
    found = links(rows, keyed, classes, threshold, method=method, **sizes)
    comps = connected_components(found, "a", "b").select(F.col("node").alias("linked"), "component")
    named = materialise(classes.join(comps, F.col("node") == F.col("linked"), "left").select(F.col("node").alias("of"), "class_id", F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy(F.col("component").alias("whole")).agg(F.min("class_id").alias("component_id"))
    ids = named.join(least, F.col("component") == F.col("whole")).select("of", "class_id", "component_id")
    out = materialise(prints.select("id", "h", "node").distinct().join(ids, F.col("node") == F.col("of")).select("id", "h", "class_id", "component_id"), "near")
    discard(prints)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: Method = MINHASH) -> DataFrame:
    """Of each component of near duplicates the row with the least id, with all its columns, whatever these are named.

    Rows that share that id are one document: one of them stays, the same on
    every run.  Rows without an id stay, for no link names them.  Null and
    empty texts are near duplicates of one another; an empty table stays empty.
    """
    groups = near_duplicates(docs, id_col, text_col, method=method)
    kept = materialise(groups.where("id = component_id").groupBy(F.col("component_id").alias("kept_id")).agg(F.min("h").alias("kept_h")), "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return one_of_each(docs, kept, id_col, F.xxhash64(text))


__all__ = ["MINHASH", "Method", "hashed_rows", "keep_one", "links", "near_duplicates", "spanning_links"]
