"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

The patterns are all windows of ``WINDOW`` consecutive words of each benchmark
item (an item of fewer words is one window).  Words are the alphabet.  For
each window length there is a shift table over hashed blocks of consecutive
words: the entry of a block says how far the search may move when the last
block under it is that one.  Where the entry is zero, the block's bucket lists
the windows that end with it; their first block, then all their words, are
compared, and the words' bytes confirm.  A table has ``SLOTS`` entries for each
block of its windows, so that most entries still move the search.

The search runs in many lanes over one buffer, each lane a stretch of window
starts of one document, all moving by their own shifts in vector steps.

Tables are built by tasks, one for each ``BLOCK_BYTES`` of benchmark text, and
written to the shared folder; a worker reads them once and keeps the last
``HELD_BYTES``.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytewords import ALNUM, Words, row_slices, text_buffer, words_of
from .shared import fresh_path, open_fs, write_whole

WINDOW = 10
#: Entries of a shift table for each distinct block of words in its windows.
SLOTS = 16
#: Window starts that a lane covers.
LANE = 256
#: Benchmark text in one block of patterns; a larger benchmark is searched block by block.
BLOCK_BYTES = 1 << 20
#: Documents' text that is searched for one block of patterns after another.
GROUP_BYTES = 16 << 20
#: Tables that a worker keeps in memory.
HELD_BYTES = 192 << 20

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _blocks(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the block of ``width`` words that begins at each word."""
    n = max(0, len(words) - width + 1)
    with np.errstate(over="ignore"):
        h = words[:n] * _C1
        if width == 2:
            h = h ^ ((words[1 : n + 1] + _C2) * _C2)
            h *= _C1
    return h


@dataclass
class Patterns:
    """The windows of one length: tables of the search and what each window belongs to."""

    length: int
    width: int
    bits: int
    shift: np.ndarray
    tails: np.ndarray
    first: np.ndarray
    words: np.ndarray
    text: list[bytes]
    items: list[tuple[int, ...]]

    @classmethod
    def build(cls, length: int, windows: dict[bytes, tuple[np.ndarray, set[int]]]) -> Patterns:
        width = min(2, length)
        text = list(windows)
        words = np.stack([windows[x][0] for x in text])
        hashed = np.stack([_blocks(words[:, k : k + width].ravel(), width)[::width] for k in range(length - width + 1)], axis=1)
        bits = max(12, math.ceil(math.log2(SLOTS * len(np.unique(hashed)))))
        blocks = (hashed >> np.uint64(64 - bits)).astype(np.int64)
        last = blocks.shape[1] - 1
        shift = np.full(1 << bits, last + 1, dtype=np.uint8 if last < 255 else np.int64)
        for k in range(last + 1):  # later blocks of a window allow less
            shift[blocks[:, k]] = last - k
        order = np.argsort(blocks[:, last], kind="stable")
        return cls(length, width, bits, shift, blocks[order, last], blocks[order, 0], words[order], [text[k] for k in order], [tuple(sorted(windows[text[k]][1])) for k in order])

    def search(self, doc: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and pattern numbers of all occurrences within rows."""
        last = np.diff(doc.rows) - self.length
        lanes = np.where(last >= 0, last // LANE + 1, 0)
        none = np.zeros(0, np.int64)
        if not lanes.sum():
            return none, none
        blocks = (_blocks(hashes, self.width) >> np.uint64(64 - self.bits)).astype(np.int64)
        row = np.repeat(np.arange(len(last)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = doc.rows[:-1][row] + nth * LANE
        stop = np.minimum(at + LANE - 1, doc.rows[:-1][row] + last[row])
        reach = self.length - self.width
        stops = []
        while len(at):
            step = self.shift[blocks[at + reach]].astype(np.int64)
            zero = step == 0
            stops.append(at[zero])
            at = at + np.maximum(step, 1)
            live = at <= stop
            at, stop = at[live], stop[live]
        found = np.concatenate(stops)
        low, high = (np.searchsorted(self.tails, blocks[found + reach], side=side) for side in ("left", "right"))
        many = high - low
        at = np.repeat(found, many)
        which = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(at))
        same = blocks[at] == self.first[which]
        at, which = at[same], which[same]
        for k in range(self.length):
            same = hashes[at + k] == self.words[which, k]
            at, which = at[same], which[same]
        data, starts, ends = doc.data.tobytes() if len(at) else b"", doc.starts, doc.ends
        sure = [b"\0".join(data[s:e] for s, e in zip(starts[a : a + self.length].tolist(), ends[a : a + self.length].tolist())) == self.text[p] for a, p in zip(at.tolist(), which.tolist())]
        sure = np.array(sure, dtype=bool)
        return at[sure], which[sure]


def build_patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[list[str], list[Patterns]]:
    """Item names and the search tables of a block of benchmark items."""
    names = sorted({x for x, _ in items})
    number = {x: k for k, x in enumerate(names)}
    data, offsets = text_buffer(pa.array([t for _, t in items], pa.string()))
    words = words_of(data, offsets, ALNUM)
    hashes, raw = words.hashes(), words.data.tobytes()
    groups: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    for k, (name, _) in enumerate(items):
        a, b = int(words.rows[k]), int(words.rows[k + 1])
        size = min(window, b - a)
        for s in range(a, b - size + 1) if size else ():
            text = b"\0".join(raw[words.starts[i] : words.ends[i]] for i in range(s, s + size))
            groups.setdefault(size, {}).setdefault(text, (hashes[s : s + size], set()))[1].add(number[name])
    return names, [Patterns.build(size, groups[size]) for size in sorted(groups)]


def write_pattern_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Write the tables of the benchmark, in blocks of bounded size, to the shared folder; their uris.

    Tasks build them; the driver gets a name for each.  An item repeated in two
    blocks counts once, by its name.
    """
    out_uri = fresh_path(benchmark.sparkSession, "patterns")
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str | None]] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            uri = f"{out_uri}/{uuid.uuid4().hex}.pkl"  # of an attempt that was lost nothing is read
            write_whole(uri, [pickle.dumps(build_patterns(held, window))])
            return pa.RecordBatch.from_arrays([pa.array([uri])], ["uri"])

        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((item, text))
                size += len(text or "")
                if size > block_bytes:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return sorted(r.uri for r in rows.repartition(max(1, math.ceil(size / block_bytes))).mapInArrow(run, "uri string").collect())


class _Search:
    """Searches rows for all blocks of patterns."""

    #: tables of this worker, the last used last
    held: OrderedDict[str, tuple[int, list[str], list[Patterns]]] = OrderedDict()

    def __init__(self, uris: list[str]):
        self.uris = uris

    def block(self, uri: str) -> tuple[int, list[str], list[Patterns]]:
        held = _Search.held
        if uri not in held:
            fs, path = open_fs(uri)
            with fs.open_input_stream(path) as file:
                data = file.read()
            held[uri] = (len(data), *pickle.loads(data))
            while len(held) > 1 and sum(x[0] for x in held.values()) > HELD_BYTES:
                held.popitem(last=False)
        held.move_to_end(uri)
        return held[uri]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Of each row: words, hit words, and the sorted names of items with occurring windows."""
        docs = [words_of(data, offsets[a : b + 1], ALNUM) for a, b in row_slices(offsets)]
        hashes = [doc.hashes() for doc in docs]
        cover = [np.zeros(len(h) + 1, dtype=np.int32) for h in hashes]
        items: list[list[set[str]]] = [[set() for _ in range(len(doc.rows) - 1)] for doc in docs]
        for uri in self.uris:
            _, names, groups = self.block(uri)
            for patterns in groups:
                for doc, h, hit, found in zip(docs, hashes, cover, items):
                    at, which = patterns.search(doc, h)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + patterns.length, -1)
                    rows = np.searchsorted(doc.rows, at, side="right") - 1
                    for r, p in set(zip(rows.tolist(), which.tolist())):
                        found[r].update(names[k] for k in patterns.items[p])
        sums = [np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)]) for hit in cover]
        words = [np.diff(doc.rows) for doc in docs]
        hits = [np.diff(total[doc.rows]) for total, doc in zip(sums, docs)]
        return np.concatenate(words), np.concatenate(hits), [sorted(x) for found in items for x in found]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id, n_words, n_hit, items`` (sorted names of items with occurring windows) per row of ``docs``.

    A word inside any occurrence is hit.  Null and empty texts have no words;
    an empty benchmark hits nothing; items without words are no windows; an
    item without a name is named ``null``.  Rows are judged one by one, so
    repeated rows and other columns change nothing.
    """
    uris = write_pattern_blocks(benchmark, window=window, block_bytes=block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(uris)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_slices(offsets, GROUP_BYTES):
                words, hit, items = search(data, offsets[first : last + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["id", "n_words", "n_hit", "items"]
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_words long, n_hit long, items array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns, whatever these are named.

    Rows are judged one by one: null and empty texts stay, repeated rows stay
    or go together, whole texts are searched however long they are, and an
    empty table of documents or items drops nothing.
    """
    uris, at = write_pattern_blocks(benchmark, window=window), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(uris)
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for first, last in row_slices(offsets, GROUP_BYTES):
                _, hit, _ = search(data, offsets[first : last + 1])
                yield batch.slice(first, last - first).filter(pa.array(hit == 0))

    return docs.mapInArrow(run, docs.schema)


def op6(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    out = find_benchmark(docs, benchmark)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
