"""Token ids in binary shards that open at any document.

A shard is a sequence of independent zstandard frames and, last, a seek table
in the public seekable format: a skippable frame with each frame's compressed
and decompressed size and the low 32 bits of the XXH64 of its contents, then a
footer.  The decompressed stream is the documents' ids one after another,
little-endian, two bytes wide where the vocabulary allows it and four else.
After them come index frames, with the ids and numbers of tokens of
``INDEX_ROWS`` documents each, and a directory: where each index frame's
documents begin.  A reader takes the footer, the table and the directory, and
decompresses the index frame and the frames that hold the documents it wants,
each checked against its checksum.

Documents are dealt to shards by ranges of their id, in ascending order within
and across shards; rows without an id come first, and rows of one id are in the
order of their texts' hashes, then texts, so that a hot id is cut and reruns
agree.  A shard is written to a
name of its own attempt and then renamed, so a lost executor leaves no half
shard behind.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytewords import row_slices, text_buffer
from .shared import fresh_path, open_fs, shuffles_dropped, write_whole

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
INDEX_MAGIC = b"PMTKIDX2"
#: Documents in an index frame.
INDEX_ROWS = 4096

FRAME_BYTES = 256 << 10
LEVEL = 1
#: Pieces whose ids a worker remembers before the older half goes.
REMEMBERED = 600_000
#: Longer pieces are not remembered.
PIECE_CHARS = 64
#: Text given to the tokenizer at once, in characters.
TOGETHER = 200_000
END_ID = 0

_SPACE, _LINE = 0x20, 0x0A
_LETTER = np.zeros(256, dtype=bool)  # ASCII letters and digits
_LETTER[0x30:0x3A] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, dtype=bool)  # ASCII punctuation but the apostrophe, which may begin a contraction
_MARK[0x21:0x30] = _MARK[0x3A:0x41] = _MARK[0x5B:0x61] = _MARK[0x7B:0x7F] = True
_MARK[0x27] = False


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Where white space other than space and line feed is: U+0009, 000B-000D, 0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    at = [np.flatnonzero((data == 0x09) | ((data >= 0x0B) & (data <= 0x0D)))]
    two = np.concatenate([data, np.zeros(2, np.uint8)])
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        k = np.flatnonzero(data == lead)
        x, y = two[k + 1], two[k + 2]
        if lead == 0xC2:
            hit = (x == 0x85) | (x == 0xA0)
        elif lead == 0xE1:
            hit = (x == 0x9A) & (y == 0x80)
        elif lead == 0xE2:
            hit = (x == 0x80) & ((y <= 0x8A) | (y == 0xA8) | (y == 0xA9) | (y == 0xAF)) | (x == 0x81) & (y == 0x9F)
        else:
            hit = (x == 0x80) & (y == 0x80)
        at.append(k[hit])
    return np.concatenate(at)


class Encoder:
    """A byte-level BPE tokenizer that encodes each distinct piece of text once.

    Byte-level pre-tokenization always begins a token at a single space between
    two characters that are not white space, at the first line feed after such
    a character, and where a punctuation mark follows a letter or digit.  So a
    text may be cut there, and each piece has the ids that it has in the whole
    text.  A text with any other use of spaces, with other white space than
    line feeds within it, or with the mark of a special token, is one piece.
    Pieces not met before are given to the tokenizer together, a tab before
    each: no such piece has a tab, and a tab between them is always a token of
    its own.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if special_as_text:
            self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.tab = self._ids("\t")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    _held: dict[tuple[str, bool], Encoder] = {}

    @classmethod
    def of_worker(cls, path: str, special_as_text: bool = False) -> Encoder:
        """The worker process's own encoder, so that tasks share what it remembers."""
        key = (path, special_as_text)
        if key not in cls._held:
            cls._held[key] = cls(path, special_as_text)
        return cls._held[key]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _learn(self, pieces: list[str], found: dict[str, bytes]) -> None:
        """Ids of pieces that may be encoded together."""
        low = 0
        while low < len(pieces):
            high, size = low, 0
            while high < len(pieces) and size < TOGETHER:
                size += len(pieces[high]) + 1
                high += 1
            some = pieces[low:high]
            ids = self._ids("\t" + "\t".join(some))
            at = np.flatnonzero(ids == self.tab[0]) if len(self.tab) == 1 else np.zeros(0, np.int64)
            if len(at) == len(some):
                raw, width = ids.tobytes(), self.dtype.itemsize
                bounds = (np.append(at, len(ids)) * width).tolist()
                found.update((p, raw[a + width : b]) for p, a, b in zip(some, bounds, bounds[1:]))
            else:
                found.update((p, self._ids(p).tobytes()) for p in some)
            low = high

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some rows one after another, and where each row's begin."""
        data, rows = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(rows) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        space, line = data == _SPACE, data == _LINE
        blank = space | line
        odd = blank[:-1] & blank[1:] & (space[:-1] | space[1:])
        full = rows[:-1] < rows[1:]
        firsts, lasts = rows[:-1][full], rows[1:][full] - 1
        odd[firsts[1:] - 1] = False  # the last byte of a row and the first of the next are no pair
        whole = np.zeros(n, dtype=bool)
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        whole[np.searchsorted(rows, np.concatenate([np.flatnonzero(odd), _odd_space(data), special]), side="right") - 1] = True
        whole[full] |= blank[firsts] | blank[lasts]
        starts = space
        starts[1:] |= line[1:] & ~blank[:-1]
        after = _LETTER[data]
        after[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # letters of Latin-1
        starts[1:] |= _MARK[data[1:]] & after[:-1]
        for k in np.flatnonzero(whole):
            starts[rows[k] : rows[k + 1]] = False
        starts[firsts] = True
        bounds = np.flatnonzero(starts)
        pieces = pa.StringArray.from_buffers(len(bounds), pa.py_buffer(np.append(bounds, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        index, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # a piece that is a whole irregular text is encoded by itself
        alone = np.zeros(len(names), dtype=bool)
        alone[index[np.searchsorted(bounds, rows[:-1][whole & full])]] = True
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        get, old, found = self.known.get, self.older.get, {}
        values = [get(p) for p in names]
        if self.older:
            found.update((p, v) for p, v in ((p, old(p)) for p, v in zip(names, values) if v is None) if v is not None)
            values = [found.get(p) if v is None else v for p, v in zip(names, values)]
        missing = [k for k, v in enumerate(values) if v is None]
        self._learn([names[k] for k in missing if not alone[k]], found)
        for k in missing:
            p = names[k]
            values[k] = self._ids(p).tobytes() if alone[k] else found[p]
        self.known.update((p, v) for p, v in found.items() if len(p) <= PIECE_CHARS)
        flat = np.frombuffer(b"".join(values), self.dtype)
        length = np.array([len(v) for v in values], dtype=np.int64) // self.dtype.itemsize
        begin = np.cumsum(length) - length
        count = length[index]
        ends = np.cumsum(count)
        out = flat[np.repeat(begin[index] - ends + count, count) + np.arange(ends[-1])]
        return out, np.concatenate([[0], ends])[np.searchsorted(bounds, rows)]


class ShardWriter:
    """Cuts a stream of documents' ids into frames and ends it with index and seek table."""

    def __init__(self, dtype: np.dtype, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.dtype, self.frame_bytes = np.dtype(dtype), frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level)
        self.open = bytearray()
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def _frame(self, data: bytes) -> bytes:
        packed = self.pack.compress(data)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return packed

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // self.dtype.itemsize)
        self.open += ids
        if len(self.open) >= self.frame_bytes:
            data, self.open = bytes(self.open), bytearray()
            for low in range(0, len(data), self.frame_bytes):  # a long document fills frames of its own
                yield self._frame(data[low : low + self.frame_bytes])

    def finish(self) -> Iterator[bytes]:
        if self.open:
            yield self._frame(bytes(self.open))
        known = np.array([x is not None for x in self.ids], dtype=np.uint8)
        ids = np.array([x or 0 for x in self.ids], dtype="<i8")
        lengths = np.array(self.lengths, dtype="<u8")
        firsts = np.arange(0, len(ids), INDEX_ROWS)
        for k in firsts.tolist():
            part = slice(k, k + INDEX_ROWS)
            yield self._frame(ids[part].tobytes() + known[part].tobytes() + lengths[part].tobytes())
        starts = (np.cumsum(lengths) - lengths)[firsts]
        yield self._frame(INDEX_MAGIC + struct.pack("<BQQQ", self.dtype.itemsize, len(ids), int(lengths.sum()), INDEX_ROWS) + ids[firsts].tobytes() + known[firsts].tobytes() + starts.astype("<u8").tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        yield struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class ShardReader:
    """Reads documents of one shard; decompresses only the frames that hold them."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        body = self.file.read_at(12 * frames, size - 9 - 12 * frames)
        self.table = np.frombuffer(body, dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.packed_at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.plain_at = np.concatenate([[0], np.cumsum(self.table[:-1, 1])])
        self.unpack = zstandard.ZstdDecompressor()
        self.held: OrderedDict[int, bytes] = OrderedDict()
        directory = self.frame(frames - 1)
        if directory[:8] != INDEX_MAGIC:
            raise ValueError(f"{uri} has no index")
        width, self.n_docs, self.n_ids, self.rows = struct.unpack("<BQQQ", directory[8:33])
        self.dtype = np.dtype(f"<u{width}")
        n = -(-self.n_docs // self.rows)
        self.first_ids = np.frombuffer(directory, "<i8", n, 33)
        self.first_known = np.frombuffer(directory, np.uint8, n, 33 + 8 * n).astype(bool)
        self.first_at = np.frombuffer(directory, "<u8", n, 33 + 9 * n).astype(np.int64)
        self.index_from = frames - 1 - n

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, whether they are known, and starts (one more) of the k-th index frame's documents."""
        raw = self.frame(self.index_from + k)
        n = len(raw) // 17
        lengths = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool), self.first_at[k] + np.concatenate([[0], np.cumsum(lengths)])

    def find(self, doc_id: int | None) -> list[int]:
        """The rows of a document's id, in the order of the shard."""
        low = np.searchsorted(np.where(self.first_known, self.first_ids, np.iinfo(np.int64).min), doc_id if doc_id is not None else np.iinfo(np.int64).min, side="left")
        out: list[int] = []
        for k in range(max(int(low) - 1, 0), len(self.first_ids)):
            if self.first_known[k] and (doc_id is None or self.first_ids[k] > doc_id):
                break
            ids, known, _ = self.part(k)
            out += (np.flatnonzero(known & (ids == doc_id) if doc_id is not None else ~known) + k * self.rows).tolist()
        return out

    def frame(self, k: int) -> bytes:
        if k not in self.held:
            packed = self.file.read_at(int(self.table[k, 0]), int(self.packed_at[k]))
            data = self.unpack.decompress(packed, max_output_size=int(self.table[k, 1]))
            if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} fails its checksum")
            self.held[k] = data
            if len(self.held) > 2:  # an index frame and one of ids
                self.held.popitem(last=False)
        self.held.move_to_end(k)
        return self.held[k]

    def ids(self, row: int) -> np.ndarray:
        """The ids of the row-th document, with the end id."""
        starts = self.part(row // self.rows)[2]
        return self.between(*starts[row % self.rows : row % self.rows + 2].tolist())

    def between(self, start: int, stop: int) -> np.ndarray:
        """The ids from one place of the shard to another."""
        first, last = start * self.dtype.itemsize, stop * self.dtype.itemsize
        if first == last:
            return np.zeros(0, self.dtype)
        k = int(np.searchsorted(self.plain_at, first, side="right")) - 1
        parts = []
        while first < last:
            data, low = self.frame(k), first - int(self.plain_at[k])
            parts.append(data[low : low + last - first])
            first += len(parts[-1])
            k += 1
        return np.frombuffer(parts[0] if len(parts) == 1 else b"".join(parts), self.dtype)


def write_tokens(docs: DataFrame, tokenizer_path: str, out_uri: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, special_as_text: bool = False, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode every text and write the shards; a row per shard of the files written.

    Columns: shard (ascending with document ids), uri, n_docs, n_tokens.  Null
    and empty texts get the end id alone.  Rows of one id are all written, in
    the order of their texts' hashes and texts; rows that are equal may change
    places, which changes nothing.  An empty table gives no shards.  The tokenizer file's place is a parameter and must be readable
    at that path on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(tokenizer_path, special_as_text)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        writer = ShardWriter(encoder.dtype, frame_bytes)
        shard = TaskContext.get().partitionId()

        def frames() -> Iterator[bytes]:
            for batch in batches:
                data, offsets = text_buffer(batch.column(1))
                for first, last in row_slices(offsets):
                    ids, at = encoder.encode(data, offsets[first : last + 1])
                    raw, at = ids.tobytes(), (at * encoder.dtype.itemsize).tolist()
                    for doc_id, a, b in zip(batch.column(0).slice(first, last - first).to_pylist(), at, at[1:]):
                        yield from writer.add(doc_id, raw[a:b] + end)
            if writer.ids:
                yield from writer.finish()

        chunks = frames()
        if (first := next(chunks, None)) is None:
            return

        def all_chunks() -> Iterator[bytes]:
            yield first
            yield from chunks

        uri = f"{out_uri}/shard-{shard:06d}.tok.zst"
        write_whole(uri, all_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([uri]), pa.array([len(writer.ids)], pa.int64()), pa.array([sum(writer.lengths)], pa.int64())], ["shard", "uri", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    return dealt.mapInArrow(run, "shard long, uri string, n_docs long, n_tokens long")


def read_tokens(spark: SparkSession, shards: Sequence[tuple[str, int]]) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens, ids_crc32 per document.

    ``shards`` has the uri of every shard and the ids that come before it: a
    list as long as the number of tasks that wrote them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(uri)
                for k in range(len(shard.first_ids)):
                    ids, known, starts = shard.part(k)
                    crc = [zlib.crc32(shard.between(a, b).astype("<u4").tobytes()) for a, b in zip(starts.tolist(), starts[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64(), mask=~known), pa.array(starts[:-1] + before, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, len(shards))
    paths = spark.createDataFrame(list(shards), "uri string, before long").repartition(n)
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_and_read_back(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write all of ``docs`` to shards in the shared folder, and return what reading them gives."""
    spark = docs.sparkSession
    out_uri = fresh_path(spark, "tokens")
    with shuffles_dropped(spark):
        written = write_tokens(docs, tokenizer_path, out_uri, **options).collect()  # a row per task
    before, shards = 0, []
    for row in sorted(written, key=lambda r: r.shard):
        shards.append((row.uri, before))
        before += row.n_tokens
    return read_tokens(spark, shards)


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files written."""
    import public_tokenizers

    return tokenize_and_read_back(docs, public_tokenizers.path("byte_bpe_50k.json"))
