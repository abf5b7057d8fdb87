import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pharmalith.llm import tokenbin
from pharmalith.llm.bytewords import row_slices, text_buffer
from pharmalith.llm.shared import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " a b", "a  b", "a b ", "a\n b", "a \nb", "\na b\n", "a\tb c", "a\xa0b c d", "a b c", "don't we'll ' s 's it's,'s", "x" * 5000 + " y", "a<|endoftext|> b", "日本 語　x y", "tab\t", "é è́ ok.é, à:b", "1 2 33,4.5 %%% ###",
    "\x1c a b", "a\x0bb c", "<|endoftext|>", "“q” — r’s", " ", "\n", "a\n\nb c\n\n\nd e", "a×b÷c.", "a,b;c!d?e(f)g[h]", "x y z", None, "naïve façade's", "A" * 70 + " b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(rows):
    encoder = tokenbin.Encoder(PATH)
    data, offsets = text_buffer(pa.array(rows, pa.string()))
    out = []
    for a, b in row_slices(offsets, 40):
        ids, at = encoder.encode(data, offsets[a : b + 1])
        out += [ids[x:y].tolist() for x, y in zip(at, at[1:])]
    return out


def test_pieces_encode_like_whole_texts(library):
    assert ids_of(ODD * 2) == [library.encode(x or "", add_special_tokens=False).ids for x in ODD * 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé ,.\n\t <|>%1\xa0 “’", max_size=25), min_size=1, max_size=4))
def test_any_text_encodes_like_the_library(library, rows):
    assert ids_of(rows) == [library.encode(x, add_special_tokens=False).ids for x in rows]


def brute(library, rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, table, library):
    rows = [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, tokenbin.op2(spark, table("documents")).collect())) == brute(library, rows)


def test_odd_rows(spark, library):
    rows = [(k * 3 % 31, x) for k, x in enumerate(ODD)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int").repartition(5)
    assert sorted(map(tuple, tokenbin.op2(spark, df).collect())) == brute(library, rows)
    assert tokenbin.op2(spark, df.limit(0)).collect() == []
    twice = tokenbin.op2(spark, spark.createDataFrame([(7, "a"), (7, "a"), (None, "b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.start, r.n_tokens) for r in twice) == [(0, 0, 3), (7, 3, 2), (7, 5, 2)]


def test_readers_take_one_document_and_notice_damage(spark, table, tmp_path):
    out = fresh_path(spark, "tokens")
    shard = tokenbin.write_tokens(table("documents"), PATH, out, frame_bytes=2000).orderBy("shard").first()
    reader = tokenbin.ShardReader(shard.uri)
    assert (reader.n_docs, reader.n_ids) == (shard.n_docs, shard.n_tokens) and len(reader.table) > 10
    opened = []
    whole = reader.unpack

    class Counting:
        def decompress(self, packed, **k):
            opened.append(len(packed))
            return whole.decompress(packed, **k)

    reader.unpack = Counting()
    row = reader.n_docs // 2
    assert len(opened) == 0 and len(reader.ids(row)) and len(opened) <= len(reader.ids(row)) * 2 // 2000 + 3
    raw = bytearray(open(shard.uri.removeprefix("file://"), "rb").read())
    at = int(reader.packed_at[2]) + int(reader.table[2, 0]) // 2
    raw[at] ^= 255
    (tmp_path / "bad").write_bytes(raw)
    bad = tokenbin.ShardReader(f"file://{tmp_path}/bad")
    with pytest.raises(Exception):
        bad.frame(2)
    assert bad.frame(1) == reader.frame(1)


def test_frames_are_public_zstandard(spark, table):
    import zstandard

    shard = tokenbin.write_tokens(table("documents"), PATH, fresh_path(spark, "tokens")).first()
    raw = open(shard.uri.removeprefix("file://"), "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert len(plain) >= shard.n_tokens * 2


def test_index_frames_and_finding(tmp_path, monkeypatch):
    """Documents by id through the directory; only one index frame is opened for a row."""
    monkeypatch.setattr(tokenbin, "INDEX_ROWS", 5)
    writer = tokenbin.ShardWriter(np.dtype("<u2"), 16)
    docs = [(None, [9]), (None, [8, 8]), *[(k // 2 * 3, list(range(k + 1))) for k in range(23)]]
    raw = b"".join(x for d, ids in docs for x in writer.add(d, np.array(ids, "<u2").tobytes())) + b"".join(writer.finish())
    (tmp_path / "s").write_bytes(raw)
    reader = tokenbin.ShardReader(f"file://{tmp_path}/s")
    assert [reader.ids(k).tolist() for k in range(len(docs))] == [ids for _, ids in docs] and reader.n_docs == len(docs)
    for doc_id in {d for d, _ in docs} | {1, -5, 999}:
        assert reader.find(doc_id) == [k for k, (d, _) in enumerate(docs) if d == doc_id]
    assert len(reader.first_ids) == 5


def test_rows_of_one_id_keep_their_places(spark):
    """Starts of rows that share an id, or have none, are the same however the rows are stored."""
    rows = [(k % 3 or None, f"text number {k} " + "and more " * (k % 5)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(str, tokenbin.op2(spark, x).collect())) for x in (df, df.repartition(7), df.orderBy("text"))]
    assert got[0] == got[1] == got[2]
