"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: the request, the response (or a revisit, where an
earlier capture has the same payload), and metadata.  Request and metadata name
the response in ``WARC-Concurrent-To``.  Every record is a gzip member of its
own.  Assembly joins the records through those identifiers and emits one
nested row per capture.

Archives are named by the task and a number, are written to a name of the
attempt's own and renamed when whole; a task goes on to the next archive when
one has ``ARCHIVE_BYTES``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import fresh_path, open_fs, shuffles_dropped, write_whole

#: Payloads of fewer bytes are always written whole.
REVISIT_FROM = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of captures without one.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
#: Size from which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 20


def _record(kind: str, record_id: str, fields: Sequence[tuple[str, str]], content_type: str, block: bytes, date: str | None = None) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date or DATE), *fields, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head)  # a line break would end the field
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def capture_urn(page_id: int | None, digest: str) -> str:
    """The identifier of a capture's response: its page and payload name it."""
    return f"urn:x-capture:{'none' if page_id is None else page_id}:{digest[:16]}"


def _capture(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str | None, first: int | None) -> Iterator[bytes]:
    """The three records of a capture; ``first`` is the page whose response a revisit refers to."""
    target, urn = url or "", capture_urn(page_id, digest)
    host = target.split("://", 1)[-1].split("/", 1)[0]
    uri = [("WARC-Target-URI", target)] if target else []
    joined = ("WARC-Concurrent-To", f"<{urn}>")
    yield _record("request", f"{urn}:request", [*uri, joined], "application/http; msgtype=request", f"GET {target or '/'} HTTP/1.1\r\nHost: {' '.join(host.split())}\r\n\r\n".encode(), date)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    summed = ("WARC-Payload-Digest", f"sha256:{digest}")
    if first is None:
        yield _record("response", urn, [*uri, summed], "application/http; msgtype=response", head + payload, date)
    else:
        yield _record("revisit", urn, [*uri, summed, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{capture_urn(first, digest)}>")], "application/http; msgtype=response", head, date)
    about = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(payload)}\r\n".encode()
    yield _record("metadata", f"{urn}:metadata", [*uri, joined], "application/warc-fields", about, date)


def write_archives(pages: DataFrame, out_uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Write every row of ``pages`` as a capture; the archives' uris, those of each task that had rows.

    Null html is an empty payload.  Of rows with equal payloads of at least
    ``REVISIT_FROM`` bytes those with the least id are responses, others
    revisits of it; rows without an id are responses where no row of that
    payload has one.  Repeated rows are written as often as they come.  A
    payload is held whole in memory, a row at a time.  ``date_col`` has
    timestamps, which are written in UTC; without it, or where it is null, the
    date is ``DATE``.  An empty table gives no archives.  Other columns are left
    out, whatever their names.
    """
    date = F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"), date.alias("date"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("large", F.octet_length("payload") >= REVISIT_FROM)
    # small payloads get keys of their own, so that they don't meet in one task
    own = F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))
    firsts = rows.where("large").groupBy("digest").agg(F.min("id").alias("first")).select(F.concat(F.lit("="), "digest").alias("of"), "first")
    keyed = rows.withColumn("key", F.when(F.col("large"), F.concat(F.lit("="), "digest")).otherwise(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def captures() -> Iterator[bytes]:
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    for row in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns)):
                        yield b"".join(_capture(*row))

        todo = captures()
        nth, ahead = 0, next(todo, None)
        while ahead is not None:
            name, n = f"captures-{TaskContext.get().partitionId():06d}-{nth:03d}.warc.gz", 0

            def archive() -> Iterator[bytes]:
                nonlocal ahead, n
                size = 0
                about = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
                yield _record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{out_uri}/{name}')}", [("WARC-Filename", name)], "application/warc-fields", about)
                while ahead is not None and size < archive_bytes:
                    yield ahead
                    n, size, ahead = n + 1, size + len(ahead), next(todo, None)

            write_whole(f"{out_uri}/{name}", archive())
            yield pa.RecordBatch.from_arrays([pa.array([f"{out_uri}/{name}"]), pa.array([n], pa.int64())], ["uri", "n"])
            nth += 1

    with shuffles_dropped(pages.sparkSession):
        # both sides are dealt by an expression for the join alone, which lets AQE split a hot payload
        joined = keyed.join(firsts, F.col("key") == F.col("of"), "left").select("id", "url", "payload", "digest", "date", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
        return sorted(r.uri for r in joined.mapInArrow(run, "uri string, n long").collect())  # a row per archive


def _members(uri: str) -> Iterator[bytes]:
    """The records of an archive, decompressed, one at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as file:
        unpack, parts, rest = zlib.decompressobj(31), [], b""
        while True:
            data = rest or file.read(READ_BYTES)
            if not data:
                if parts or unpack.unconsumed_tail:
                    raise ValueError(f"{uri} ends within a record")
                return
            parts.append(unpack.decompress(data))
            rest = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (keys in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record's block is shorter than its length")
    return fields, block


RECORDS = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, digest string, block string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, uris: Sequence[str], payloads: bool = True) -> DataFrame:
    """A row per record of the archives (schema ``RECORDS``), warcinfo records left out.

    A response's digest is computed from its payload and must equal the
    record's.  ``block`` has the block of request and metadata records, or the
    HTTP head of others; without ``payloads`` the payload column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (x.split() for x in RECORDS.split(", "))])
        bare = lambda v: v.strip("<>") if v else None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for data in _members(uri):
                    fields, block = parse_record(data)
                    kind, digest, size, payload = fields["warc-type"], fields.get("warc-payload-digest", "").partition(":")[2] or None, None, None
                    if kind == "warcinfo":
                        continue
                    if kind == "response":
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest and found != digest:
                            raise ValueError(f"{fields['warc-record-id']}: the payload fails its digest")
                        digest, block = found, head
                    rows.append((bare(fields["warc-record-id"]), kind, fields.get("warc-target-uri"), fields.get("warc-date"), bare(fields.get("warc-concurrent-to")), bare(fields.get("warc-refers-to")), digest, block.decode("utf-8", "replace"), size, payload if payloads else None))
                    held += len(data) if payloads else 200
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    paths = spark.createDataFrame([(u,) for u in uris], "uri string")
    return paths.repartition(max(1, len(uris))).mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record: ``capture_id, response, request, metadata``.

    Request and metadata records are joined by the response's identifier; a
    capture without one has null there, and of several the first by record id
    counts.  Requests and metadata that name no response are left out.
    Responses that share an identifier, as equal rows' do, stay as many rows.
    No records give no rows.  A payload is as long as its column's value may be.
    """
    def part(kind: str, *columns: str) -> DataFrame:
        own = F.struct("record_id", *columns)
        return records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias(f"{kind}_of")).agg(F.min(own).alias(kind))

    response = F.struct("record_id", "type", "target_uri", "date", "refers_to", "digest", F.col("block").alias("http_head"), "payload_bytes", "payload")
    # sizes of rows out of Python are guessed from the list of paths; without the hints a large side would be broadcast
    captures = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), response.alias("response"))
    with_request = captures.join(part("request", "target_uri", "date", "block").hint("merge"), F.col("capture_id") == F.col("request_of"), "left")
    return with_request.join(part("metadata", "block").hint("merge"), F.col("capture_id") == F.col("metadata_of"), "left").select("capture_id", "response", "request", "metadata")


def metadata_field(name: str):
    """A field of the assembled metadata record's block; null where it is empty or missing."""
    return F.nullif(F.regexp_extract(F.col("metadata.block"), rf"(?m)^{name}: ?(.*?)\r?$", 1), F.lit(""))


def op9(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from the archives written."""
    uris = write_archives(pages, fresh_path(spark, "warc"))
    captures = assemble(read_archives(spark, uris, payloads=False))
    return captures.select(
        metadata_field("page-id").cast("long").alias("page_id"), F.coalesce("response.payload_bytes", metadata_field("payload-bytes").cast("long")).alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.nullif(F.regexp_extract(F.col("response.refers_to"), r"^urn:x-capture:(-?\d+):", 1), F.lit("")).cast("long").alias("refers_to"),
    )
