"""Files in the shared folder, as Python workers read and write them; the folder itself is the library's."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import close, discard, fresh_path, shared_dir, ship_package, shuffles_dropped
from ..sources.shared import written as materialise

__all__ = ["close", "discard", "fresh_path", "materialise", "one_of_each", "open_fs", "shared_dir", "ship_package", "shuffles_dropped", "write_whole"]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, for use in Python workers."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def write_whole(uri: str, chunks) -> int:
    """Write byte chunks to ``uri`` through a name of this attempt's own.

    The rename at the end makes a lost or repeated task harmless: the file is
    absent or whole, and a repeated task's replaces the first one's.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    try:
        fs.move(own, path)
    except OSError:  # some file systems don't rename onto a file
        fs.delete_file(path)
        fs.move(own, path)
    return n


def one_of_each(docs: DataFrame, kept: DataFrame, id_col: str, h: Column | None = None) -> DataFrame:
    """The rows of ``docs`` with an id in ``kept`` (``kept_id``, and with ``h`` the text's hash ``kept_h``), one for each id; and all rows without an id.

    Of several rows with an id the one whose contents hash least stays.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    held = docs.withColumn("c_h", h) if h is not None else docs
    held = held.toDF(*names, *(["c_h"] if h is not None else []))
    at = held[names[docs.columns.index(id_col)]].cast("long")
    same = at == kept["kept_id"]
    found = held.where(at.isNotNull()).join(kept, same & (held["c_h"] == kept["kept_h"]) if h is not None else same, "left_semi").select(*names)
    times = held.groupBy(at.alias("kept_id")).count().where("count > 1 and kept_id is not null").select("kept_id")
    if times.limit(1).count():
        many = found.join(times, at == times["kept_id"], "left_semi").groupBy(at).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("x")).select("x.*")
        found = found.join(times, at == times["kept_id"], "left_anti").unionAll(many)
    return found.unionAll(held.where(at.isNull()).select(*names)).toDF(*docs.columns)
