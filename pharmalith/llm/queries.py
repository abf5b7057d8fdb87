"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, htmltext, licenses, minhash, mixing, secrets, simhash, tokenbin, toxicity, warc
from .shared import ship_package


def _over(op: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that applies an operator to whole tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return op(spark, *(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

    query.__doc__ = op.__doc__
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _over(simhash.op1, "documents"),
    "op2_token_binary": _over(tokenbin.op2, "documents"),
    "op3_secrets": _over(secrets.op3, "documents"),
    "op4_html_text": _over(htmltext.op4, "pages"),
    "op5_minhash": _over(minhash.op5, "documents"),
    "op6_decontaminate": _over(decontaminate.op6, "documents", "benchmark"),
    "op7_toxicity": _over(toxicity.op7, "documents", "labels"),
    "op8_mixing": _over(mixing.op8, "documents"),
    "op9_warc": _over(warc.op9, "pages"),
    "op10_licenses": _over(licenses.op10, "documents"),
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: DuckDB SQL of those that SQL can express fast enough on whole tables.
ORACLES: dict[str, str] = {
    "op6_decontaminate": f"""
        WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
        docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        spans AS (SELECT r, m, s, array_to_string(w[s : s + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM docs CROSS JOIN (SELECT DISTINCT m FROM windows))),
        hits AS (SELECT r, m, s, item_id FROM spans JOIN windows USING (m, win)),
        covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT r, m, s FROM hits)) GROUP BY r),
        found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id as varchar), ',' ORDER BY cast(item_id as varchar)) AS names FROM hits GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
}
