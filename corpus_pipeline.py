"""A training-data pipeline over ``documents``: each stage keeps or repeats whole rows, the last writes tokens.

Stages, each a function (spark, docs, sf_dir): toxic documents go; of each
group of near duplicates the one with the least id stays; documents with
benchmark passages go; sources are mixed to target weights, so a row leaves,
stays or comes twice; and the texts are written as token ids and read back.

Near duplicates are texts of likeness 0.8 or more over five-word shingles.  The
second stage finds them by SimHash: multi-index hashing of wide fingerprints,
with the least sure bits flipped, and exact likeness of what meets.

Every stage handles null, empty and very long texts, null and repeated ids,
repeated rows, clashing column names and an empty table, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pharmalith.llm import decontaminate, mixing, simtexts, tokenbin, toxicity
from pharmalith.llm.shared import discard, materialise, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the severity from which one counts as toxic.

    The model is fitted on labelled rows of ``documents``.  Null and empty texts
    stay; repeated rows stay or go together.
    """
    ship_package(spark)
    labels, labelled = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(labelled, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard likeness of 0.8 or more: that with the least id.

    Null and empty texts are near duplicates of one another.  Rows without an
    id stay; of rows that share an id one stays, the same on every run.
    """
    ship_package(spark)
    return simtexts.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words inside a benchmark window. Null and empty texts stay; repeated rows stay or go together."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null texts have no words; a null source is the last one; rows of one id and size are mixed each for itself."""
    ship_package(spark)
    return mixing.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document taken, read back from the token files: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; rows without an id come first,
    and rows of one id in the order of their texts' hashes.
    """
    ship_package(spark)
    return tokenbin.op2(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_binary", write_tokens),
]

#: SQL can express neither the model, the tokenizer nor the rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are a written table that the next one reads, and that goes when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out


__all__ = ["ORACLE_SQL", "STAGES", "run"]
