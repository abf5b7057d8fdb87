"""Toxicity as severity grades, by cumulative-link ordinal regression.

Model: P(grade <= k) = sigmoid(threshold_k - w.x), one weight vector for all
thresholds, thresholds in ascending order.  x has log2(1 + count) of the words
and beginnings of words (``PREFIXES`` bytes, which inflected and compound forms
share) that the training rows tell apart; the output is the expected grade.

The label table only says toxic or not, so severity is no human judgement.
Grade 0 is a row that is not toxic; a toxic row has grade 1, 2 or 3 by how many
distinct words it has that are markedly more frequent in the toxic rows of the
other half of the sample: under 2, under 5, or more.  So a row's grade doesn't
come from its own label's part in choosing features, but it does come from
words, and the order of grades says how much marked language a text has.

Only fitting uses a bounded sample (``TRAIN_ROWS`` labelled rows, chosen by a
hash of their ids).  Its features are counted and chosen in Spark; the driver
gets at most ``MOST_FEATURES`` of them, and of each row the counts of those.
Scoring reads every whole text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytewords import ALNUM, Words, row_slices, text_buffer, words_of
from .shared import materialise

#: The bound of the training sample, in labelled rows.
TRAIN_ROWS = 4000
#: The most features of a model, the most telling ones.
MOST_FEATURES = 20_000
GRADES = 4
PREFIXES = (4, 5)
#: Telling words of a toxic row from which its grade is 2, and 3.
GRADE_FROM = (2, 5)
#: Features that may be taken for telling by chance.
CHANCE = 10.0
#: Expected severity from which a document counts as toxic.
REJECT_FROM = 0.5
#: Variance of the weights' normal prior.
PRIOR_VARIANCE = 4.0
SEED = 42


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def severity(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected and most likely grade of each row."""
        doc = words_of(data, offsets, ALNUM)
        score = np.zeros(len(offsets) - 1)
        if len(self.words) and len(doc.starts):
            row, word, count = _counts(*_features(doc), self.words, self.maybe)
            score = np.bincount(row, self.weights[word] * np.log2(1 + count), len(score))
        up_to = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        exact = np.diff(np.concatenate([np.zeros((len(score), 1)), up_to, np.ones((len(score), 1))], axis=1), axis=1)
        return exact @ np.arange(exact.shape[1]), exact.argmax(axis=1)


def _features(doc: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word and of its beginnings (zero where it has none), and each row's first."""
    every = [doc.hashes(), *(doc.prefix_hashes(k) for k in PREFIXES)]
    return np.stack(every, axis=1).reshape(-1), doc.rows * len(every)


def _counts(hashes: np.ndarray, rows: np.ndarray, known: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the known word, and count, for every known word of each row."""
    at = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    word = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
    sure = known[word] == hashes[at]
    at, word = at[sure], word[sure]
    row = np.searchsorted(rows, at, side="right") - 1
    both, count = np.unique(row * len(known) + word, return_counts=True)
    return both // len(known), both % len(known), count


def _sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id, toxic, words, counts`` of at most ``rows`` labelled rows, a written table; equal rows are one."""
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("toxic"))
        .where("label_id is not null and toxic is not null").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("label_id", F.lit(SEED)), "label_id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for first, last in row_slices(offsets):
                doc = words_of(data, offsets[first : last + 1], ALNUM)
                h, at = _features(doc)
                hashed, counted, digest = [], [], []
                for a, b in zip(at[:-1], at[1:]):
                    word, count = np.unique(h[a:b][h[a:b] != 0], return_counts=True)
                    hashed.append(word.astype("<u8").tobytes())
                    counted.append(count.astype("<u4").tobytes())
                    digest.append(hashlib.blake2b(hashed[-1] + counted[-1], digest_size=16).hexdigest())
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest), pa.array(hashed, pa.binary()), pa.array(counted, pa.binary())], ["id", "toxic", "digest", "words", "counts"])

    # at most `rows` ids and labels: small enough to send to every task
    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    every = materialise(joined.select("id", "toxic", "text").mapInArrow(run, "id long, toxic int, digest string, words binary, counts binary"), "sample")
    # copies would make their own words look telling
    firsts = every.groupBy("digest", "toxic").agg(F.min("id").alias("least")).select(F.col("digest").alias("of"), F.col("toxic").alias("label"), "least")
    kept = every.join(F.broadcast(firsts), (F.col("digest") == F.col("of")) & (F.col("toxic") == F.col("label")) & (F.col("id") == F.col("least")), "left_semi")
    return kept.dropDuplicates(["digest", "toxic"]).select("id", "toxic", "words", "counts")


def _frequencies(sample: DataFrame) -> DataFrame:
    """``word, df, df_toxic``: how many rows, and toxic rows, have each feature; partial sums by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(x, "<u8") for x in batch.column(1).to_pylist()]
            if not words:
                continue
            toxic = np.repeat(np.array(batch.column(0).to_pylist()) > 0, [len(x) for x in words])
            known, at, df = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(df.astype(np.int64)), pa.array(np.bincount(at, toxic, len(known)).astype(np.int64))], ["word", "df", "df_toxic"])

    parts = sample.select("toxic", "words").mapInArrow(run, "word long, df long, df_toxic long")
    return parts.groupBy("word").agg(F.sum("df").alias("df"), F.sum("df_toxic").alias("df_toxic"))


def _ratio(n: int, n_toxic: int):
    """Likelihood ratio of a feature against chance, as an expression over df and df_toxic."""
    share = n_toxic / n
    df, seen = F.col("df").cast("double"), F.col("df_toxic").cast("double")

    def term(found, expected):
        return F.when(found > 0, found * F.log(found / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    return 2 * (term(seen, df * share) + term(df - seen, df * (1 - share)) + term(n_toxic - seen, (n - df) * share) + term(n - n_toxic - df + seen, (n - df) * (1 - share)))


def _counts_of(sample: DataFrame, known: np.ndarray) -> list:
    """Of each sampled row the places and counts of known features; a list of at most ``TRAIN_ROWS`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, count = [], []
            for words, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = np.frombuffer(words, "<u8")
                place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = known[place] == words
                at.append(place[hit].astype("<u4").tobytes())
                count.append(np.frombuffer(counts, "<u4")[hit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(count, pa.binary())], ["id", "toxic", "at", "counts"])

    return sorted(sample.mapInArrow(run, "id long, toxic int, at binary, counts binary").collect(), key=lambda r: (r.id, r.toxic, bytes(r.at)))


def _told_apart(df: np.ndarray, df_toxic: np.ndarray, n: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood ratio of each feature against chance, and whether toxic rows have it more often."""
    def term(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    share = n_toxic / n
    g = 2 * (term(df_toxic, df * share) + term(df - df_toxic, df * (1 - share)) + term(n_toxic - df_toxic, (n - df) * share) + term(n - n_toxic - df + df_toxic, (n - df) * (1 - share)))
    return g, df_toxic > df * share


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_FEATURES) -> Model:
    """Fit on a bounded sample of labelled rows.

    Without rows of both kinds, and so on empty tables, nothing counts as
    toxic.  Null texts have no words; labels or ids that are null are left
    out; a repeated label counts as toxic if any of its rows does.
    """
    sample = materialise(_sample(docs, labels, rows, id_col, text_col, label_col), "training")
    n, n_toxic = (int(x or 0) for x in sample.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first())
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 30.0) + np.arange(GRADES - 1))
    if n_toxic in (0, n):
        return none
    seen = materialise(_frequencies(sample), "features")
    # the ratio's tail is near exp(-g / 2): of all features about CHANCE pass by chance
    limit = 2 * math.log(max(seen.count() / CHANCE, 2))
    told = seen.withColumn("ratio", _ratio(n, n_toxic)).where(F.col("ratio") > limit).orderBy(F.desc("ratio"), "word").limit(most).collect()
    told.sort(key=lambda r: r.word % (1 << 64))
    known = np.array([r.word for r in told], dtype=np.int64).view(np.uint64)
    if not any(r.df_toxic * n > r.df * n_toxic for r in told):
        return none
    got = _counts_of(sample, known)
    toxic = np.array([r.toxic > 0 for r in got])
    x_row = np.repeat(np.arange(n), [len(r["at"]) // 4 for r in got])
    x_word = np.concatenate([np.frombuffer(r["at"], "<u4") for r in got]).astype(np.int64)
    x = np.log2(1 + np.concatenate([np.frombuffer(r["counts"], "<u4") for r in got]).astype(float))
    # each half's grades by what the other half's rows tell apart
    half = np.array([r.id for r in got]) // 2 % 2
    marked = np.zeros(n)
    for k in (0, 1):
        other = half != k
        df, df_toxic = (np.bincount(x_word, w[x_row].astype(float), len(known)) for w in (other, other & toxic))
        ratio, more = _told_apart(df, df_toxic, max(int(other.sum()), 1), int((other & toxic).sum()))
        telling = more & (ratio > limit / 2)  # half as many rows give half the ratio
        marked += np.where(half == k, np.bincount(x_row, telling[x_word].astype(float), n), 0.0)
    grade = np.where(toxic, 1 + np.searchsorted(GRADE_FROM, marked, side="right"), 0)
    return Model(known, *_ordinal(x_row, x_word, x, grade, n, len(known)))


def _ordinal(row: np.ndarray, word: np.ndarray, x: np.ndarray, grade: np.ndarray, n: int, width: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest posterior, by Adam over all rows."""
    w, base, gaps = np.zeros(width), np.array([1.0]), np.zeros(GRADES - 2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, base, gaps)]
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for step in range(1, steps + 1):
        width_of = np.exp(gaps)
        theta = np.concatenate([base, base + np.cumsum(width_of)])
        score = np.bincount(row, w[word] * x, n)
        high = np.where(grade < GRADES - 1, sig(theta[np.minimum(grade, GRADES - 2)] - score), 1.0)
        low = np.where(grade > 0, sig(theta[np.maximum(grade - 1, 0)] - score), 0.0)
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_score = d_high - d_low  # of the negative log likelihood
        g_theta = np.bincount(np.maximum(grade - 1, 0), d_low, GRADES - 1) - np.bincount(np.minimum(grade, GRADES - 2), d_high * (grade < GRADES - 1), GRADES - 1)
        grads = (
            np.bincount(word, g_score[row] * x, width) + w / PRIOR_VARIANCE,
            np.array([g_theta.sum()]),
            np.array([g_theta[k + 1 :].sum() for k in range(GRADES - 2)]) * width_of + gaps / PRIOR_VARIANCE,
        )
        rate = 0.1 * (1 - 0.9 * step / steps)
        for p_, g_, (m, v) in zip((w, base, gaps), grads, state):
            m *= 0.9
            m += 0.1 * g_
            v *= 0.999
            v += 0.001 * g_ * g_
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w, np.concatenate([base, base + np.cumsum(np.exp(gaps))])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, severity`` (expected grade), ``grade`` (most likely) of every row.

    Grades are made by rule from a label of two values (see the module).  Null
    reads as empty; repeated rows are scored each for itself, whole texts
    however long they are; other columns are left out; an empty table gives no
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_slices(offsets):
                severity, grade = model.severity(data, offsets[first : last + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(severity, pa.float64()), pa.array(grade, pa.int32())], ["id", "severity", "grade"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, severity double, grade int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of ``docs`` below ``reject_from``, with all their columns, whatever these are named.

    Rows are judged one by one, repeated ones too; null and empty texts stay;
    an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for first, last in row_slices(offsets):
                severity, _ = model.severity(data, offsets[first : last + 1])
                yield batch.slice(first, last - first).filter(pa.array(severity < reject_from))

    return docs.mapInArrow(run, docs.schema)


def op7(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of every document."""
    out = score(docs, fit(docs, labels))
    return out.select(F.col("id").alias("doc_id"), "severity", "grade", (F.col("severity") >= REJECT_FROM).alias("toxic"))
