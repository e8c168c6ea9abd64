"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts hashed n-grams (1 to 3 characters, lower-cased, with a space at either end) by label, over all
labelled rows: each task sends its sums by label and bucket, Spark adds them, and the driver receives one matrix of
BUCKETS by labels, whatever the input, and the labels' document counts, the prior.  Its log probabilities are broadcast.
Prediction hashes whole texts and sums the matrix rows of the n-grams of several texts at a time, by segment, in numpy.

Only texts and labels are learnt from; source and id are never inputs.  The label is the one of the largest posterior.
The score is its posterior after the log odds are divided by the square root of the number of n-grams, which are not
independent.

Defined results: null text, and text without a letter, is ``und`` with score 0; ties go to the smaller label; with
no labelled rows everything is ``und``; rows with null ids are predicted and count as held in; extra columns are ignored
(or carried along, by ``predict``); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, table

BITS = 16
BUCKETS = 1 << BITS
ORDERS = 3
ALPHA = 0.5
#: Labels that a matrix may have; the languages of the world fit.
MOST_LABELS = 8192
#: Characters hashed at a time, so that memory doesn't grow with the text.
CHUNK = 1 << 20
#: Numbers of the matrix that are gathered at a time, and labels that a task counts before it sends sums on.
CELLS, HELD_LABELS = 1 << 21, 64
LETTER = regex.compile(r"\p{L}")


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the whole text, by chunks that overlap by ORDERS - 1."""
    s = f" {text.lower()} "
    for at in range(0, len(s), CHUNK):
        part = s[max(0, at - ORDERS + 1) : at + CHUNK]
        x = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = len(x) - min(at, ORDERS - 1)  # n-grams that end in this chunk
        h = np.zeros(len(x), np.uint32)
        for order in range(ORDERS):
            if order >= len(x):
                break
            h = (h[: len(x) - order] if order == 0 else h[1:]) * np.uint32(0x01000193) + x[: len(x) - order] * np.uint32(0x9E3779B1) + np.uint32(order)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(32 - BITS))[-own:] if own else mixed[:0]


def learn(rows: DataFrame, text_col: str, label_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels in order, log probabilities float32 [BUCKETS, labels], and log priors; all rows with a label are counted."""

    def sums_of(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for label, own in sums.items():
            at = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["label", "bucket", "n"])
        sums.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                if label not in sums and len(sums) >= HELD_LABELS:
                    yield from sums_of(sums)
                own = sums.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
                own[BUCKETS] += 1  # documents
                for at in buckets(text.as_py() or ""):
                    own += np.bincount(at, minlength=BUCKETS + 1)
        yield from sums_of(sums)

    labelled = rows.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).filter("label IS NOT NULL AND text IS NOT NULL")
    if labelled.select("label").distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels: the column {label_col} doesn't name languages")
    sums = labelled.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("all")).collect()  # MOST_LABELS rows of BUCKETS + 1 pairs at most
    labels = sorted(r["label"] for r in packed)
    counts = np.zeros((BUCKETS + 1, len(labels)), np.float64)
    for r in packed:
        at = np.array([x["bucket"] for x in r["all"]])
        counts[at, labels.index(r["label"])] = [x["n"] for x in r["all"]]
    if not labels:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    smooth = counts[:BUCKETS] + ALPHA
    return labels, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log(counts[BUCKETS] / counts[BUCKETS].sum())


def likelihoods(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods [texts, labels] and numbers of n-grams: sparse rows of several texts times the matrix, in blocks of bounded memory."""
    total, n = np.zeros((len(texts), logp.shape[1])), np.zeros(len(texts), np.int64)
    most = max(1, CELLS // max(1, logp.shape[1]))
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def add() -> None:
        nonlocal size
        starts = np.cumsum([0, *(len(x) for _, x in held[:-1])])
        sums = np.add.reduceat(logp.take(np.concatenate([x for _, x in held]), axis=0), starts, axis=0, dtype=np.float64)
        np.add.at(total, [i for i, _ in held], sums)
        held.clear()
        size = 0

    for i, t in enumerate(texts):
        for at in buckets(t):
            n[i] += len(at)
            for first in range(0, len(at), most):
                part = at[first : first + most]
                if size + len(part) > most and held:
                    add()
                held.append((i, part))
                size += len(part)
    if held:
        add()
    return total, n


def predict_texts(texts: list[str | None], labels: list[str], logp: np.ndarray, prior: np.ndarray) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    own = [i for i, t in enumerate(texts) if t and labels and LETTER.search(t)]
    if own:
        likely, n = likelihoods([texts[i] for i in own], logp)
        z = likely + prior
        best = z.argmax(axis=1)
        z = (z - z.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
        for i, k, x in zip(own, best.tolist(), (1 / np.exp(z).sum(axis=1)).tolist()):
            names[i], scores[i] = labels[k], x
    return names, scores


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with all its columns, and the two new ones; should it have columns of their names, these are replaced."""
    docs = docs.select(*[c for c, name in zip(columns_of(docs), docs.columns) if name.lower() not in (lang.lower(), score.lower())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of MOST_LABELS floats at most
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = predict_texts(b.column(at).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = learn(docs.filter(~held_out()), "text", "lang")
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
