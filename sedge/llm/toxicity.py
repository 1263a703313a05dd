"""Toxicity by multiple-instance learning: a document is toxic if any sentence is, by noisy-or of sentence scores.

A sentence's score is the logistic of the sum of its words' weights; each word has three hashed features: itself and
its first four and five bytes, so that inflected forms share weight. No weight is below 0, so the
words around an offending one can't excuse it. Weights are trained on the driver from document
labels alone, on a bounded sample: about train_docs labelled documents chosen by a hash of doc_id, as hashed ids.

Defined results: a null or empty text has the score of no sentence, 0; repeated label rows of a document count as
one, toxic if any is; without labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import held_out, mixed, small_batches, trim, utf8

BITS = 20
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
ENDS = np.array([chr(b) in ".!?\n" for b in range(256)])


def instances(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """features (words x 3), sentence of each word, text of each sentence, byte range of each sentence (n x 2, within its text)."""
    data, offsets = utf8(pc.utf8_lower(texts.fill_null("")))
    n = len(data)
    if not n:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    fresh = np.zeros(n + 1, bool)  # where a text or a sentence begins
    fresh[offsets[:-1]] = True
    fresh[1:n] |= ENDS[data[:-1]] & ~ENDS[data[1:]]
    fresh = fresh[:n]
    letter = LETTER[data]
    first = letter & (fresh | np.concatenate([[True], ~letter[:-1]]))
    starts = np.flatnonzero(first)
    stop = np.concatenate([~letter[1:] | fresh[1:], [True]]) & letter
    length = np.flatnonzero(stop) + 1 - starts
    begins = np.flatnonzero(fresh)
    of_text = np.searchsorted(offsets, begins, "right") - 1
    bounds = np.stack([begins, np.append(begins[1:], n)], 1) - offsets[of_text][:, None]
    bounds[:, 1] = np.minimum(bounds[:, 1], np.diff(offsets)[of_text])
    sentence = np.searchsorted(begins, starts, "right") - 1
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    head = np.zeros(len(starts), np.uint64)
    for b in range(8):
        head |= np.where(length > b, padded[starts + b], 0).astype(np.uint64) << np.uint64(8 * b)
    tail = np.zeros(len(starts), np.uint64)
    for b in range(8):
        tail |= np.where(length > 8 + b, padded[np.minimum(starts + 8 + b, n)], 0).astype(np.uint64) << np.uint64(8 * b)
    with np.errstate(over="ignore"):
        whole = mixed(head ^ mixed(tail + length.astype(np.uint64)))
        four = mixed((head & np.uint64(0xFFFFFFFF)) + np.uint64(4 << 60 & 0xFFFFFFFFFFFFFFFF))
        five = mixed((head & np.uint64(0xFFFFFFFFFF)) + np.uint64(5 << 59))
    features = np.stack([whole, four, five], 1) >> np.uint64(64 - BITS)
    return features.astype(np.int64), sentence, of_text, bounds


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def sentences(self, features: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(sentence, self.weights[features].sum(1), minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A score for each text; then for each sentence its score, text and byte range."""
        features, sentence, of_text, bounds = instances(texts)
        p = self.sentences(features, sentence, len(of_text))
        clean = np.bincount(of_text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts))
        return -np.expm1(clean), p, of_text, bounds


def fitted(features: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray, rounds: int = 80, rate: float = 0.3, decay: float = 3e-5, least: int = 5) -> ToxicityModel:
    """Noisy-or maximum likelihood by Adam over the features of least documents or more; document: of each sentence."""
    size, n_docs = 1 << BITS, len(label)
    flat, owner = features.ravel(), np.repeat(sentence.astype(np.int32), 3)
    often, last = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    of_doc = document[sentence]
    for d, (s, e) in enumerate(zip(*(np.searchsorted(of_doc, np.arange(n_docs), side) for side in ("left", "right")), strict=True)):
        own = flat[3 * s : 3 * e]
        own = own[last[own] != d]
        last[own] = d
        often[np.unique(own)] += 1
    keep = often[flat] >= least
    flat, owner = flat[keep], owner[keep]
    used = np.flatnonzero(often >= least)
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    flat = place[flat]
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = -6.0
    for step in range(1, rounds + 1):
        z = np.clip(w[-1] + np.bincount(owner, w[flat], minlength=len(document)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        whole = -np.expm1(np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs))
        push = np.where(label == 1, -(1 - whole) / np.maximum(whole, 1e-9), 1.0)[document] * p / n_docs
        g = np.append(np.bincount(flat, push[owner], minlength=len(used)), push.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    weights = np.zeros(size)
    weights[used] = w[:-1]
    return ToxicityModel(weights, float(w[-1]))


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", train_docs: int = 4000) -> ToxicityModel:
    """Fit on about train_docs labelled documents, never on held-out ones."""
    small_batches(df.sparkSession)
    marks = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).cast("int").alias("_toxic"))
    n = marks.count()
    chosen = marks.where(F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1_000_000)) < min(1.0, train_docs / max(n, 1)) * 1_000_000)
    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()).join(chosen, "_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, sentence, of_text, _ = instances(batch.column(0))
            words = np.searchsorted(of_text[sentence], np.arange(len(batch) + 1)) if len(f) else np.zeros(len(batch) + 1, np.int64)
            lists = lambda x, width: pa.ListArray.from_arrays(pa.array((words * width).astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists(f.ravel().astype(np.int32), 3), lists(sentence.astype(np.int32), 1)], ["id", "label", "features", "sentences"])

    found = rows.select("_text", F.col("_id").cast("long").alias("id"), F.col("_toxic").alias("label")).mapInArrow(features, "id long, label int, features array<int>, sentences array<int>").toArrow()
    found = found.sort_by("id").combine_chunks()
    label = found["label"].to_numpy()
    if not len(label) or not label.any():
        return ToxicityModel(np.zeros(1 << BITS), -30.0)
    flat = found["features"].combine_chunks().flatten().to_numpy().reshape(-1, 3)
    lists = found["sentences"].combine_chunks()
    document = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    local = lists.flatten().to_numpy()
    new = np.concatenate([[True], (local[1:] != local[:-1]) | (document[1:] != document[:-1])]) if len(local) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    return fitted(flat, sentence, document[new], label)


def scored(df: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.5) -> DataFrame:
    """df with score, predicted (1 from limit on), offending: the sentences of that score or more, as start, end (bytes), score; without the text. Columns of these names are replaced."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of 2 ** BITS weights
    small_batches(spark)
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    @F.arrow_udf("struct<score:double,offending:array<struct<start:bigint,end:bigint,score:double>>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            total, p, of_text, bounds = m.score(texts)
            bad = np.flatnonzero(p >= limit)
            spans = pa.StructArray.from_arrays([pa.array(bounds[bad, 0]), pa.array(bounds[bad, 1]), pa.array(np.round(p[bad], 6))], fields=list(item))
            offsets = np.searchsorted(of_text[bad], np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), spans)], ["score", "offending"])
            trim()

    s = "_sedge_scores"
    out = df.withColumn(s, score(F.col(text))).drop(text, "score", "predicted", "offending")
    return out.withColumns({"score": F.col(f"{s}.score"), "predicted": (F.col(f"{s}.score") >= limit).cast("int"), "offending": F.col(f"{s}.offending")}).drop(s)
