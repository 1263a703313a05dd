"""Language by nearest centroid: normalised TF-IDF vectors of byte trigrams, several centroids a language, cosine.

The model learns from a bounded sample: about train_docs documents of each language (chosen by a hash of doc_id, so
alike at any size); one sparse vector for each comes to the driver. Cosines grow with the text, so each language has a
rejection limit for each class of lengths (powers of two code points): a share of the training rows' median cosine. A
document whose best cosine is below it is rejected; its nearest language is still named. Texts below 200 code points,
and classes of fewer than 10 training rows in all shorter ones too, are never rejected by distance.

Defined results: `und` and score 0 for a null text or one without a letter, and both are rejected; texts of unknown
script have cosine near 0 and are rejected if they aren't short; without any training row every text is `und`. Rows with
a null doc_id are dealt to the sample by their text. lang_pred, score and rejected replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import drop_copies, held_out, small_batches, trim, utf8

DIMENSIONS = 1 << 13
#: Texts of fewer code points are never rejected by distance; classes of lengths.
JUDGED, CLASSES = 200, 16
#: Bytes that part words: all of ASCII but letters.
PARTED = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all texts and each one's text; words are lower-cased and parted by one space at each end."""
    lower = pc.utf8_lower(pc.binary_join_element_wise(" ", texts.fill_null(""), " ", ""))
    data, offsets = utf8(lower)
    data = PARTED[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)  # runs of separators count once
    n = np.concatenate([[0], np.cumsum(keep)])
    data, offsets = data[keep].astype(np.uint32), n[offsets]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    hashed = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    return hashed[inside].astype(np.int64), owner[:-2][inside]


def counts_of(texts: pa.Array) -> np.ndarray:
    grams, owner = trigrams(texts)
    return np.bincount(owner * DIMENSIONS + grams, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(-1, keepdims=True))
    return rows / np.where(norm == 0, 1, norm)


@dataclass
class LanguageModel:
    languages: list[str]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray  # by language and class of lengths

    def rejected(self, best: np.ndarray, score: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
        return (score < self.limits[best, length_class(n_chars)]) & (n_chars >= JUDGED)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid's language and the cosine, for each text."""
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        weighted = np.ascontiguousarray((self.centroids * self.idf).T)
        for k in range(0, len(texts), 64):
            tf = np.log1p(counts_of(texts[k : k + 64]))
            norm = np.sqrt((tf * tf) @ (self.idf * self.idf))
            cosine = (tf @ weighted) / np.where(norm == 0, 1, norm)[:, None]
            nearest = cosine.argmax(1)
            best[k : k + 64], score[k : k + 64] = self.owner[nearest], cosine[np.arange(len(tf)), nearest]
        return best, np.clip(score, 0, 1)


def length_class(n_chars: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(n_chars, 1)).astype(np.int64), 0, CLASSES - 1)


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first starts."""
    chosen = [int((rows @ unit(rows.mean(0))).argmax())]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(1).argmin()))
    centroids = rows[chosen]
    for _ in range(rounds):
        nearest = (rows @ centroids.T).argmax(1)
        centroids = np.stack([unit(rows[nearest == c].mean(0)) if (nearest == c).any() else centroids[c] for c in range(len(centroids))])
    return centroids


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = 400, centroids: int = 3, slack: float = 0.55) -> LanguageModel:
    """Fit on about train_docs documents a language, never on held-out ones. slack: the rejection limit as a share of the median cosine."""
    known = df.select(doc_id, text, lang).where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row a language
    if not sizes:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros((0, CLASSES)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_docs / n))])
    sample = known.where(F.pmod(F.xxhash64(F.lit("langid"), F.coalesce(F.col(doc_id).cast("string"), F.col(text))), F.lit(1_000_000)) < share[F.col(lang)] * 1_000_000)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_copies()
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                counts = counts_of(part.column(0))
                used = [np.flatnonzero(row) for row in counts]
                values = [row[u].astype(np.int32) for row, u in zip(counts, used, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([u.astype(np.int32) for u in used], pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32())), pc.utf8_length(part.column(0)).cast(pa.int64())], ["lang", "dims", "counts", "n_chars"])

    small_batches(df.sparkSession)
    rows = sample.select(text, F.col(lang).cast("string").alias("lang")).mapInArrow(vectors, "lang string, dims array<int>, counts array<int>, n_chars long").toArrow()
    tf = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (dims, counts) in enumerate(zip(rows["dims"].to_pylist(), rows["counts"].to_pylist(), strict=True)):
        tf[i, dims] = np.log1p(counts)
    order = np.lexsort((tf.sum(1), np.array(rows["lang"].to_pylist())))  # whatever order the rows came in
    tf, labels, n_chars = tf[order], np.array(rows["lang"].to_pylist())[order], rows["n_chars"].to_numpy()[order]
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 0.1
    vec = unit(tf * idf)
    languages = sorted(set(labels.tolist()))
    found = [clustered(vec[labels == x], centroids) for x in languages]
    owner = np.repeat(np.arange(len(languages)), [len(f) for f in found])
    every = np.concatenate(found)
    model = LanguageModel(languages, owner, every, idf, np.zeros((len(languages), CLASSES)))
    best, classes = (vec @ every.T).max(1), length_class(n_chars)
    for i, x in enumerate(languages):
        for c in range(CLASSES):
            here = best[(labels == x) & (classes == c)]
            # a class of few rows takes the limit of the shorter ones
            model.limits[i, c] = slack * float(np.median(here)) if len(here) >= 10 else (model.limits[i, c - 1] if c else 0.0)
    return model


def predicted(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred, score (the cosine, 0 to 1), rejected."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # some centroids a language
    small_batches(spark)

    @F.arrow_udf("struct<lang:string,score:double,far:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_copies()
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for texts in batches:
            best, score = m.predict(texts) if m.languages else (np.zeros(len(texts), np.int64), np.zeros(len(texts)))
            n_chars = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            far = m.rejected(best, score, n_chars) if m.languages else np.ones(len(texts), bool)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(far)], ["lang", "score", "far"])
            trim()

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    # nondeterministic: a filter on what it gives mustn't run it twice
    p, known = "_sedge_prediction", "_sedge_lettered"
    out = df.drop("lang_pred", "score", "rejected").withColumn(p, predict.asNondeterministic()(F.col(text))).withColumn(known, lettered)
    return (
        out.withColumn("lang_pred", F.when(F.col(known), F.col(f"{p}.lang")).otherwise("und"))
        .withColumn("score", F.when(F.col(known), F.col(f"{p}.score")).otherwise(0.0))
        .withColumn("rejected", (F.col("lang_pred") == "und") | F.col(f"{p}.far"))
        .drop(p, known)
    )
