"""Document fingerprints from improbable features: rare byte windows in chained Bloom filters.

Every window of WINDOW bytes has an entropy; how rare that entropy is in the whole corpus is its rank. Each window
of RUN neighbouring windows votes for its rarest member (the leftmost of equals), and windows of VOTES or more votes
are the features. Features go in order into Bloom filters of FILTER_BITS bits, PER_FILTER to a filter, chained.

The likeness of two digests compares each filter of the one with fewer (or less full) filters with all of the
other's: the overlap of bits, less that expected by chance, over the most that it could be; best overlap each,
averaged by features. Equal texts have equal digests; likeness is symmetric, and 1 for equal digests.

Texts below SHORT bytes hold few such features, so they have a second kind in filters of their own: 8-byte windows
(from THINNED bytes on, those whose hash is divisible by 4), and below 8 bytes the whole text. Two texts that both
have the second kind are compared by it, all others by the first, which texts of any length hold that have a run.

Defined results: a null text counts as empty; a text too short for a run (127 bytes) is like none of SHORT bytes or more;
an empty text has an empty digest, like 1 to another and 0 to the rest.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import mixed, small_batches, utf8

WINDOW, RUN, VOTES = 64, 64, 16
SHORT, THINNED = 640, 160
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Added to the number of features in filters of the second kind.
SECOND = 1 << 15
#: Entropy of a window in steps; the fixed-point gains make sliding sums exact.
STEPS, POINT = 1024, 1 << 20
GAIN = np.array([0] + [round(POINT * (c * np.log2(c) - (c - 1) * (np.log2(c - 1) if c > 1 else 0))) for c in range(1, WINDOW + 1)], np.int64)
FACTORS = mixed(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy step of the window at each position (0 to STEPS - 1), from exact sliding sums of c log c."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + WINDOW) + order
    at = np.arange(n)
    back = (at - np.searchsorted(key, key - (WINDOW - 1))).astype(np.int32)  # equal bytes among the 63 before
    ahead = (np.searchsorted(key, key + (WINDOW - 1), "right") - at - 1).astype(np.int32)
    gain, loss = np.empty(n, np.int64), np.empty(n, np.int64)
    gain[order], loss[order] = GAIN[back + 1], GAIN[ahead + 1]
    change = gain
    change[WINDOW:] -= loss[:-WINDOW]
    total = np.cumsum(change)[WINDOW - 1 :]
    most = int(WINDOW * np.log2(WINDOW) * POINT)
    return np.minimum(((most - total) * STEPS) // most, STEPS - 1).clip(0).astype(np.int16)


def histogram(texts: pa.Array) -> np.ndarray:
    """How many windows of each entropy lie within the texts."""
    data, offsets = utf8(texts)
    if len(data) < WINDOW:
        return np.zeros(STEPS, np.int64)
    steps = entropies(data)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    return np.bincount(steps[owner[: len(steps)] == owner[WINDOW - 1 :]], minlength=STEPS)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy step, the rarest first; nearly uniform windows come last, as they say little."""
    order = np.lexsort((np.arange(STEPS), counts))
    out = np.empty(STEPS, np.int32)
    out[order] = np.arange(STEPS)
    out[: STEPS // 6] += STEPS
    return out


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width (a power of two) values."""
    k = 1
    while k < width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return values


def features(texts: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' features, for each text those of the first kind in order, then those of the second; and the 2 n + 1 offsets."""
    data, offsets = utf8(texts)
    n, sizes = len(texts), np.diff(offsets)
    hashes, groups, order = [], [], []
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)]).astype(np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    if len(data) >= WINDOW + RUN:
        rank_at = rank[entropies(data)].astype(np.int64)
        m = len(rank_at)
        best = minima((rank_at << 32) | np.arange(m), RUN)
        # runs of windows wholly within one text
        good = owner[: len(best)] == owner[np.arange(len(best)) + RUN - 1 + WINDOW - 1]
        votes = np.bincount(best[good] & 0xFFFFFFFF, minlength=m)
        chosen = np.flatnonzero(votes >= VOTES)
        with np.errstate(over="ignore"):
            value = np.zeros(len(chosen), np.uint64)
            for k in range(WINDOW):
                value += padded[chosen + k] * FACTORS[k]
        hashes.append(mixed(value))
        groups.append(2 * owner[chosen])
        order.append(chosen)
    for width, few in ((8, (sizes >= 8) & (sizes < SHORT)), (0, (sizes > 0) & (sizes < 8))):
        which = np.flatnonzero(few)
        if not len(which):
            continue
        if width:
            at = np.concatenate([np.arange(offsets[i], offsets[i + 1] - width + 1) for i in which])
            length = np.full(len(at), width)
        else:
            at, length = offsets[which], sizes[which]
        with np.errstate(over="ignore"):
            value = length.astype(np.uint64)
            for k in range(8):
                value += np.where(length > k, padded[at + k], 0).astype(np.uint64) * FACTORS[k]
        value = mixed(value)
        kept = (sizes[owner[at]] < THINNED) | (value & np.uint64(3) == 0)
        hashes.append(value[kept] >> np.uint64(2))
        groups.append(2 * owner[at[kept]] + 1)
        order.append(at[kept])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(2 * n + 1, np.int64)
    group = np.concatenate(groups)
    where = np.lexsort((np.concatenate(order), group))
    return np.concatenate(hashes)[where], np.searchsorted(group[where], np.arange(2 * n + 1))


def digests(texts: pa.Array, rank: np.ndarray) -> list[np.ndarray]:
    """For each text its filters: rows of FILTER_BITS / 8 bytes, then two of the number of features and SECOND."""
    hashes, offsets = features(texts, rank)
    if not len(hashes):
        return [np.zeros((0, FILTER_BITS // 8 + 2), np.uint8)] * len(texts)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    filters = -(-counts // PER_FILTER)
    first = np.concatenate([[0], np.cumsum(filters)])
    row = first[owner] + (np.arange(len(hashes)) - offsets[owner]) // PER_FILTER
    bits = np.zeros((int(first[-1]), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    second = np.repeat(np.arange(len(counts)) % 2, filters) * SECOND
    held = (np.bincount(row, minlength=len(bits)) + second).astype(">u2").view(np.uint8).reshape(-1, 2)
    whole = np.concatenate([np.packbits(bits, axis=1), held], axis=1)
    return [whole[s:e] for s, e in zip(first[:-1:2], first[2::2], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    second_a, second_b = a[:, -2] >= SECOND >> 8, b[:, -2] >= SECOND >> 8
    if second_a.any() and second_b.any():
        a, b = a[second_a], b[second_b]
    else:
        a, b = a[~second_a], b[~second_b]
    if not len(a) or not len(b):
        return 0.0
    held = lambda x: x[:, -2].astype(int) * 256 % SECOND + x[:, -1]
    of = lambda x: int(held(x).sum())
    if (of(a), a.tobytes()) > (of(b), b.tobytes()):
        a, b = b, a
    weight = held(a).astype(float)
    x, y = a[:, :-2], b[:, :-2]
    ones_x, ones_y = np.bitwise_count(x).sum(1).astype(float), np.bitwise_count(y).sum(1).astype(float)
    best = np.zeros(len(x))
    for i in range(len(x)):
        shared = np.bitwise_count(x[i] & y).sum(1)
        most = np.minimum(ones_x[i], ones_y)
        chance = ones_x[i] * ones_y / FILTER_BITS
        best[i] = np.max((shared - chance) / np.maximum(most - chance, 1))
    return float(np.clip((best * weight).sum() / weight.sum(), 0, 1))


def coded(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def entropy_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often each entropy step occurs among all windows of all texts; one row for each step comes to the driver."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS, np.int64)
        for batch in batches:
            total += histogram(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS)), pa.array(total)], ["step", "n"])

    rows = df.select(text).mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").toArrow()
    total = np.zeros(STEPS, np.int64)
    total[rows["step"].to_numpy()] = rows["n"].to_numpy()
    return total


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_part, _role, doc_id, text: every row (role 0) dealt to parts by ranges of doc_id, and in each part once more, with role 1,
    the row that follows its last one (after the very last: the first). Sort a part by _role, doc_id, text to walk it.

    Bounds are approximate quantiles; only one doc_id for each part is gathered, and only those rows are read again.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bounds = sorted(set(d.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or [])) if n > 1 else []
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    part = F.size(F.filter(edges, lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    d = d.withColumn("_part", F.coalesce(part, F.lit(0)))
    # the least row of each part, nulls first, ties by text
    least = d.groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"))).alias("m")).select("_part", "m.doc_id").orderBy("_part").collect()
    if not least:
        return d.withColumn("_role", F.lit(0))
    before = {row["doc_id"]: least[k - 1]["_part"] for k, row in enumerate(least)}  # after the last part comes the first
    place = F.coalesce(*[F.when(F.col("doc_id").eqNullSafe(F.lit(k)), F.lit(p)) for k, p in before.items()]) if len(before) < 64 else None
    if place is None:
        table = spark.createDataFrame(list(before.items()), "first long, _before int")
        heads = d.join(F.broadcast(table), d["doc_id"].eqNullSafe(table["first"])).drop("first")  # one row for each part
    else:
        heads = d.withColumn("_before", place).where(F.col("_before").isNotNull())
    heads = heads.groupBy("_before", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return d.withColumn("_role", F.lit(0)).unionByName(heads.select("doc_id", "text", F.col("_before").alias("_part"), F.lit(1).alias("_role")))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row; see the contract."""
    import hashlib

    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ranks(entropy_counts(df, text)))  # one entry for each entropy step
    small_batches(spark)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        held = None  # (part, doc_id, text, digest) of the last row, which waits for the next
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), [t or "" for t in batch.column(3).to_pylist()], strict=True))
            marks = digests(batch.column(3).fill_null(""), rank)
            line = [*([held] if held else []), *((p, r, i, t, m) for (p, r, i, t), m in zip(rows, marks, strict=True))]
            pairs = [(a, b) for a, b in zip(line[:-1], line[1:], strict=True) if a[1] == 0]
            held = line[-1] if line else None
            if not pairs:
                continue
            changed = [edited(a[3], b[3]) for a, b in pairs]
            others = digests(pa.array(changed, pa.string()), rank)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]), pa.array([coded(a[4]) for a, _ in pairs]), pa.array([coded(o) for o in others]),
                    pa.array([likeness(a[4], o) for (a, _), o in zip(pairs, others, strict=True)], pa.float64()), pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = with_next(df, doc_id, text).select("_part", "_role", "doc_id", "text")
    return rows.repartition("_part").sortWithinPartitions("_part", "_role", "doc_id", "text").mapInArrow(walk, schema)


__all__ = ["coded", "digests", "edited", "entropies", "entropy_counts", "features", "fingerprints", "histogram", "likeness", "minima", "ranks", "with_next"]
