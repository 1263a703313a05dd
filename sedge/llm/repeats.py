"""Repeated byte strings: every string of LENGTH bytes that also starts earlier is found, and its bytes are removed.

The strings of LENGTH bytes (windows) are as many as the bytes, so they are first thinned without loss. Each window
has an anchor: the least, by hash, of the GRAM-byte strings in it. Equal windows have equal anchors at equal places,
so windows meet wherever their anchors do; consecutive windows with one anchor form a run, about one in
(LENGTH - GRAM) / 2 bytes. Runs are dealt by their anchor's hash. Runs of equal content repeat their first occurrence
in full; where one anchor has runs of different content, the bytes of each content's first run are sorted as
suffixes, and windows are compared with their neighbours in that order. Anchors with more than a task's share of
all runs are spread over their windows instead.

Order is by doc_id, then the place in the document. Defined results: a null text is empty; a null doc_id comes
first; rows of one doc_id and text are one document; those of one doc_id and different texts follow in their texts'
order; a document below LENGTH bytes loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.llm.common import batches_of, drop_copies, free_shuffles, mixed, saved, small_batches, trim, utf8
from sedge.llm.suffixes import suffix_array

LENGTH, GRAM = 100, 32
#: Low bits of an anchor's rank that hold its place in the batch; the first document may be this long.
PLACE_BITS = 30
#: Later rows of one doc_id start this much later.
SUB = 1 << 40
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK = 1 << 21


class Hashes:
    """64-bit hashes of any strings of some bytes, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(data)
            power = np.full(n, BASE, np.uint64)
            back = np.full(n + 1, INVERSE, np.uint64)
            if n:
                power[0], back[0] = 1, 1
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * np.cumprod(power))])
            self.back = np.cumprod(back)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.prefix[ends] - self.prefix[starts]) * self.back[starts])

    def grams(self, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = len(self.prefix) - width
            return mixed((self.prefix[width:] - self.prefix[:n]) * self.back[:n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, start (in the text), number of windows, hash of the anchor, hash of the content, for every run of a batch."""
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    m = len(data) - LENGTH + 1
    if m <= 0:
        return none
    hashes = Hashes(data)
    grams = hashes.grams(GRAM)
    rank = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    width, k = LENGTH - GRAM + 1, 1
    least = rank
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[: m], least[width - k : width - k + m])
    anchor = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[:m] == owner[LENGTH - 1 :]
    fresh = whole.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return none
    stop = whole.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~whole[1:]
    count = np.flatnonzero(stop) + 1 - starts
    at = anchor[starts]
    with np.errstate(over="ignore"):
        content = mixed(hashes.of(starts, starts + count + LENGTH - 1) + (at - starts).astype(np.uint64) * BASE + count.astype(np.uint64))
    text = owner[starts]
    return text, starts - offsets[:-1][text], count, grams[at], content


def keyed(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, sub, text), and every row of df with its document (doc, sub, doc_id, text). sub is 0 unless rows share a doc_id."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        rows = rows.withColumn("sub", F.lit(0).cast("long"))
        return rows.select("doc", "sub", "text"), rows.select("doc", "sub", "doc_id", "text")
    docs = rows.select("doc", "text").distinct().withColumn("sub", F.row_number().over(W.partitionBy("doc").orderBy("text")).cast("long") - 1)
    return docs.select("doc", "sub", "text"), rows.join(docs, ["doc", "text"]).select("doc", "sub", "doc_id", "text")


def found_runs(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """All runs: route, kind (1: an earlier run of this batch has its content), h, content, doc, start, n."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_copies()
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            text, start, n, h, content = runs(data, offsets)
            doc = batch.column(0).to_numpy()[text]
            start = start + batch.column(1).to_numpy()[text] * SUB
            order = np.lexsort((start, doc, content))
            again = np.zeros(len(order), bool)
            c = content[order]
            again[order[1:]] = c[1:] == c[:-1]
            route = np.where(np.isin(h, hot), content, h)
            route = np.where(again, mixed(doc.astype(np.uint64) ^ (start.astype(np.uint64) << np.uint64(20))), route)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route.view(np.int64)), pa.array(again), pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(start), pa.array(n.astype(np.int16))],
                ["route", "again", "h", "content", "doc", "start", "n"],
            )

    return docs.select("doc", "sub", "text").mapInArrow(find, "route long, again boolean, h long, content long, doc long, start long, n short")


def hot_anchors(docs: DataFrame, share: int = 16) -> np.ndarray:
    """Anchors of more than one shuffle part's share of all runs, so fewer than there are parts; seen on one document in share. They only balance tasks."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = np.unique(runs(*utf8(batch.column(0)))[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit("hot"), "doc"), F.lit(share)) == 0).select("text")
    counts = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.groupBy((F.col("n") >= 16).alias("often")).agg(F.sum("n").alias("n")).collect()
    most = sum(r["n"] for r in rows) / parts
    if not any(r["often"] for r in rows):
        return np.zeros(0, np.uint64)
    return counts.where((F.col("n") >= 16) & (F.col("n") > most)).select("h").toArrow()["h"].to_numpy().view(np.uint64)


def settled(found: DataFrame, hot: np.ndarray) -> DataFrame:
    """doc, start, n, h of runs: repeated (flag true), or first of their content where others share the anchor (flag false)."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def finish(table: pa.Table) -> pa.RecordBatch:
            again, h, content, n = (table[c].to_numpy() for c in ("again", "h", "content", "n"))
            doc, start = table["doc"].to_numpy(), table["start"].to_numpy()
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            first = new_h | np.concatenate([[True], content[1:] != content[:-1]])
            repeat = again | ~first
            group = np.cumsum(new_h) - 1
            several = np.bincount(group, (first & ~again).astype(np.int64))[group] > 1
            first = first & ~again & (several | np.isin(h.view(np.uint64), hot))
            out = repeat | first
            return pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(start[out]), pa.array(n[out]), pa.array(h[out]), pa.array(repeat[out])], ["doc", "start", "n", "h", "flag"])

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            h = table["h"].to_numpy()
            last = len(h) - int(np.argmax(np.append(h[::-1] != h[-1], True)))
            if last:
                yield finish(pa.concat_tables([*held, table.slice(0, last)]))
                held = []
            held.append(table.slice(last))
        if held:
            yield finish(pa.concat_tables(held))
        trim()

    rows = found.repartition("route").sortWithinPartitions("h", "again", "content", "doc", "start")
    return rows.mapInArrow(settle, "doc long, start long, n short, h long, flag boolean")


def contents(docs: DataFrame, firsts: DataFrame, hot: np.ndarray) -> DataFrame:
    """route, doc, start, n, bytes: what the windows of the given runs cover; runs of hot anchors as single windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            lists = batch.column(3)
            of = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start, n, h = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            n = n.astype(np.int64)
            base = batch.column(1).to_numpy()[of] * SUB
            at = start - base + offsets[:-1][of]
            is_hot = np.isin(h.view(np.uint64), hot)
            route = h.copy()
            if is_hot.any():
                k = np.where(is_hot, n, 1)
                step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                at, start, of, route, n, is_hot = np.repeat(at, k) + step, np.repeat(start, k) + step, np.repeat(of, k), np.repeat(route, k), np.where(np.repeat(is_hot, k), 1, np.repeat(n, k)), np.repeat(is_hot, k)
                hashes = Hashes(data)
                route[is_hot] = hashes.of(at[is_hot], at[is_hot] + LENGTH).view(np.int64)
            raw = data.tobytes()
            values = pa.array([raw[s:e] for s, e in zip(at.tolist(), (at + n + LENGTH - 1).tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(batch.column(0).to_numpy()[of]), pa.array(start), pa.array(n.astype(np.int16)), values], ["route", "doc", "start", "n", "bytes"])

    wanted = firsts.withColumn("sub", F.floor(F.col("start") / SUB)).groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "n", "h")).alias("runs"))
    return docs.join(wanted, ["doc", "sub"]).select("doc", "sub", "text", "runs").mapInArrow(cut, "route long, doc long, start long, n short, bytes binary")


def repeated_windows(parts: list[bytes], n: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, n of stretches of windows that equal an earlier window, by the order of suffixes of all parts."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(int(begin[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin[1:] - 1] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + len(parts) + 1
    text[begin[1:] - 1] = np.arange(1, len(parts) + 1)  # each part ends in a symbol of its own
    order = suffix_array(text, 256 + len(parts) + 1)
    part = np.repeat(np.arange(len(parts)), size + 1)
    offset = np.arange(len(text)) - begin[:-1][part]
    order = order[offset[order] < n[part[order]]]  # suffixes that begin with a window
    # adjacent prefixes, eight bytes at a time; windows differ late more often than early
    raw = np.concatenate([np.where(inside, text - len(parts) - 1, 0).astype(np.uint8), np.zeros(8, np.uint8)])
    eight = np.zeros(len(text), np.uint64)
    for k in range(8):
        eight |= raw[k : k + len(text)].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in (LENGTH - 8, *range((LENGTH - 1) // 8 * 8 - 8, -1, -8)):
        which = np.flatnonzero(same)
        if not len(which):
            break
        same[which] = eight[order[which] + k] == eight[order[which - 1] + k]
    group = np.cumsum(~same)
    d, s = doc[part[order]], start[part[order]] + offset[order]
    rank = np.lexsort((s, d, group))
    later = np.concatenate([[False], group[rank][1:] == group[rank][:-1]])
    # not the first of its group, nor at the same place as the first
    leads = np.maximum.accumulate(np.where(~later, np.arange(len(rank)), 0))
    later &= (d[rank] != d[rank][leads]) | (s[rank] != s[rank][leads])
    hits = np.sort(order[rank[later]])
    if not len(hits):
        return hits, hits, hits
    cuts = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
    firsts = hits[cuts]
    count = np.diff(np.append(np.flatnonzero(cuts), len(hits)))
    return doc[part[firsts]], start[part[firsts]] + offset[firsts], count


def compared(pieces: DataFrame) -> DataFrame:
    """doc, start, n of the repeated windows among the pieces of each route."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        bytes_held = 0

        def finish(table: pa.Table) -> pa.RecordBatch:
            doc, start, n = repeated_windows(table["bytes"].to_pylist(), table["n"].to_numpy().astype(np.int64), table["doc"].to_numpy(), table["start"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32())], ["doc", "start", "n"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(pa.Table.from_batches([batch]))
            bytes_held += batch.nbytes
            if bytes_held >= CHUNK:
                table = pa.concat_tables(held)
                route = table["route"].to_numpy()
                last = len(route) - int(np.argmax(np.append(route[::-1] != route[-1], True)))
                if last:
                    yield finish(table.slice(0, last))
                held = [table.slice(last)]
                bytes_held = held[0].nbytes
        if held and sum(map(len, held)):
            yield finish(pa.concat_tables(held))

    return pieces.repartition("route").sortWithinPartitions("route").mapInArrow(compare, "doc long, start long, n int")


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of df."""
    spark = df.sparkSession
    small_batches(spark)
    docs, rows = keyed(df, doc_id, text)
    hot = hot_anchors(docs)
    with batches_of(spark, 1000):
        done = saved(settled(found_runs(docs, hot), hot), "runs")
    free_shuffles(spark)
    pieces = contents(docs, done.where("not flag").select("doc", "start", "n", "h"), hot)
    with batches_of(spark, 20_000):
        more = saved(compared(pieces), "runs")
    free_shuffles(spark)
    stretches = done.where("flag").select("doc", "start", F.col("n").cast("int").alias("n")).unionByName(more)
    spans = stretches.withColumn("sub", F.floor(F.col("start") / SUB)).groupBy("doc", "sub").agg(F.collect_list(F.struct(F.pmod("start", F.lit(SUB)).alias("start"), "n")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, n_spans, kept = [], [], [], []
            for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = np.frombuffer(t.encode(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int32)
                for span in x or ():
                    gone[span["start"]] += 1
                    gone[span["start"] + span["n"] + LENGTH - 1] -= 1
                out = np.cumsum(gone)[:-1] > 0
                sizes.append(len(raw))
                removed.append(int(out.sum()))
                n_spans.append(int((out & ~np.concatenate([[False], out[:-1]])).sum()) if len(out) else 0)
                kept.append(raw[~out].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(spans, ["doc", "sub"], "left").select("doc_id", "text", "spans").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
