"""Token-ID files: canonical length-limited Huffman codes from global counts, read back by table in independent blocks.

A file set is one folder of three Parquet tables, so that Spark's committer makes it whole or not at all and any
store that Spark reads can hold it:

- blocks: part, seq, before (tokens of the part before it), doc_id array, doc_tokens array, checkpoints array, n_tokens, payload. A block holds whole
  documents in order, of BLOCK_TOKENS tokens or more (the last of a part: fewer). payload is the bit stream, most
  significant bit first; checkpoints are the bit offsets of each CHECKPOINT-th token, so any stretch decodes alone.
- codebook: id, length. Codes are canonical: by length, then id.
- parts: part, first_token. Parts follow ascending doc_id; first_token counts the tokens of all parts before.

Defined results: a null text has only the end id; a null doc_id comes first; equal doc_ids go by their ids' bytes.
Ids are any below 2**32 with at most 2**MAX_BITS distinct ones.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.bpe import Chunks, END, parts_at_word_ends
from sedge.llm.common import batches_of, drop_copies, remove_dir, shared_dir, small_batches, worker_copy

MAX_BITS = 18
CHECKPOINT = 512
BLOCK_TOKENS = 1 << 15


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths up to limit for positive counts, by package-merge."""
    m = len(counts)
    if m > 1 << limit:
        raise ValueError(f"{m} ids can't have codes of {limit} bits")
    if m <= 1:
        return np.ones(m, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, merged = [], np.zeros(0)
    for _ in range(limit):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < m)
        merged = both[sort]
    lengths, take = np.zeros(m, np.int64), 2 * (m - 1)
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:take].sum())
        lengths[:taken] += 1
        take = 2 * (take - taken)
    out = np.zeros(m, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes for ids of given lengths (ids ascending), and the table that decodes them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max()) if len(ids) else 1
        # each code covers 2 ** (bits - length) entries of the table, so its start is a prefix sum
        spans = 1 << (self.bits - self.lengths)
        starts = np.concatenate([[0], np.cumsum(spans)])
        self.codes = starts[:-1] >> (self.bits - self.lengths)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.entry[: starts[-1]] = np.repeat(np.arange(len(ids), dtype=np.int32), spans)
        top = int(self.ids.max()) + 1 if len(ids) else 0
        self.place = np.full(top, -1, np.int64)
        self.place[self.ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bit offset of each CHECKPOINT-th id."""
        at = self.place[ids]
        if len(at) and at.min() < 0:
            raise ValueError("an id that isn't in the codebook")
        size, code = self.lengths[at], self.codes[at].astype(np.uint64)
        ends = np.cumsum(size)
        starts = ends - size
        total = int(ends[-1]) if len(ends) else 0
        # each code lies in one or two 32-bit words; distinct bits, so sums are unions
        wide = code << (64 - (starts & 31) - size).astype(np.uint64)
        word = starts >> 5
        out = np.zeros(total // 32 + 2, np.uint64)
        if len(word):
            firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[firsts]] += np.add.reduceat(wide >> np.uint64(32), firsts)
            out[word[firsts] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), firsts)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], starts[::CHECKPOINT]

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
        """The ids of several blocks at once: every checkpoint of every block is a lane, and all lanes step together."""
        data = np.frombuffer(b"".join(p + b"\0" * 4 for p in payloads), np.uint8).astype(np.uint32)
        ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        bases = np.concatenate([[0], np.cumsum([len(p) + 4 for p in payloads])]) * 8
        lanes = [-(-int(n) // CHECKPOINT) for n in sizes]
        offset = np.concatenate([c[:k].astype(np.int64) + b for c, k, b in zip(checkpoints, lanes, bases, strict=False)])
        left = np.concatenate([np.minimum(CHECKPOINT, n - CHECKPOINT * np.arange(k)) for n, k in zip(sizes, lanes, strict=True)]).astype(np.int64)
        out = np.zeros((CHECKPOINT, len(offset)), np.int32)
        order = np.argsort(-left, kind="stable")  # lanes that end early fall off the end
        offset, ending = offset[order], np.searchsorted(-left[order], -np.arange(CHECKPOINT))
        shift = np.uint32(32 - self.bits)
        mask = np.uint32((1 << self.bits) - 1)
        for step in range(CHECKPOINT):
            k = int(ending[step])
            if not k:
                break
            o = offset[:k]
            at = self.entry[(ahead[o >> 3] >> (shift - (o & 7).astype(np.uint32))) & mask]
            out[step, :k] = at
            offset[:k] += self.lengths[at]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        flat, result, lane = self.ids[out.T], [], 0
        for n, k in zip(sizes, lanes, strict=True):
            rows = flat[back[lane : lane + k]]
            result.append(rows.reshape(-1)[: int(n)] if k else np.zeros(0, np.int64))
            lane += k
        return result


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def chunks(path: str) -> Chunks:
    """One copy in each Python worker."""
    return worker_copy(("chunks", path), lambda: library_chunks(path))


class WholeTexts:
    """Ids of whole texts by the library, for tokenizers of any other form."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


def library_chunks(path: str) -> Chunks | WholeTexts:
    """The library behind the cache of stretches; letter runs go to it many to a text and are parted at word ends."""
    if not parts_at_word_ends(path):
        return WholeTexts(path)
    tok = tokenizer(path)
    ends = np.zeros(tok.get_vocab_size(), bool)
    ends[[i for t, i in tok.get_vocab().items() if t.endswith(END)]] = True

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def stems(words: list[str]) -> list[bytes]:
        ids = [e.ids for e in tok.encode_batch_fast([" ".join(words[k : k + 200]) for k in range(0, len(words), 200)], add_special_tokens=False)]
        flat = np.array([i for x in ids for i in x], "<u4")
        data, last = flat.tobytes(), (np.flatnonzero(ends[flat]) + 1) * 4
        if len(last) != len(words):
            raise ValueError("word ends don't part these words")
        return [data[s:e] for s, e in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]

    return Chunks(stems, whole)


def tokenized(df: DataFrame, path: str, end: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned integers of id_width() bytes) of each whole text by the tokenizers library."""
    small_batches(df.sparkSession)
    kind = f"<u{id_width(path, end)}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(path)
        for batch in batches:
            ids, offsets = known.ids(batch.column(1))
            if end is not None:
                ids, offsets = np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
            data = ids.astype(kind)
            values = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, ids binary")


@functools.lru_cache(maxsize=8)
def id_width(path: str, end: int | None = None) -> int:
    return 2 if max(tokenizer(path).get_vocab_size(), end or 0) < 1 << 16 else 4


def id_counts(tokens: DataFrame, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """All ids and how often each occurs; at most one row for each id of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}")
            more = np.bincount(ids)
            if len(more) > len(total):
                total, more = more, total
            total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    return rows["id"].to_numpy(), rows["n"].to_numpy()


def write_token_files(tokens: DataFrame, folder: str, width: int = 4, limit: int = MAX_BITS) -> None:
    """Write tokens (doc_id, ids of so many bytes each) as a file set in ascending doc_id order."""
    spark = tokens.sparkSession
    ids, counts = id_counts(tokens, width)
    lengths = code_lengths(counts, limit)
    spark.createDataFrame(pa.table({"id": ids.astype(np.int64), "length": lengths.astype(np.int32)})).coalesce(1).write.parquet(f"{folder}/codebook")
    book = spark.sparkContext.broadcast((ids, lengths))  # one entry for each id of the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(*book.value), TaskContext.get().partitionId()
        docs, held, n, seq, before = [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            payload, checkpoints = code.encode(np.concatenate(held).astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([checkpoints], pa.list_(pa.int64())),
                    pa.array([n], pa.int64()), pa.array([payload], pa.binary()),
                ],
                ["part", "seq", "before", "doc_id", "doc_tokens", "checkpoints", "n_tokens", "payload"],
            )

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(d)
                held.append(np.frombuffer(x, f"<u{width}"))
                n += len(held[-1])
                if n >= BLOCK_TOKENS:
                    yield block()
                    docs, held, n, seq, before = [], [], 0, seq + 1, before + n
        if docs:
            yield block()

    schema = "part int, seq int, before long, doc_id array<bigint>, doc_tokens array<bigint>, checkpoints array<bigint>, n_tokens long, payload binary"
    tokens.withColumn("of", F.xxhash64("ids")).repartitionByRange("doc_id", "of").sortWithinPartitions("doc_id", "of", "ids").select("doc_id", "ids").mapInArrow(encode, schema).write.parquet(f"{folder}/blocks")
    # one row for each part of the files
    parts = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toArrow()
    n = parts["n"].to_numpy().astype(np.int64)
    spark.createDataFrame(pa.table({"part": parts["part"].to_numpy().astype(np.int32), "first_token": np.cumsum(n) - n})).coalesce(1).write.parquet(f"{folder}/parts")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), ids (binary, little-endian unsigned 32-bit) from a file set."""
    book = spark.read.parquet(f"{folder}/codebook").orderBy("id").toArrow()
    parts = spark.read.parquet(f"{folder}/parts").toArrow()
    shared = spark.sparkContext.broadcast((book["id"].to_numpy(), book["length"].to_numpy(), dict(zip(parts["part"].to_pylist(), parts["first_token"].to_pylist(), strict=True))))
    small_batches(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_copies()
        ids, lengths, first = shared.value
        code = Code(ids, lengths)
        for batch in batches:
            part, before, docs, tokens, checkpoints, n, payload = batch.columns
            blocks = code.decode(payload.to_pylist(), [np.asarray(x, np.int64) for x in checkpoints.to_pylist()], n.to_numpy())
            for p, b, d, k, x in zip(part.to_pylist(), before.to_pylist(), docs.to_pylist(), tokens.to_pylist(), blocks, strict=True):
                ends = np.cumsum(np.array(k, np.int64))
                offsets = np.concatenate([[0], ends])
                bytes_ = x.astype("<u4").tobytes()
                values = pa.array([bytes_[4 * s : 4 * e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(first[p] + b + offsets[:-1]), values], ["doc_id", "start", "ids"])

    columns = ("part", "before", "doc_id", "doc_tokens", "checkpoints", "n_tokens", "payload")
    return spark.read.parquet(f"{folder}/blocks").select(*columns).mapInArrow(decode, "doc_id long, start long, ids binary")


def crc_of_ids(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows of read_token_files()."""
    return df.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_files(df: DataFrame, path: str, end: int, folder: str) -> None:
    """Tokenize once into a shared folder, count, write the file set, and drop the tokens."""
    spark = df.sparkSession
    tokens = shared_dir(spark, "tokens")
    found = tokenized(df, path, end)
    with batches_of(spark, 2000):
        found.write.option("compression", "zstd").parquet(tokens)
    write_token_files(spark.read.parquet(tokens), folder, id_width(path, end))
    remove_dir(spark, tokens)


__all__ = ["Code", "code_lengths", "crc_of_ids", "id_counts", "read_token_files", "token_files", "tokenized", "write_token_files"]
