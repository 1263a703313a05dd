"""Embedding: an interface, models' prefixes, and a deterministic feature-hashing embedder."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class EmbedderConfig:
    model: str
    batch_size: int = 32
    min_batch_size: int = 1
    max_length: int = 1024


# The models an index may name.
REGISTRY = {
    "AITeamVN/Vietnamese_Embedding_v2": EmbedderConfig("AITeamVN/Vietnamese_Embedding_v2", 32),
    "Qwen/Qwen3-Embedding-4B": EmbedderConfig("Qwen/Qwen3-Embedding-4B", 16),
    "BAAI/bge-m3": EmbedderConfig("BAAI/bge-m3", 32),
}


def embedder_config(model: str) -> EmbedderConfig:
    """The registered configuration, or a generic one."""
    return REGISTRY.get(model, EmbedderConfig(model))


# Fixed value: what that family of models puts before a question.
QWEN3_QUERY = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:"


def prefixed(text: Column, model: str, is_query: bool) -> Column:
    """What a model wants before its texts: e5 names take query and passage marks, Qwen3 embeddings a prompt before queries."""
    if "e5" in model.lower():
        return F.concat(F.lit("query: " if is_query else "passage: "), text)
    if "qwen3-embedding" in model.lower() and is_query:
        return F.concat(F.lit(QWEN3_QUERY), text)
    return text


@functools.lru_cache(maxsize=4)
def loaded(make: Callable[[], Callable[[list[str]], np.ndarray]]):
    """One model in each Python worker."""
    return make()


def encode_with_retry(encode: Callable[[list[str]], np.ndarray], texts: list[str], config: EmbedderConfig) -> np.ndarray:
    """Batches halve when memory runs out, down to the least size."""
    size, out, at = config.batch_size, [], 0
    while at < len(texts):
        try:
            out.append(np.asarray(encode(texts[at : at + size]), np.float32))
            at += size
        except MemoryError:
            if size <= config.min_batch_size:
                raise
            size = max(config.min_batch_size, size // 2)
    return np.concatenate(out) if out else np.zeros((0, 0), np.float32)


def embedder(make: Callable[[], Callable[[list[str]], np.ndarray]], config: EmbedderConfig, null_on_error: bool = False) -> Callable[[Column], Column]:
    """A column function from any model: make() builds it once a worker. A failed batch is an error, or, if so asked, has null vectors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        try:
            vectors = encode_with_retry(loaded(make), [t or "" for t in texts], config)
        except Exception:
            if not null_on_error:
                raise
            return pd.Series([None] * len(texts), index=texts.index, dtype=object)
        return pd.Series(list(vectors), index=texts.index)

    return embed


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """Signed feature hashing of words and word pairs, unit length: deterministic, for tests and plans without a model."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = WORD.findall((text or "").lower())
            for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return pd.Series(list(out / np.where(norm == 0, 1, norm)))

    return embed


def embedded(df: DataFrame, embed: Callable[[Column], Column], text: str = "text", model: str = "", is_query: bool = False) -> DataFrame:
    return df.withColumn("embedding", embed(prefixed(F.col(text), model, is_query)))
