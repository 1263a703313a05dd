"""BPE encoding and decoding by per-prefix dynamic programming over a suffix automaton of the vocabulary.

For every prefix of a pre-token, BPE's result ends in one certain token: the only vocabulary token that is a suffix
of the prefix and whose pair with the last token of the shorter prefix is compatible, that is, BPE of the two
tokens' joined text is exactly these two. A suffix automaton of all tokens yields, for each prefix, the tokens that
are its suffixes; the table of last tokens is filled from left to right, and back-pointers give the ids.

Defined results: a null text counts as empty and has no ids; an unknown id raises an error when decoded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import Recent, list_array, small_batches, trim, utf8, worker_copy

END = "</w>"
#: What the tokenizer's \s matches (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHED_CHUNKS = 400_000
#: Lower-case letters on whose class and form no library disagrees.
PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
GAP = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def spread(texts: pa.Array) -> pa.Array:
    """The texts with ASCII in lower case and a space between a letter and a full stop or comma that ends a word.

    Neither changes any id: the tokenizer lower-cases, and letters and symbols are never in one pre-token. Texts
    that may hold a special token's string keep their case.
    """
    data, offsets = utf8(texts)
    if not len(data):
        return texts
    mark = (data == 44) | (data == 46)
    at = np.flatnonzero(mark[1:-1] & GAP[data[2:]]) + 1
    before, second = data[at - 1], data[np.maximum(at - 2, 0)]
    latin = (second == 0xC3) & (at >= 2) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7)
    at = at[(LETTER[before] | latin) & ~np.isin(at, offsets)]
    data = np.insert(data, at, 32) if len(at) else data
    offsets = offsets + np.searchsorted(at, offsets, "left")
    if b"<|" not in (raw := data.tobytes()):
        raw = LOWER[data].tobytes()
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


class Chunks:
    """Ids of stretches between white space, which no token crosses, kept from batch to batch.

    stems(list of lower-case letter runs) and whole(list of other stretches) give ids as little-endian 32-bit integers.
    """

    def __init__(self, stems, whole, limit: int = CACHED_CHUNKS):
        self.stems, self.whole, self.known = stems, whole, Recent(limit)

    def make(self, chunks: list[str]) -> list[bytes]:
        plain = [PLAIN.fullmatch(c) is not None for c in chunks]
        stems, others = [c for c, p in zip(chunks, plain, strict=True) if p], [c for c, p in zip(chunks, plain, strict=True) if not p]
        made, rest = iter(self.stems(stems) if stems else ()), iter(self.whole(others) if others else ())
        return [next(made if p else rest) for p in plain]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts end to end, and the n + 1 offsets; null counts as empty."""
        lists = pc.ascii_split_whitespace(spread(texts))
        split = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        parts = self.known.get(coded.dictionary.to_pylist(), self.make)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = pool[np.repeat(starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        return flat, ends[split - split[0]]


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where it prints, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class SuffixAutomaton:
    """Accepts every substring of the given words; for each state, the words that end there.

    Transitions are in one dict under state * width + symbol, so that its size stays near its contents.
    """

    def __init__(self, words: dict[tuple[int, ...], int], width: int):
        self.width, self.next, self.link, self.length, self.out = width, {}, [-1], [0], [()]
        for word in words:
            last = 0
            for symbol in word:
                last = self._extend(last, symbol)
        at: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for word, token in words.items():
            state = 0
            for symbol in word:
                state = self.next[state * width + symbol]
            at[state].append((len(word), token))
        # the nearest state by suffix links, itself first, at which words end
        self.words = [tuple(sorted(x, reverse=True)) for x in at]
        self.up = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[state]
            self.up[state] = above if self.words[above] else self.up[above]
        del self.out, self.symbols

    def _add(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.symbols.append([])
        return len(self.link) - 1

    symbols: list[list[int]]

    def _extend(self, last: int, symbol: int) -> int:
        if not hasattr(self, "symbols"):
            self.symbols = [[]]
        width, nxt, link, length = self.width, self.next, self.link, self.length
        there = nxt.get(last * width + symbol)
        if there is not None:
            if length[last] + 1 == length[there]:
                return there
            return self._clone(last, there, symbol)
        new = self._add(length[last] + 1, 0)
        while last != -1 and last * width + symbol not in nxt:
            nxt[last * width + symbol] = new
            self.symbols[last].append(symbol)
            last = link[last]
        if last != -1:
            there = nxt[last * width + symbol]
            link[new] = there if length[last] + 1 == length[there] else self._clone(last, there, symbol)
        return new

    def _clone(self, last: int, there: int, symbol: int) -> int:
        width, nxt, link, length = self.width, self.next, self.link, self.length
        clone = self._add(length[last] + 1, link[there])
        self.symbols[clone] = list(self.symbols[there])
        for s in self.symbols[there]:
            nxt[clone * width + s] = nxt[there * width + s]
        link[there] = clone
        while last != -1 and nxt.get(last * width + symbol) == there:
            nxt[last * width + symbol] = clone
            last = link[last]
        return clone


def parts_at_word_ends(path: str) -> bool:
    """Whether a tokenizer's file has the form that stretches rely on: BPE with END, NFC, white space as one and lower case, and letters parted from symbols."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [(x or {}).get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = [x["pattern"]["Regex"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split" and "Regex" in x["pattern"]]
    model = spec["model"]
    return model.get("type") == "BPE" and model.get("end_of_word_suffix") == END and steps == ["NFC", "Replace", "Lowercase"] and len(split) == 1 and r"[\p{L}]+" in split[0]


class Bpe:
    """A tokenizer file with BPE whose words end in END, its normaliser NFC, white space and lower case."""

    def __init__(self, path: str):
        if not parts_at_word_ends(path):
            raise ValueError(f"{path} isn't a lower-case BPE whose words end in {END}")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.texts = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts |= {i: t for t, i in self.special.items()}
        self.pool = pa.array([self.texts.get(i) for i in range(max(self.texts) + 1)], pa.string())
        self.letters = byte_letters()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", SPACE))
        # merges by rank: the pair's result and, for each token, the pair that makes it
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merged.setdefault((x, y), (rank, z))
            self.made.setdefault(z, (rank, x, y))
        self.compatible: dict[int, bool] = {}
        symbols: dict[str, int] = {}
        words: dict[tuple[int, ...], int] = {}
        for text, token in self.vocab.items():
            if token not in self.made and text.removesuffix(END) and len(text.removesuffix(END)) == 1:
                symbols.setdefault(text, len(symbols))
        self.symbols = symbols
        self.inner = [symbols[self.letters[b]] for b in range(256)]
        self.final = [symbols[self.letters[b] + END] for b in range(256)]
        for text, token in self.vocab.items():
            if (units := self.units(text)) and self.own(token):
                words[tuple(symbols[u] for u in units)] = token
        self.automaton = SuffixAutomaton(words, len(symbols))
        self.chunks = Chunks(lambda stems: [np.array(self.word(s), "<u4").tobytes() for s in stems], lambda other: [np.array(self.chunk(c), "<u4").tobytes() for c in other], CACHED_CHUNKS // 4)

    def units(self, text: str) -> list[str]:
        body = text[: -len(END)] if text.endswith(END) and len(text) > len(END) else text
        out = list(body)
        if body is not text and out:
            out[-1] += END
        return out if all(u in self.symbols for u in out) else []

    def own(self, token: int) -> bool:
        """Whether BPE of the token's text is the token itself."""
        if token not in self.made:
            return True
        _, a, b = self.made[token]
        return self.own(a) and self.own(b) and self.pair(a, b, allow=self.made[token][0])

    def edge(self, token: int, right: bool) -> list[tuple[int, int, float]]:
        """The subtokens at one edge from the largest down, each with the ranks between which it stands there."""
        out, until = [], float("inf")
        while True:
            since = self.made[token][0] if token in self.made else -1
            out.append((token, since, until))
            if token not in self.made:
                return out
            until, token = since, self.made[token][2 if right else 1]

    def pair(self, a: int, b: int, allow: int | None = None) -> bool:
        """Whether BPE leaves tokens a and b apart when their texts are joined (allow: up to the merge of that rank).

        Both sides are merged as on their own until a merge across the border comes first. While that hasn't
        happened, the left side's right edge and the right side's left edge each pass through known subtokens; a
        merge across the border of rank r happens if its two subtokens stand at the border when rank r is next.
        """
        for x, x_since, x_until in self.edge(a, True):
            for y, y_since, y_until in self.edge(b, False):
                across = self.merged.get((x, y))
                if across is None or (allow is not None and across[0] >= allow and (x, y) == (a, b)):
                    continue
                rank = across[0]
                # x and y stand side by side from the later of their makings on; x is used up by a merge of rank
                # x_until inside a, y by y_until inside b. The leftmost of equal ranks comes first: a's own before
                # the border's, the border's before b's own.
                if rank < x_until and rank <= y_until:
                    return False
        return True

    def word(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        data = piece.encode("utf-8", "surrogatepass")
        text = [self.inner[b] for b in data]
        text[-1] = self.final[data[-1]]
        a, n = self.automaton, len(text)
        nxt, link, length, words, up, width = a.next, a.link, a.length, a.words, a.up, a.width
        known, fits = self.compatible, self.fits
        last, size, state, matched = [-1] * (n + 1), [0] * (n + 1), 0, 0
        for i, symbol in enumerate(text, 1):
            there = nxt.get(state * width + symbol)
            while there is None and state:
                state = link[state]
                matched = length[state]
                there = nxt.get(state * width + symbol)
            if there is not None:
                state, matched = there, matched + 1
            at = state
            while last[i] < 0:
                for k, token in words[at]:
                    if k == i and k <= matched:
                        last[i], size[i] = token, k
                        break
                    if k <= matched and (before := last[i - k]) >= 0:
                        fit = known.get(before << 32 | token)
                        if fit or (fit is None and fits(before, token)):
                            last[i], size[i] = token, k
                            break
                if not at:
                    break
                at = up[at]
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 200_000:
                self.compatible.clear()
            known = self.compatible[key] = self.pair(a, b)
        return known

    def chunk(self, text: str) -> list[int]:
        """The ids of a stretch of text; white space in it only parts tokens."""
        out: list[int] = []
        for part in self.split_special.split(text) if self.split_special and "<" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if part.isascii():
                    part = part.lower()
                else:
                    part = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
                for piece in self.pieces.findall(part):
                    out += self.word(piece)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of one text, without the caches."""
        return [i for c in text.split(" ") if c for i in self.chunk(c)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.texts.__getitem__, ids))


def loaded(path: str) -> Bpe:
    """One copy in each Python worker."""
    return worker_copy(("bpe", path), lambda: Bpe(path))


def bpe_encode(text: Column | str, path: str) -> Column:
    """Column of array<int>: the ids of each whole text."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path)
        for texts in batches:
            ids, offsets = bpe.chunks.ids(texts)
            yield list_array(ids.astype(np.int32), offsets)
            trim()

    return encode(text)


def bpe_decode(ids: Column | str, path: str) -> Column:
    """Column of string: the tokens' texts joined by one space, special tokens too."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pool = loaded(path).pool
        for lists in batches:
            texts = pool.take(lists.flatten())
            if texts.null_count:
                raise ValueError("an id that isn't in the vocabulary")
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.concat_arrays([lists.offsets]), texts), " ")
            yield pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.string()))

    return decode(ids)


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with columns ids and decoded in place of text and of columns of these names; a null text is empty; other columns and every row are kept."""
    small_batches(df.sparkSession)
    return df.withColumn("ids", bpe_encode(F.col(text), path)).withColumn("decoded", bpe_decode("ids", path)).drop(text)
