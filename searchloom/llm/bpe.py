"""Byte-pair encoding of whole tables with a public rank file.

Each pre-token's bytes form a linked list. Every adjacent pair that the vocabulary knows waits in the bucket of its
merge rank; which buckets are non-empty is kept in a two-level bitmap, so the next rank is found by two find-first-set
steps instead of a search over the pairs. A merge changes two neighbouring pairs only; entries that a merge has made
stale are recognised when they are taken out. A pre-token of n bytes costs O(n log n) at worst, however long it is.

Defined results: null and empty texts give the empty list; blank texts are encoded as they stand; text that looks like
a special token is ordinary text; lone surrogates can't occur in Spark strings. Columns other than the key columns and
the text are dropped, so clashing names can't arise.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the rank file of byte_bpe_50k lies unless the caller says otherwise.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of the public vocabulary, which splits text into pre-tokens before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens remembered by a worker, and the most bytes of one that is remembered.
CACHE_ENTRIES, CACHE_BYTES = 200_000, 64
#: Bits of one bitmap word. Python integers of this size are a few machine words long.
WORD = 256


class RankQueue:
    """Positions ordered by rank, then by position. Push and pop touch one word of each bitmap level."""

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // WORD + 1)
        self.summary = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            w = rank // WORD
            self.words[w] |= 1 << (rank % WORD)
            self.summary |= 1 << w
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank and its leftmost position; None when empty."""
        s = self.summary
        if not s:
            return None
        w = (s & -s).bit_length() - 1
        word = self.words[w]
        low = word & -word
        rank = w * WORD + low.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            word ^= low
            self.words[w] = word
            if not word:
                self.summary = s & (s - 1)
        return rank, position


class Encoder:
    """Encodes text by a vocabulary of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(piece)
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        known, queue = self.ranks.get, self.queue
        nxt = list(range(1, n + 2))  # where the part at i ends
        prv = list(range(-1, n))
        pair = [-1] * (n + 1)  # rank of the pair that starts at i; -1 for none
        for i in range(n - 1):
            r = known(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                queue.push(r, i)
        while (top := queue.pop()) is not None:
            rank, i = top
            if pair[i] != rank:
                continue  # a merge of one of its parts came first
            j = nxt[i]
            k = nxt[j]
            nxt[i] = k
            prv[k] = i
            pair[j] = -1
            if k < n:
                r = known(piece[i : nxt[k]])
                if r is None:
                    pair[i] = -1
                else:
                    pair[i] = r
                    queue.push(r, i)
            else:
                pair[i] = -1
            h = prv[i]
            if h >= 0:
                r = known(piece[h:k])
                if r is None:
                    pair[h] = -1
                elif r != pair[h]:
                    pair[h] = r
                    queue.push(r, h)
        out, i = [], 0
        while i < n:
            j = nxt[i]
            out.append(known(piece[i:j]) if j - i > 1 else self.single[piece[i]])
            i = j
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8"))
                if len(piece) <= CACHE_BYTES:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = tuple(ids)
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder_of(data: bytes) -> Encoder:
    """The encoder of a rank file's content; made once per worker."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return Encoder({base64.b64decode(a): int(b) for a, b in pairs})


def load_encoder(path: str) -> Encoder:
    """The encoder of a rank file."""
    return encoder_of(_content(path))


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _out_schema(df: DataFrame, keys: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField(name, kind, False)])


def encode_table(df: DataFrame, text: str = "text", keys: list[str] | None = None, out: str = "ids", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """The key columns and ``out``, the token ids of the text. One pass over the rows, no shuffle."""
    keys = keys or ["doc_id"]
    n_keys = len(keys)
    ranks = df.sparkSession.sparkContext.broadcast(_content(ranks_path))  # only the driver needs the file, of about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks.value)
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for t in b.column(n_keys).to_pylist():
                flat += enc.encode(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], ids], names=[*keys, out])

    return df.select(*[f"`{c}`" for c in [*keys, text]]).mapInArrow(run, _out_schema(df, keys, out, T.ArrayType(T.IntegerType(), False)))


def count_tokens(df: DataFrame, text: str = "text", keys: list[str] | None = None, out: str = "n_tokens", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """The key columns and ``out``, the number of tokens of the text; 0 for null and empty texts."""
    keys = keys or ["doc_id"]
    n_keys = len(keys)
    ranks = df.sparkSession.sparkContext.broadcast(_content(ranks_path))  # only the driver needs the file, of about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks.value)
        for b in batches:
            sizes = pa.array([len(enc.encode(t)) for t in b.column(n_keys).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], sizes], names=[*keys, out])

    return df.select(*[f"`{c}`" for c in [*keys, text]]).mapInArrow(run, _out_schema(df, keys, out, T.IntegerType()))
