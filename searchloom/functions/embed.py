"""The lexical embedder and the chunker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The FNV-1a hash of 64 bits, and the weights of words and of character trigrams.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
WORD_WEIGHT, TRIGRAM_WEIGHT = 1.0, 0.35


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def embed_text(text: str, dims: int = 256) -> list[float]:
    """Hashed words and padded trigrams, of unit length; a text without words is the zero vector."""
    v = np.zeros(dims)
    for w in re.findall(r"\w+", (text or "").lower()):
        padded = f"#{w}#"
        for token, weight in [(w, WORD_WEIGHT), *[(padded[i : i + 3], TRIGRAM_WEIGHT) for i in range(len(padded) - 2)]]:
            h = fnv1a(token.encode())
            v[h % dims] += weight if not h >> 63 else -weight
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(c: Column, dims: int = 256) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: embed_text(t, dims))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(c)


def embed_with(c: Column, factory: Callable[[], Callable[[list[str]], np.ndarray]], kind: str = "array<float>") -> Column:
    """Vectors of any model. ``factory`` is called once per worker and gives a function from a list of texts to one vector each; null texts stay null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            out: list = [None] * len(s)
            there = [i for i, t in enumerate(s) if t is not None]
            for i, v in zip(there, model([s.iloc[i] for i in there]) if there else []):
                out[i] = [float(x) for x in v]
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)(c)


def onnx_factory(model_path: str, tokenizer_path: str, output: int = 0) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A factory for :func:`embed_with`: an ONNX text encoder with its tokenizer file; token vectors are averaged over the text and scaled to length 1. Both files must be where the workers can read them."""

    def factory():
        import onnxruntime
        from tokenizers import Tokenizer

        tokens = Tokenizer.from_file(tokenizer_path)
        tokens.enable_padding()
        session = onnxruntime.InferenceSession(model_path)
        names = {i.name for i in session.get_inputs()}

        def model(texts: list[str]) -> np.ndarray:
            coded = tokens.encode_batch(texts)
            mask = np.array([c.attention_mask for c in coded], dtype=np.int64)
            given = {"input_ids": np.array([c.ids for c in coded], dtype=np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            y = session.run(None, {k: v for k, v in given.items() if k in names})[output]
            if y.ndim == 3:
                y = (y * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
            return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

        return model

    return factory


def chunk_text(text: str, size: int = 1000, overlap: int = 100) -> list[tuple[int, int, str]]:
    """(start, end, text) of chunks. A break is looked for in the last quarter: after a sentence or line, else at a blank."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + size)
        if end < n:
            low = max(at + 1, end - size // 4)
            cut = max((m.end() for m in re.finditer(r"[.!?] |\n", text[low:end])), default=-1)
            if cut < 0:
                cut = max((m.end() for m in re.finditer(r"\s", text[low:end])), default=-1)
            if cut > 0:
                end = low + cut
        piece = text[at:end]
        if piece.strip():
            out.append((at, end, piece))
        if end >= n:
            break
        at = max(end - overlap, at + 1)
    return out


def chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """One row per chunk: key, ``ordinal``, ``start``, ``end``, ``chunk``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, s, e, c) for k, t in zip(b["k"], b["t"]) for i, (s, e, c) in enumerate(chunk_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["k", "ordinal", "start", "end", "chunk"])

    out = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, ordinal int, start int, end int, chunk string")
    return out.withColumnRenamed("k", key)
