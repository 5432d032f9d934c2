"""Pluggable models. The built-in ones are deterministic and need no network."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

X = TypeVar("X")


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class LLM(Protocol):
    def prompt(self, text: str) -> str: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: Sequence[str]) -> list[float]: ...


class OCR(Protocol):
    def read(self, image: bytes) -> str: ...


class Unavailable(RuntimeError):
    """An answer worth another try: too many requests, or a fault of the server."""


def retried(call: Callable[[], X], tries: int = 5, base: float = 0.2, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> X:
    """The call's result after up to ``tries`` attempts, waiting ``base * 2**i`` and a jitter between them."""
    for i in range(tries):
        try:
            return call()
        except Unavailable:
            if i + 1 == tries:
                raise
            sleep(base * 2**i + base * jitter())
    raise AssertionError


class HashingEmbedder:
    """Signed hashing of words into a unit vector; equal texts have equal vectors everywhere."""

    name = "hashing"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[(h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
            length = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / length for x in v])
        return out


class EchoLLM:
    """Answers by a function of the prompt, its last line by default."""

    def __init__(self, answer: Callable[[str], str] = lambda t: t.rsplit("\n", 1)[-1]):
        self.answer = answer

    def prompt(self, text: str) -> str:
        return self.answer(text)


class OverlapReranker:
    """Share of the query's words that a text holds."""

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hashing": HashingEmbedder}


def embedded(df: DataFrame, embedder: Embedder, text: str = "content", out: str = "embedding") -> DataFrame:
    """The frame with a vector of each text; a null or empty text is embedded as ``<no content>``. Calls are made a batch at a time, with retries."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(retried(lambda texts=texts: embedder.embed(texts.tolist())))

    return df.withColumn(out, embed(F.coalesce(F.when(F.col(text) != "", F.col(text)), F.lit("<no content>"))))


def embedded_with(df: DataFrame, embed: Callable[[Sequence[str]], list[list[float]]], text: str, out: str) -> DataFrame:
    """The frame with a vector of each text by a function of texts."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(retried(lambda: embed(texts.fillna("").tolist())))

    return df.withColumn(out, vectors(text))
