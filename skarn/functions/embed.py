"""Embedding providers and their application to chunk tables."""

from __future__ import annotations

import json
import urllib.request
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skarn.operators.chunks import embedding_text

BATCH = 100
#: Fixed dimensions that the models offer; the first is the default.
MODELS = {"text-embedding-3-small": (512, 1536), "text-embedding-3-large": (256, 1024, 3072), "text-embedding-ada-002": (1536,)}


class Provider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def checked_dimension(model: str, dimension: int = 0) -> int:
    """The dimension to ask for: the model's first for 0; a ValueError for a model or dimension that doesn't exist."""
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    if not dimension:
        return MODELS[model][0]
    if dimension not in MODELS[model]:
        raise ValueError(f"{model} has no dimension {dimension}; it has {', '.join(map(str, MODELS[model]))}")
    return dimension


class HashingProvider:
    """Deterministic offline embedding: signed feature hashing of words and word pairs, of unit length."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        from zlib import crc32

        out = []
        for text in texts:
            vector = np.zeros(self.dimension)
            words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
            for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                h = crc32(feature.encode())
                vector[h % self.dimension] += 1.0 if h >> 31 else -1.0
            norm = np.linalg.norm(vector)
            out.append((vector / norm if norm else vector).astype(np.float32).tolist())
        return out


class HttpProvider:
    """An embedding service with the common JSON interface; errors aren't retried."""

    def __init__(self, url: str, key: str, model: str = "text-embedding-3-small", dimension: int = 0, timeout: float = 30.0):
        self.url, self.key, self.model, self.timeout = url, key, model, timeout
        self.dimension = checked_dimension(model, dimension)

    def payload(self, texts: list[str]) -> dict:
        body = {"input": texts, "model": self.model}
        return body | ({"dimensions": self.dimension} if self.model.startswith("text-embedding-3") else {})

    def embed(self, texts: list[str]) -> list[list[float]]:
        request = urllib.request.Request(self.url, json.dumps(self.payload(texts)).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            rows = json.load(answer)["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


def embedded(chunks: DataFrame, provider: Provider, batch: int = BATCH, text: Column | None = None) -> DataFrame:
    """``chunks`` with an embedding of ``text`` (the chunk's embedding text): ``batch`` texts go to the provider at once, within an Arrow batch."""

    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        out = []
        for i in range(0, len(texts), batch):
            vectors = provider.embed(texts[i : i + batch])
            if any(len(v) != provider.dimension for v in vectors):
                raise ValueError("the provider returned another dimension than it states")
            out += vectors
        return pa.array(out, pa.list_(pa.float32()))

    return chunks.withColumn("embedding", F.arrow_udf(run, "array<float>")(embedding_text() if text is None else text))
