"""A small encoder of names: mean-pooled character n-gram embeddings trained with a cosine contrastive loss, in numpy on the driver."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def buckets(text: str | None, n: int, size: int) -> list[int]:
    padded = f" {(text or '').lower()} "
    return [zlib.crc32(padded[i : i + n].encode("utf-8", "surrogatepass")) % size for i in range(max(1, len(padded) - n + 1))]


@dataclass
class PooledEncoder:
    """table: one row a bucket."""

    table: np.ndarray
    n: int = 3

    def vector(self, text: str | None) -> np.ndarray:
        v = self.table[buckets(text, self.n, len(self.table))].mean(axis=0)
        norm = np.linalg.norm(v)
        return v / norm if norm else v

    def embed(self, c: Column) -> Column:
        """Unit vectors of a text column, in Arrow batches."""
        own = self

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: own.vector(t).tolist())

        return run(c)


def train_encoder(left: Sequence[str], right: Sequence[str], labels: Sequence[int], *, dim: int = 32, size: int = 1 << 14, n: int = 3, epochs: int = 5, rate: float = 0.2, margin: float = 0.3, seed: int = 42) -> PooledEncoder:
    """Stochastic gradient steps over pairs: the loss is 1 - cosine for label 1, and how far the cosine passes margin for label 0."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0.0, 1.0 / np.sqrt(dim), (size, dim))
    spelled = [(buckets(a, n, size), buckets(b, n, size)) for a, b in zip(left, right, strict=True)]
    for _ in range(epochs):
        for k in rng.permutation(len(spelled)):
            a, b = spelled[k]
            x, y = table[a].mean(axis=0), table[b].mean(axis=0)
            nx, ny = np.linalg.norm(x), np.linalg.norm(y)
            if not nx or not ny:
                continue
            cosine = x @ y / (nx * ny)
            sign = -1.0 if labels[k] else 1.0 if cosine > margin else 0.0
            if not sign:
                continue
            np.add.at(table, a, -rate * sign * (y / (nx * ny) - cosine * x / nx**2) / len(a))
            np.add.at(table, b, -rate * sign * (x / (nx * ny) - cosine * y / ny**2) / len(b))
    return PooledEncoder(table, n)
