"""Feature-hashed embeddings as a hook over batches of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.batches import pieces

DIMS = 256


def _codes(features: list[str]) -> np.ndarray:
    """Each feature's cell, times two, and one more if its sign is minus; by its SHA-256."""
    sha = hashlib.sha256
    digests = np.frombuffer(b"".join([sha(x.encode()).digest() for x in features]), np.uint8).reshape(-1, 32)
    return (digests[:, :4].copy().view(">u4")[:, 0] % DIMS).astype(np.int64) * 2 + digests[:, 4] % 2


def hash_embed(texts: list[str]) -> list[np.ndarray]:
    """Unit vectors of hashed words (weight 1) and word pairs (weight 0.5); a text without words gives the zero vector.

    Each distinct word and pair of the texts is hashed once.
    """
    told = [(text or "").lower().split() for text in texts]
    of = np.repeat(np.arange(len(told)), [len(words) for words in told])
    if not len(of):
        return [np.zeros(DIMS) for _ in texts]
    encoded = pa.array(list(chain.from_iterable(told)), pa.string()).dictionary_encode()
    words, at = encoded.dictionary.to_pylist(), encoded.indices.to_numpy().astype(np.int64)
    inside = of[1:] == of[:-1]
    pairs, pair = np.unique((at[:-1] * len(words) + at[1:])[inside], return_inverse=True)
    names = [f"{words[a]} {words[b]}" for a, b in zip((pairs // len(words)).tolist(), (pairs % len(words)).tolist(), strict=True)]
    codes = _codes(words + names)
    codes = np.concatenate((codes[at], codes[len(words) + pair]))
    weights = np.where(codes & 1, -1.0, 1.0)
    weights[len(at) :] *= 0.5
    cells = np.concatenate((of, of[1:][inside])) * DIMS + (codes >> 1)
    found = np.bincount(cells, weights=weights, minlength=len(told) * DIMS).reshape(-1, DIMS)
    norms = [np.linalg.norm(v) for v in found]
    return [v / norm if norm else v for v, norm in zip(found, norms, strict=True)]


def vector_lists(vectors: list) -> pa.Array:
    """Vectors as an Arrow column of doubles; None is null."""
    return pa.array([v.astype(np.float64) if isinstance(v, np.ndarray) else v for v in vectors], pa.list_(pa.float64()))


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[np.ndarray]] = hash_embed) -> DataFrame:
    """key and embedding; embed gets a bounded piece of an Arrow batch's texts at a time, in search form."""

    def each(batches):
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), vector_lists(embed(batch.column("text").to_pylist()))], names=["key", "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("key"), t.search_text(F.col(text)).alias("text")).mapInArrow(each, f"key {kind}, embedding array<double>")
    return found.withColumnRenamed("key", key)
