"""Embedders: the port, and a deterministic one that needs no model."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.arrow import text_udf

WORD = re.compile(r"\w+")


class Embedder(Protocol):
    """Vectors of one width for documents and queries; an instance is sent to executors."""

    name: str
    dimensions: int

    def documents(self, texts: list[str]) -> np.ndarray: ...

    def query(self, text: str) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of lower-cased words to unit vectors.

    A word's 8-byte BLAKE2b names its coordinate (first four bytes) and sign
    (lowest bit of the fifth). A text without words is the first unit vector.
    """

    name = "deterministic"

    def __init__(self, dimensions: int = 1024) -> None:
        if dimensions < 1:
            raise ValueError("dimensions must be positive")
        self.dimensions = dimensions

    def documents(self, texts: list[str]) -> np.ndarray:
        known: dict[str, tuple[int, float]] = {}
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in WORD.findall(text.lower()):
                if word not in known:
                    d = hashlib.blake2b(word.encode(), digest_size=8).digest()
                    known[word] = (int.from_bytes(d[:4], "big") % self.dimensions, 1.0 if d[4] % 2 else -1.0)
                at, sign = known[word]
                row[at] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out[norm[:, 0] == 0, 0] = 1.0
        return out / np.where(norm == 0, 1.0, norm)

    def query(self, text: str) -> np.ndarray:
        return self.documents([text])[0]


def embed(text: Column, embedder: Embedder) -> Column:
    """An array<float> column of document vectors."""

    @text_udf(T.ArrayType(T.FloatType()))
    def run(texts: pa.Array) -> pa.Array:
        v = embedder.documents([x.as_py() or "" for x in texts]).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, max(1, v.shape[1]), dtype=np.int32)[: len(v) + 1]), pa.array(v.ravel()))

    return run(text)
