"""Hashes in 64-bit unsigned arithmetic, vectorised."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 64
# Fixed value: the multiplier that the method's paper gives.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hashing (Lamping and Veach 2014)."""
    key = keys.astype(np.uint64)
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while (going := j < buckets).any():
        b[going] = j[going]
        key[going] = key[going] * _MULTIPLIER + np.uint64(1)
        scale = (key[going] >> np.uint64(33)).astype(np.float64) + 1
        j[going] = ((b[going] + 1) * (float(1 << 31) / scale)).astype(np.int64)
    return b


def shard_of(record_id: Column, shards: int = SHARDS) -> Column:
    @F.arrow_udf(T.IntegerType())
    def shard(ids: pa.Array) -> pa.Array:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array(jump(known, shards), pa.int32(), mask=np.asarray(ids.is_null()))

    return shard(record_id.cast("long"))


def leaf_hash(centroid: list[float], count: int, cluster_id: int) -> bytes:
    """Of a cluster: little-endian 32-bit floats, then count and id in 64 bits."""
    return hashlib.sha256(struct.pack(f"<{len(centroid)}fQQ", *centroid, count, cluster_id)).digest()


def parent_hash(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(left + right).digest()


def text_vector(text: str, dim: int) -> list[float]:
    """A deterministic unit vector: the first min(dim, 32) bytes of the text's SHA-256."""
    v = np.frombuffer(hashlib.sha256(text.encode()).digest()[: min(dim, 32)], np.uint8).astype(float)
    return (v / np.linalg.norm(v)).tolist()


__all__ = ["SHARDS", "jump", "leaf_hash", "parent_hash", "shard_of", "text_vector"]
