"""Bloom filters over 64-bit hashes, cut into shards by hash, so that a task makes only its own shards' and the size of all
together can be bounded. A filter that is full says yes too often, never no by mistake."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import cut

#: Bits of a filter for each hash it is made for, and bits set for each.
BITS, PROBES = 12, 5
SHARDS = 64


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers for each hash in a filter of a power of two bits."""
    h = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


class Bloom:
    def __init__(self, bits: int, words: np.ndarray | None = None) -> None:
        self.bits = bits
        self.words = np.zeros(bits // 8, np.uint8) if words is None else words

    def add(self, hashes: np.ndarray) -> None:
        p = positions(hashes, self.bits).ravel()
        np.bitwise_or.at(self.words, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        p = positions(hashes, self.bits)
        return ((self.words[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def halved(self, most: int) -> Bloom:
        """At most so many bits, by OR of halves. Nothing held is lost."""
        bits, words = self.bits, self.words
        while bits > max(most, 64):
            bits //= 2
            words = words[: len(words) // 2] | words[len(words) // 2 :]
        return Bloom(bits, words)

    def folded(self) -> Bloom:
        """Halved while under a fifth of the bits are set."""
        one = self
        while one.bits > 64 and np.bitwise_count(one.words).sum() * 5 < one.bits // 2:
            one = one.halved(one.bits // 2)
        return one


class Filter:
    """Whether hashes are among those that the filters of all shards, (shard, bits, words), were given."""

    def __init__(self, shards: int, parts: list[tuple[int, int, bytes]]) -> None:
        self.shards = shards
        self.by = {shard: Bloom(bits, np.frombuffer(words, np.uint8)) for shard, bits, words in parts}

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(hashes), bool), hashes % np.uint64(self.shards)
        order = np.argsort(shard, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(shard[order])) + 1), len(order)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b and (one := self.by.get(int(shard[order[a]]))):
                out[order[a:b]] = one.holds(hashes[order[a:b]])
        return out


def sharded(hashes: DataFrame, limit: int) -> tuple[int, list[tuple[int, int, bytes]]]:
    """What `Filter` takes, for the hashes (one long column, each once), of at most `limit` bytes whatever their number."""
    hashes = cut(hashes.toDF("h"))
    wanted = int(np.ceil(np.log2((hashes.count() // SHARDS + 1) * BITS)))
    bits = min(1 << max(10, wanted), 1 << max(6, (limit * 8 // SHARDS).bit_length() - 1))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array((h.to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(SHARDS)).astype(np.int32)), h], names=["shard", "h"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All filters of a task are within the limit, too.
        own: dict[int, Bloom] = {}
        for batch in batches:
            shard, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for k in np.unique(shard):
                own.setdefault(int(k), Bloom(bits)).add(h[shard == k].view(np.uint64))
        for k, one in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([one.words.tobytes()], pa.binary())], names=["shard", "words"])

    rows = hashes.mapInArrow(dealt, "shard int, h long").repartition("shard").mapInArrow(filled, "shard int, words binary")
    return SHARDS, [(r["shard"], bits, bytes(r["words"])) for r in rows.collect()]
