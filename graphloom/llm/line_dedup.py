"""Line deduplication with two Bloom filters in front of the exact count.

Three steps. (1) Every task hashes the lines it reads and deals the 8-byte hashes, each once per task or flagged as met
twice there, to shards by hash; there are as many shards as the lines want. A shard keeps a Bloom filter of hashes seen
once and one of hashes seen twice; the second, folded to its load, is its result. All of them together are folded to at
most FILTER_BYTES and broadcast. (2) Lines that the twice-seen filter may hold are suspected repeats; only these are
shuffled, to count documents exactly and choose the occurrence that stays. (3) A filter of the same bound holds the
documents that lose lines; only their texts meet their lost lines by shuffle, all others are finished where they are read.
A full filter lets more through, so beyond some 45 million repeated lines or documents more is shuffled, but nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bloom import BITS, Bloom, Filter, sharded
from graphloom.llm.common import SPACE, binary, cut, pieces

BLANK = SPACE.encode()
#: Bytes of all that is broadcast of a filter.
FILTER_BYTES = 64 << 20
#: Hashes a task holds before it passes them on, and those that a shard is made for.
HOLD, SHARD = 1 << 20, 1 << 19


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def is_long(key: bytes, least: int) -> bool:
    """At least so many code points."""
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def keys_of(text: bytes | None, least: int) -> list[bytes]:
    """The distinct long keys of a text's lines, in order."""
    return list(dict.fromkeys(k for line in (text or b"").split(b"\n") if len(line) >= least and is_long(k := key_of(line), least)))


def hashed(least: int, shards: int):
    """(shard, hash, twice): hashes of the long lines; twice where this task met it in two documents."""

    def passed(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            found, count = np.unique(np.array(held, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((found % np.uint64(shards)).astype(np.int64)), pa.array(found.view(np.int64)), pa.array(count > 1)], names=["shard", "hash", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in pieces(batches):
            for text in binary(batch.column(0)):
                held += map(xxhash.xxh3_64_intdigest, keys_of(text, least))
            if len(held) > HOLD:
                yield from passed(held)
                held = []
        yield from passed(held)

    return run


def filtered(expected: int):
    """The twice-seen filter of each shard in a partition that is sorted by shard."""
    bits = 1 << max(10, int(np.ceil(np.log2(max(1, expected) * BITS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, once, twice = None, None, None

        def done():
            small = twice.folded()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([small.bits], pa.int64()), pa.array([small.words.tobytes()], pa.binary())], names=["shard", "bits", "words"])

        for batch in batches:
            shards, hashes, flags = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            hashes = hashes.view(np.uint64)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != shard:
                    if shard is not None:
                        yield done()
                    shard, once, twice = int(shards[a]), Bloom(bits), Bloom(bits)
                here, count = np.unique(hashes[a:b], return_counts=True)
                again = once.holds(here) | (count > 1) | np.isin(here, hashes[a:b][flags[a:b]])
                twice.add(here[again])
                once.add(here)
        if shard is not None:
            yield done()

    return run


def folded_to(most: int):
    """Filters of at most `most` bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Bloom(b, np.frombuffer(w, np.uint8)) for b, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found = [one.halved(most) for one in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.bits for x in found], pa.int64()), pa.array([x.words.tobytes() for x in found], pa.binary())], names=["shard", "bits", "words"])

    return run


def twice_seen(docs: DataFrame, least: int, limit: int) -> tuple[int, list[tuple[int, int, bytes]]]:
    """The number of shards and their twice-seen filters, at most about `limit` bytes in all."""
    kind = "shard long, bits long, words binary"
    chars = docs.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    # No more lines than code points over the least length, dealt evenly by hash.
    expected = 2 * chars // (least + 1) + 1
    shards = max(64, -(-expected // SHARD))
    dealt = docs.select("text").mapInArrow(hashed(least, shards), "shard long, hash long, twice boolean")
    found = cut(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(filtered(expected // shards + 64), kind))
    while (found.agg(F.sum(F.length("words")).alias("n")).first()["n"] or 0) > limit and (most := found.agg(F.max("bits").alias("n")).first()["n"]) > 64:
        found = cut(found.mapInArrow(folded_to(most // 2), kind))
    return shards, [(r["shard"], r["bits"], bytes(r["words"])) for r in found.collect()]


def suspects_in(least: int, shared):
    """doc_id, row and key of each suspected line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Filter(*shared.value)
        for batch in pieces(batches):
            keys = [keys_of(t, least) for t in binary(batch.column(2))]
            maybe = test(np.fromiter((xxhash.xxh3_64_intdigest(k) for ks in keys for k in ks), np.uint64))
            at = np.repeat(np.arange(len(keys)), [len(ks) for ks in keys])[maybe]
            flat = [k for ks in keys for k in ks]
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([flat[i] for i in np.flatnonzero(maybe)], pa.binary())], names=["doc_id", "row", "key"])

    return run


def split_lines(shared):
    """doc_id, row, n_lines, and the digest where the document loses nothing, else the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Filter(*shared.value)
        for batch in pieces(batches):
            texts = [t or b"" for t in binary(batch.column(3))]
            maybe = test(batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()),
                    pa.array([None if m else hashlib.sha256(t).digest() for t, m in zip(texts, maybe, strict=True)], pa.binary()),
                    pa.array([t if m else None for t, m in zip(texts, maybe, strict=True)], pa.binary()),
                ],
                names=["doc_id", "row", "n_lines", "sha", "raw"],
            )

    return run


def kept_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, n_lines, shas, raws, losts = batch.columns
        dropped, out, texts = [], [], []
        for sha, raw, lost in zip(shas.to_pylist(), raws.to_pylist(), losts.to_pylist(), strict=True):
            gone = 0
            if raw is not None:
                if lost:
                    lost = set(lost)
                    lines = raw.split(b"\n")
                    kept = [x for x in lines if key_of(x) not in lost]
                    gone, raw = len(lines) - len(kept), b"\n".join(kept)
                sha = hashlib.sha256(raw).digest()
            dropped.append(gone)
            out.append(sha.hex())
            texts.append(raw if gone else None)
        yield pa.RecordBatch.from_arrays([ids, n_lines, pa.array(dropped, pa.int64()), pa.array(out, pa.string()), pa.array(texts, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "changed"])


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and changed (the kept text in UTF-8 where lines were dropped, else null).

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least min_chars code
    points found in at least min_docs documents lose all their lines except in the largest doc_id that holds them.
    A document is a row: rows that repeat a doc_id count each, and lines stay in all rows with the largest doc_id. Null
    doc_ids are below all others. Null and empty texts are one empty line. An empty table gives an empty result; columns
    other than doc_id and text aren't read. filter_bytes bounds each broadcast filter; it doesn't change the result. A
    text takes about six times its length in a worker.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    suspects = context.broadcast(twice_seen(docs, min_chars, filter_bytes))
    held = cut(texts.mapInArrow(suspects_in(min_chars, suspects), "doc_id long, row long, key binary"))
    common = held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("stays")).where(F.col("n") >= min_docs)
    # Both sides are dealt by the key alone, so the rows of a hot one can be split at run time.
    lost = held.join(cut(common.select("key", "stays")), "key").where(~F.col("doc_id").eqNullSafe(F.col("stays")))
    lost = cut(lost.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("key").alias("lost")))
    losers = context.broadcast(sharded(lost.select(F.xxhash64("_id", "_row")), filter_bytes))
    rows = texts.select("doc_id", "row", F.xxhash64("doc_id", "row"), "text").mapInArrow(split_lines(losers), "doc_id long, row long, n_lines long, sha binary, raw binary")
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return joined.select("doc_id", "n_lines", "sha", "raw", "lost").mapInArrow(kept_lines, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, changed binary")
