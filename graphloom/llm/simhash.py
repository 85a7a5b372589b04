"""SimHash near-duplicate groups by bit-sliced comparison.

Two fingerprints of 64 bits within 2 bits of each other agree on at least two of four 16-bit quarters. Each distinct
fingerprint is dealt to the six pairs of quarters; within such a bucket distances are counted on bit planes: plane b
holds bit b of all fingerprints, packed, and the XOR of a plane with itself shifted by k lanes is bit b of all
differences between neighbours k apart. Carry-save counters add the 64 planes up lane by lane, and a block is left as soon as
every lane exceeds the radius. Buckets over LARGE are split again by parts of the bits that aren't fixed yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import binary, cut, one_of_each, pieces

SEED, RADIUS, SHINGLE = 42, 2, 3
QUARTERS = [0xFFFF << s for s in (0, 16, 32, 48)]
PAIRS = [a | b for a, b in combinations(QUARTERS, 2)]
#: Fingerprints in a bucket before it is split further, and lanes compared at a time.
LARGE, LANES = 2048, 1 << 16
#: Links in a partition of the loop that finds components, and links whose nodes' least neighbours are broadcast.
PART_ROWS, BROADCAST_LINKS = 200_000, 500_000


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 for no word."""
    hashes = [xxhash.xxh64_intdigest(s, SEED) for s in shingles(text or b"", size)]
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t, size) for t in binary(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "row", "fp"])

    return run


def exceeds(planes: np.ndarray, radius: int) -> np.ndarray:
    """Which lanes of 64 packed planes have more than radius bits set; radius 1 to 3. Counters saturate at 4."""
    ones = np.zeros(planes.shape[1], np.uint64)
    twos, over = ones.copy(), ones.copy()
    every = ~np.uint64(0)
    for k, plane in enumerate(planes):
        carry = ones & plane
        ones = ones ^ plane
        over |= twos & carry
        twos = twos ^ carry
        if k % 8 == 7:
            beyond = over | (twos & ones if radius == 2 else twos if radius == 1 else np.uint64(0))
            if (beyond == every).all():
                return beyond
    return over | (twos & ones if radius == 2 else twos if radius == 1 else np.uint64(0))


def near(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j, in the same run of equal groups and within radius. Runs are contiguous."""
    vertical = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.copy()
    left, right = [], []
    here, lag = np.arange(len(fps)), 1
    while len(here := here[here + lag < len(fps)]) and len(here := here[groups[here] == groups[here + lag]]):
        for at in range(0, len(here), LANES):
            i = here[at : at + LANES]
            bits = np.packbits(vertical.take(i, 1) ^ vertical.take(i + lag, 1), axis=1, bitorder="little")
            pad = -bits.shape[1] % 8
            # Lanes past the end differ in every bit, so they never keep a block alive.
            bits = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, pad)), constant_values=255))
            beyond = exceeds(bits.view("<u8"), radius)
            close = ~np.unpackbits(beyond.view(np.uint8), bitorder="little")[: len(i)].astype(bool)
            left.append(i[close])
            right.append(i[close] + lag)
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def parts(fixed: int) -> list[int]:
    """The bits outside fixed in RADIUS + 1 shares."""
    free = [b for b in range(64) if not fixed >> b & 1]
    return [sum(1 << b for b in free[k :: RADIUS + 1]) for k in range(RADIUS + 1)]


def bucket_links(fps: np.ndarray, fixed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints that agree on the bits of fixed."""
    shares = [p for p in parts(fixed) if p]
    if len(fps) <= LARGE or len(shares) <= RADIUS:
        a, b = near(fps, np.zeros(len(fps), np.int8))
        yield fps[a], fps[b]
        return
    for share in shares:
        key = fps & np.uint64(share)
        order = np.argsort(key, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(key[order])) + 1), len(order)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                yield from bucket_links(fps[order[a:b]], fixed | share)


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a < b as unsigned) in a partition sorted by (pair, key); a bucket may run over batches."""

    def found(pair: np.ndarray, key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = np.flatnonzero((np.diff(pair) != 0) | (np.diff(key) != 0)) + 1
        edges = np.array([0, *change, len(fps)])
        size = np.diff(edges)
        group = np.repeat(np.arange(len(size)), size)
        small = np.repeat((size > 1) & (size <= LARGE), size)
        a, b = near(fps[small], group[small])
        large = (bucket_links(fps[edges[k] : edges[k + 1]], PAIRS[int(pair[edges[k]])]) for k in np.flatnonzero(size > LARGE))
        for a, b in chain([(fps[small][a], fps[small][b])], chain.from_iterable(large)):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], names=["a", "b"])

    rest: list = []
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        rest = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
        pair, key, fps = rest
        last = len(fps) - 1
        first = int(np.argmax((pair == pair[last]) & (key == key[last])))
        if first:
            yield from found(pair[:first], key[:first], fps[:first].view(np.uint64))
            rest = [x[first:] for x in rest]
    if rest:
        yield from found(rest[0], rest[1], rest[2].view(np.uint64))


def links(fps: DataFrame) -> DataFrame:
    """a, b: all pairs of distinct fingerprints (column fp) within RADIUS bits."""
    keys = F.array(*(F.struct(F.lit(k).alias("pair"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(PAIRS)))
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("k.pair", "k.key", "fp")
    return dealt.repartition("pair", "key").sortWithinPartitions("pair", "key").mapInArrow(linked, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component, by alternating large-star and small-star steps (Kiveris et al.).

    Edges are a and b, in either order. Each step is a checkpoint; rounds end when the edges stay as they are. The least
    neighbours of nodes are found by sums of each task and joined to the edges by broadcast while these are few, else
    from a checkpoint of their own: both sides are then dealt for the join alone, and a star's edges split at run time.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # Neither step adds edges, so as many partitions as these rows want are enough for all rounds.
    size = edges.count()
    parts, before = size // PART_ROWS + 1, None

    def lowest(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("a").agg(F.min("b").alias("low"))
        return F.broadcast(least) if size <= BROADCAST_LINKS else cut(least)

    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").join(lowest(both), "a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")).distinct()
        if size > BROADCAST_LINKS:
            large = cut(large)
        small = large.join(lowest(large), "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        edges = cut(small.where("a <> b").distinct().coalesce(parts))
        now = edges.agg(F.count("*"), *(F.sum(x.cast("decimal(38,0)")) for x in (F.col("a"), F.col("b"), F.xxhash64("a", "b")))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def grouped(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row (the text's hash), fp, root (a fingerprint for each component), component_id, n_links for every row."""
    rows = cut(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(fingerprints(size), "doc_id long, row long, fp long"))
    each = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = cut(links(each.select("fp")))
    count = edges.select("a").unionAll(edges.select("b")).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n_links"))
    roots = components(edges)
    named = each.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    # Only fingerprints with a link can be in a component of more than one.
    several = named.join(count, "fp")
    low = several.groupBy("root").agg(F.min("low").alias("component_id"))
    several = several.join(low, "root").select("fp", "root", "component_id", "n_links")
    table = cut(each.join(several, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("n_links").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    return rows.join(table, "fp")


def simhash(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links for every row of docs (doc_id long, text string).

    n_links counts the other distinct fingerprints within RADIUS bits. Null, empty and blank texts have fingerprint zero
    and link like any other. Rows that repeat a doc_id count each. component_id is the smallest non-null doc_id that can
    be reached (null if there is none). An empty table gives an empty result; other columns are not read.
    """
    return grouped(docs, size).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def drop_near(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs with exactly one row of each group: one whose doc_id is the component's id, or one without where none has any.

    Rows are judged one by one: a row of another group with the doc_id of one that goes stays. All columns stay.
    """
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return one_of_each(docs, grouped(docs, size).select("doc_id", "row", F.col("root").alias("group"), first.alias("first")))
