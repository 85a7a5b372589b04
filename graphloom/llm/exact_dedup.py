"""Exact deduplication by Patricia tries, each owned by one task of a length-and-hash partition.

Every map task first folds the copies it meets itself, so that a group with a third of all rows reaches its owner as
one row per task and flush, not one per copy. An owner inserts whole byte strings into a compressed radix trie; a
terminal node holds the preferred identifier and the count. When a trie holds more than `budget` bytes, nodes included,
its heaviest subtree is spilled: its strings, and all later ones under its prefix, go to the next round, where they are
dealt out anew by another part of their hash, to tries of twice the budget. Rounds end when nothing was spilled. A single
text takes about four times its length in a worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import binary, cut, lower_ascii, one_of_each, pieces

#: Bytes that a map task folds before it passes them on, and that a trie may hold, with what objects take besides text.
FOLD_BYTES, TRIE_BYTES = 16 << 20, 64 << 20
ROW, NODE = 300, 500
GROUPS = "digest binary, text binary, round int, best long, n long"
ENTRY = pa.schema([("digest", pa.binary()), ("text", pa.binary()), ("round", pa.int32()), ("best", pa.int64()), ("n", pa.int64())])


class Trie:
    """A compressed radix trie over byte strings. A node is [label, children by first byte, best, count, bytes]: the bytes
    are those of all labels in its subtree, its own too, and NODE for each node there."""

    def __init__(self, largest: bool) -> None:
        self.pick = max if largest else min
        self.root = [b"", {}, None, 0, 0]

    def better(self, a, b):
        return b if a is None else a if b is None else self.pick(a, b)

    def insert(self, text: bytes, best, n: int) -> None:
        """Add n rows of this text, the preferred of whose identifiers is best."""
        node, at, path, end = self.root, 0, [], len(text)
        while True:
            path.append(node)
            if at == end:
                break
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None, 0, 0]
                node[1][text[at]] = child
                path.append(child)
                self.grow(path, len(child[0]) + NODE)
                node = child
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = common(label, text[at : at + len(label)])
            upper = [label[:k], {label[k]: child}, None, 0, child[4]]
            child[0], child[4] = label[k:], child[4] - k
            node[1][text[at]] = upper
            self.grow([*path, upper], NODE)
            node, at = upper, at + k
        node[2], node[3] = self.better(node[2], best) if node[3] else best, node[3] + n

    @staticmethod
    def grow(path: list, by: int) -> None:
        for node in path:
            node[4] += by

    @property
    def held(self) -> int:
        return self.root[4]

    def heaviest(self) -> bytes:
        """The prefix of a subtree with a good part of what is held, but of no single edge."""
        node, prefix = self.root, b""
        while node[1]:
            below = max(node[1].values(), key=lambda x: x[4])
            if node is not self.root and below[4] * 4 < self.held:
                break
            node, prefix = below, prefix + below[0]
        return prefix

    def remove(self, prefix: bytes) -> Iterator[tuple[bytes, int, int]]:
        """Take the subtree at this prefix out and yield what it held."""
        node, at, path = self.root, 0, [self.root]
        while at < len(prefix):
            node = node[1][prefix[at]]
            at += len(node[0])
            path.append(node)
        if len(path) == 1:
            self.root = [b"", {}, None, 0, 0]
        else:
            del path[-2][1][node[0][0]]
            self.grow(path[:-1], -node[4])
        yield from walk(node, prefix)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        yield from walk(self.root, b"")


def walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Texts with best and count under a node whose whole path is prefix."""
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        if node[3]:
            yield prefix, node[2], node[3]
        stack += [(x, prefix + x[0]) for x in node[1].values()]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def folded(largest: bool, fold: int):
    """Map side: one row for each distinct text among those met since the last flush."""
    pick = max if largest else min

    def flush(seen: dict) -> Iterator[pa.RecordBatch]:
        rows = [(hashlib.sha256(t).digest(), t, 0, *v) for t, v in seen.items()]
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[at : at + 256], strict=True), ENTRY, strict=True)], schema=ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        held = 0
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                text = lower_ascii(text or b"")
                had = seen.get(text)
                if had is None:
                    seen[text] = (doc_id, 1)
                    held += len(text) + ROW
                else:
                    ids = [x for x in (had[0], doc_id) if x is not None]
                    seen[text] = (pick(ids) if ids else None, had[1] + 1)
            if held > fold:
                yield from flush(seen)
                seen, held = {}, 0
        yield from flush(seen)

    return run


def owner(largest: bool, budget: int):
    """Reduce side: the trie of one partition. Rows that keep their text were spilled and are not final."""

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found[at : at + 256], strict=True), ENTRY, strict=True)], schema=ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Prefixes of what was spilled, by length.
        trie, gone, turn = Trie(largest), {}, 0
        for batch in pieces(batches, 256):
            late = []
            for text, turn, best, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if any(text[:k] in prefixes for k, prefixes in gone.items()):
                    late.append((hashlib.sha256(text).digest(), text, turn + 1, best, n))
                else:
                    trie.insert(text, best, n)
            while trie.held > budget and len(trie.root[1]):
                prefix = trie.heaviest()
                gone.setdefault(len(prefix), set()).add(prefix)
                late += [(hashlib.sha256(t).digest(), t, turn + 1, b, n) for t, b, n in trie.remove(prefix)]
            yield from rows(late)
        final = []
        for text, best, n in trie.items():
            final.append((hashlib.sha256(text).digest(), None, turn, best, n))
            if len(final) == 256:
                yield from rows(final)
                final = []
        yield from rows(final)

    return run


def groups(docs: DataFrame, keep: str = "largest", fold: int = FOLD_BYTES, budget: int = TRIE_BYTES) -> DataFrame:
    """digest, best, n: a row for each distinct normalised text."""
    largest = keep == "largest"
    todo = docs.select("doc_id", "text").mapInArrow(folded(largest, fold), GROUPS)
    done, turn = None, 0
    while True:
        # Each round deals by length and by another part of the content hash.
        dealt = todo.repartition(F.length("text"), F.xxhash64(F.lit(turn), "digest"))
        found = cut(dealt.mapInArrow(owner(largest, budget << turn), GROUPS))
        part = found.where("text is null").select("digest", "best", "n")
        done = part if done is None else done.unionByName(part)
        todo, turn = found.where("text is not null"), turn + 1
        if todo.isEmpty():
            return done


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, texts = batch.column(0), binary(batch.column(1))
        found = [hashlib.sha256(lower_ascii(t or b"")).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "digest", "row"])


def joined(docs: DataFrame, keep: str, fold: int, budget: int) -> DataFrame:
    """doc_id, row (the text's hash), digest, best, n for every row of docs; the last two are null for a text of its own."""
    rows = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(digests, "doc_id long, digest binary, row long")
    # Both sides are dealt by the digest alone, so the rows of a hot group can be split at run time.
    return rows.join(groups(docs, keep, fold, budget).where("n > 1 or best is null"), "digest", "left")


def exact_dedup(docs: DataFrame, keep: str = "largest", fold: int = FOLD_BYTES, budget: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id long, text string).

    Texts are equal when they are the same bytes after lower-casing A-Z. Null text counts as empty. Of equal texts the
    row with the largest (or smallest) doc_id stays; null doc_ids lose to others. Rows that repeat doc_id and text both
    stay or both go. An empty table gives an empty result; other columns are not read.
    """
    return (
        joined(docs, keep, fold, budget)
        .select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs with exactly one row of each text: the one that exact_dedup keeps, and one where rows repeat doc_id and text.

    Rows are judged one by one: another text with the doc_id of a copy, or without a doc_id, stays. All columns stay.
    """
    rows = joined(docs, keep, FOLD_BYTES, TRIE_BYTES).where("n > 1")
    return one_of_each(docs, rows.select("doc_id", "row", F.col("digest").alias("group"), F.col("doc_id").eqNullSafe(F.col("best")).alias("first")))
