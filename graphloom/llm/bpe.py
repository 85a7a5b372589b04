"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until its parts are at most LEAF characters; leaves are encoded by themselves. Two neighbours are
joined by encoding again a window around the cut and keeping the tokens on both sides. The window grows to a place on
either side where every segmentation of any text with these characters around it has a boundary: between two characters
of which the second is white space and the first isn't, or of which both are visible and of different classes (letter,
number, other), the first not being an apostrophe. No match of the pattern can cross such a place, nor can what lies
beyond it change a match before it, so the tokens outside of the window are those of the whole text. A node is a list of
ids and a span; a join takes tokens off by their byte lengths. Where no such place comes for long, a match that the cut
divides is joined from the tokens of its two parts. Decoding concatenates the halves up the tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import fresh, pieces

#: Characters of a leaf, and of a window's side at first.
LEAF, WINDOW = 384, 16
#: Longer windows are joined match by match, and longer matches encoded by a tree of their own over bytes.
LONG_MATCH = 512


class Codec:
    """Ranks from a file of base64 tokens and ranks, and the pattern whose matches are encoded separately."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.length = list(map(len, self.tokens))
        self.label = list(map(str, range(len(self.tokens))))
        self.pair = functools.lru_cache(1 << 14)(self.together)

    # -- text level ------------------------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return self.tree(text, 0, len(text)) if text else []

    def tree(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= LEAF:
            return self.leaf.encode_ordinary(text[a:b])
        cut = (a + b) // 2
        left, right = self.tree(text, a, cut), self.tree(text, cut, b)
        return self.join(text, a, cut, b, left, right)

    def join(self, text: str, a: int, cut: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[a:b] from those of text[a:cut] and text[cut:b]."""
        low, high = self.before(text, a, cut), self.after(text, cut, b)
        k = self.tokens_over(left, len(text[low:cut].encode()), last=True)
        m = self.tokens_over(right, len(text[cut:high].encode()), last=False)
        if high - low < LONG_MATCH:
            middle = self.leaf.encode_ordinary(text[low:high])
        else:
            middle = self.around(text[low:high], cut - low, left[len(left) - k :], right[:m])
        del left[len(left) - k :]
        left += middle
        left += right[m:] if m else right
        return left

    @staticmethod
    @functools.lru_cache(1 << 14)
    def kind(c: str) -> str:
        return "L" if c.isalpha() and regex.match(r"\p{L}", c) else "S" if regex.match(r"\s", c) else "N" if regex.match(r"\p{N}", c) else "O"

    @staticmethod
    @functools.lru_cache(1 << 15)
    def certain(two: str) -> bool:
        """Whether any segmentation of a text with these two characters has a boundary between them."""
        k, m = map(Codec.kind, two)
        return k != "S" and (m == "S" or k != m and two[0] != "'")

    def before(self, text: str, a: int, cut: int) -> int:
        """The last certain boundary at least WINDOW before the cut, or the start."""
        at = max(a, cut - WINDOW)
        while at > a and not self.certain(text[at - 1 : at + 1]):
            at -= 1
        return at

    def after(self, text: str, cut: int, b: int) -> int:
        at = min(b, cut + WINDOW)
        while at < b and not self.certain(text[at - 1 : at + 1]):
            at += 1
        return at

    def tokens_over(self, ids: list[int], n: int, last: bool) -> int:
        """How many tokens from the end (or start) make exactly n bytes."""
        k, have = 0, 0
        while have < n:
            k += 1
            have += self.length[ids[-k if last else k - 1]]
        if have != n:
            raise ValueError("no token boundary at a certain place")
        return k

    # -- windows without a certain boundary for long -----------------------------------------------------------------

    def around(self, text: str, cut: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of a long window from those of its two sides: a match that either side has too keeps its tokens, one that
        the cut divides into a match of either side is joined from theirs, only others are encoded anew."""
        sides = self.matches(text[:cut], 0, left), self.matches(text[cut:], cut, right)
        ids: list[int] = []
        for found in self.pattern.finditer(text):
            span = found.span()
            known = sides[span[0] >= cut].get(span)
            if known is None and span[0] < cut < span[1]:
                one, two = sides[0].get((span[0], cut)), sides[1].get((cut, span[1]))
                if one is not None and two is not None:
                    known = self.joined(one, two)
            ids += self.match(found.group().encode()) if known is None else known
        return ids

    def matches(self, text: str, at: int, ids: list[int]) -> dict[tuple[int, int], list[int]]:
        """The ids of each match of a text, by its place in one where this text begins at `at`."""
        out, first = {}, 0
        for found in self.pattern.finditer(text):
            size, last = len(found.group().encode()), first
            while size > 0:
                size -= self.length[ids[last]]
                last += 1
            out[found.start() + at, found.end() + at] = ids[first:last]
            first = last
        return out

    # -- inside one match ------------------------------------------------------------------------------------------

    def match(self, piece: bytes) -> list[int]:
        """Ids of one match, by halves of its bytes."""
        if len(piece) <= LONG_MATCH:
            return self.merged(piece)
        cut = len(piece) // 2
        return self.joined(self.match(piece[:cut]), self.match(piece[cut:]))

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a short piece: while two neighbours make a token, those of the least rank, leftmost first, become one."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        # A part goes from its first byte to ends[first]; `before` has the first byte of the part on its left.
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)

        def offer(first: int) -> None:
            if first >= 0 and ends[first] < n and (rank := self.ranks.get(piece[first : ends[ends[first]]])) is not None:
                heapq.heappush(queue, (rank, first, ends[ends[first]]))

        while queue:
            _, first, end = heapq.heappop(queue)
            if alive[first] and ends[first] < n and ends[ends[first]] == end:
                alive[ends[first]] = False
                ends[first] = end
                if end < n:
                    before[end] = first
                offer(first)
                offer(before[first])
        return [self.ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]

    def together(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """A sequence of tokens is the encoding of its bytes just if each two neighbours are that of theirs. So the
        window may stop where its outer tokens fit the ones outside of it."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            mid = self.merged(b"".join(map(self.tokens.__getitem__, a + b)))
            fits_left = k >= len(left) or self.pair(left[-k - 1], mid[0])
            fits_right = k >= len(right) or self.pair(mid[-1], right[k])
            if fits_left and fits_right:
                return left[:-k] + mid + right[k:]
            k *= 2

    # -- decoding --------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the tokens, halves concatenated up the tree."""
        if len(ids) <= LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def coded(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in pieces(batches, 256):
            sizes, hashes, decoded, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = one.encode(text or "")
                sizes.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(one.label.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(one.decode(ids)).hexdigest())
                lists.append(np.array(ids, "<i4").tobytes() if with_ids else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, packed as 4-byte little-endian integers) for every row of
    docs (doc_id long, text string).

    Null text counts as empty: no token. Rows that repeat a doc_id are encoded each. An empty table gives an empty
    result; other columns are not read. path is a vocabulary that every executor can open, pattern the regular
    expression whose matches are encoded separately.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(coded(path, pattern, with_ids), kind)


def decode(rows: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """rows with a binary column of the bytes of their packed ids (null where these are), named bytes or _bytes if taken."""
    name = fresh(rows, "bytes")
    kind = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in pieces(batches, 256):
            found = [None if ids is None else one.decode(np.frombuffer(ids, "<i4").tolist()) for ids in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, kind)
