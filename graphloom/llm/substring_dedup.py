"""Substring deduplication by hashing lines, and word-bounded parts of them, globally.

The units are lines (or paragraphs, wherever texts put a line break). Lines are normalised (A-Z lower-cased, white space
collapsed) and their 128-bit digests grouped globally; the occurrence in the least doc_id, and there the first, is kept,
the others are repeated. Counts are summed in every map task before the shuffle, so a line that a third of the rows hold
is one row of each task.

Passages are also pasted into the middle of lines. A line is therefore cut into parts after the word of least hash (the
last of equal ones) in each WINDOW words: that depends on those words alone, so a passage is cut the same way wherever it
stands, and of n words in a row all but 2 * WINDOW at most lie in parts that are cut alike. Parts are grouped like lines,
but only parts that stand in two different lines matter, as copies of a line are known already. A first pass counts, for
each 64-bit digest, whether two lines hold it; those digests fill a Bloom filter of at most FILTER_BYTES, which decides
what a second pass shuffles for the exact grouping. (A full filter lets more through, never less.) A part that follows
itself is told apart by its turn: a word said over and over doesn't repeat a passage that stands before it.

What is repeated, lines and parts, is joined to runs along the text, and runs of enough words are removed. Offsets count
code points of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bloom import Filter, sharded
from graphloom.llm.common import SPACE, binary, cut, fresh, pieces

#: A run that holds a whole repeated line goes from MIN_WORDS words on, one of parts alone from MIN_PART_WORDS on: parts
#: are cut anew each WINDOW words, so 50 words that two texts share hold 30 in whole parts.
MIN_WORDS, MIN_PART_WORDS, WINDOW = 1, 30, 10
#: The largest filter of repeated parts; it is full at about 45 million of them.
FILTER_BYTES = 64 << 20
#: Bytes of text worked on at a time.
CHUNK = 1 << 20
BLANK, LOWER = np.zeros(256, bool), np.arange(256)
BLANK[list(SPACE.encode())] = True
LOWER[65:91] += 32
#: Odd multipliers by place in a word, the places beyond in turn.
PLACE = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))

LINES = "doc_id long, row long, w int, words int, a int, b int, one long, two long"
SEEN = "part long, line int"
PARTS = "doc_id long, row long, w int, words int, a int, b int, part long"


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits spread over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edges(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """last, and the last word of least hash in each WINDOW words that hold none of last."""
    both = last.copy()
    if len(words) >= WINDOW:
        sums = np.concatenate([[0], np.cumsum(last)])
        bare = np.flatnonzero(sums[WINDOW:] == sums[:-WINDOW])
        least = np.lib.stride_tricks.sliding_window_view(words, WINDOW)[bare, ::-1].argmin(axis=1)
        both[bare + WINDOW - 1 - least] = True
    return both


class Words:
    """The words of some texts in arrays: hash, start and end in code points of their text, whose text, last of a line."""

    def __init__(self, texts: list[bytes]) -> None:
        flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        at = np.flatnonzero(~BLANK[flat])
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        size = np.diff(first, append=len(at))
        place = np.arange(len(at)) - np.repeat(first, size)
        sums = np.add.reduceat((LOWER[flat[at]] + 1).astype(np.uint64) * PLACE[place & 1023], first) if len(at) else np.zeros(0, np.uint64)
        self.hash = mixed(sums + size.astype(np.uint64))
        start, end = at[first], at[first + size - 1] + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, start, "right")
        point = np.cumsum((flat & 0xC0) != 0x80) - 1
        base = point[np.concatenate([[0], ends[:-1]])][self.text]
        self.start, self.end = point[start] - base, point[end - 1] + 1 - base
        # A word's number in its text.
        self.number = np.arange(len(start)) - np.searchsorted(self.text, self.text)
        self.last = np.diff(np.cumsum(flat == 10)[start], append=-1) != 0

    def units(self, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, w, words, a, b) and two digests of the units that end at `last`."""
        begin = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(last) else np.zeros(0, np.int64)
        count = np.diff(begin, append=len(last))
        turn = (np.arange(len(last)) - np.repeat(begin, count)).astype(np.uint64) + np.uint64(1)
        found = [np.add.reduceat(mixed(self.hash + turn * np.uint64(k)), begin) if len(begin) else np.zeros(0, np.uint64) for k in (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)]
        one, two = (mixed(x + count.astype(np.uint64)) for x in found)
        return self.text[begin], self.number[begin], count, self.start[begin], self.end[begin + count - 1], one, two

    def lines(self) -> tuple[np.ndarray, ...]:
        return self.units(self.last)

    def parts(self) -> tuple[np.ndarray, ...]:
        """Like lines, with the part's digest and a mark of the line: its digest, another where the line had the part before."""
        text, w, words, a, b, part, _ = self.units(edges(self.hash, self.last))
        lines = self.lines()
        # The line of a part is the last that begins at or before it.
        whole = np.searchsorted(np.cumsum(lines[2]) - lines[2], np.cumsum(words) - words, "right") - 1
        here = np.arange(len(part))
        fresh_ = np.concatenate([[True], (part[1:] != part[:-1]) | (whole[1:] != whole[:-1])]) if len(part) else np.zeros(0, bool)
        part = mixed(part + (here - np.maximum.accumulate(np.where(fresh_, here, 0))).astype(np.uint64))
        order = np.lexsort((here, part, whole))
        same = np.zeros(len(part), bool)
        same[1:] = (part[order[1:]] == part[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
        before = np.zeros(len(part), np.int64)
        place = np.arange(len(part))
        before[order] = place - np.maximum.accumulate(np.where(same, 0, place))
        return text, w, words, a, b, part, mixed(lines[5][whole] + before.astype(np.uint64)) >> np.uint64(33)


def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Words]]:
    """(batch, first row, words) for some texts at a time; the last column of a batch has the texts."""
    for batch in pieces(batches):
        texts, first, size = [t or b"" for t in binary(batch.column(batch.num_columns - 1))], 0, 0
        for i, t in enumerate([*texts, b""]):
            if i == len(texts) or size and size + len(t) > CHUNK:
                if first < i:
                    yield batch, first, Words(texts[first:i])
                first, size = i, 0
            size += len(t)


def rows_of(batch: pa.RecordBatch, first: int, found: tuple, mask: np.ndarray, names: str) -> pa.RecordBatch:
    """doc_id and row of each unit's text and the unit's numbers, of those in mask."""
    text = pa.array(found[0][mask] + first)
    numbers = [pa.array(x[mask].astype(np.int32)) for x in found[1:5]]
    digests = [pa.array(x[mask].view(np.int64)) for x in found[5:]]
    return pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(1).take(text), *numbers, *digests], names=[f.split()[0] for f in names.split(", ")])


def all_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, first, words in worked(batches):
        found = words.lines()
        yield rows_of(batch, first, found, np.ones(len(found[0]), bool), LINES)


def seen_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, line: what each text holds."""
    for _, _, words in worked(batches):
        *_, part, line = words.parts()
        yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(line.astype(np.int32))], names=["part", "line"])


def suspect_parts(shared):
    """The parts that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Filter(*shared.value)
        for batch, first, words in worked(batches):
            *found, _ = words.parts()
            mask = test(found[5])
            if mask.any():
                yield rows_of(batch, first, tuple(found), mask, PARTS)

    return run


def later(rows: DataFrame, *digest: str) -> DataFrame:
    """The rows (LINES or PARTS) whose digest stands earlier too: in a smaller doc_id, or before in the text.

    Null doc_ids rank last; among rows with the same doc_id the text's hash decides.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "w")
    groups = rows.groupBy(*digest).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    # Both sides are dealt by the digest alone, so the rows of a hot one can be split at run time.
    joined = rows.join(cut(groups), list(digest))
    return joined.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "row", "w", "words", "a", "b")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_part_words: int = MIN_PART_WORDS) -> DataFrame:
    """doc_id, row, spans (array of a, b, words in order) for the texts that lose something. row tells rows that repeat
    a doc_id apart: the text's hash."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    lines = later(texts.mapInArrow(all_lines, LINES), "one", "two")
    seen = docs.select("text").mapInArrow(seen_parts, SEEN)
    shared = seen.groupBy("part").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low < high").select("part")
    test = docs.sparkSession.sparkContext.broadcast(sharded(shared, FILTER_BYTES))
    parts = later(texts.mapInArrow(suspect_parts(test), PARTS), "part")
    found = lines.withColumn("line", F.lit(1)).unionByName(parts.withColumn("line", F.lit(0)))
    # Dealt by text once; repeated rows of a text fold there, and runs and spans are found.
    found = found.repartition("doc_id", "row").distinct()
    end = F.col("w") + F.col("words")
    ahead = Window.partitionBy("doc_id", "row").orderBy("w", end.desc(), F.col("line").desc())
    reached = F.max(end).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    begins = found.withColumn("begins", F.coalesce(F.col("w") > reached, F.lit(True)).cast("int"))
    runs = begins.withColumn("run", F.sum("begins").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "row", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), (F.max(end) - F.min("w")).cast("long").alias("words"), F.max("line").alias("line"))
    spans = spans.where((F.col("words") >= min_part_words) | (F.col("line") == 1) & (F.col("words") >= min_words))
    return spans.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("a", "b", "words"))).alias("spans"))


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_part_words: int = MIN_PART_WORDS) -> DataFrame:
    """doc_id, n_removed (spans), words_removed, spans for every row of docs (doc_id long, text string).

    A span is (a, b, words): code points a to b of the original text are a run of units that all stand in a document of
    smaller doc_id or earlier in the text itself. A run with a repeated line in it is removed if it has min_words words or
    more, by default always; a run of parts of lines needs min_part_words, as short ones recur by chance. Null doc_ids
    rank last. Null, empty and blank texts lose nothing. Of rows that repeat a doc_id the one whose text has the least
    hash comes first; equal rows are one document: a passage that they share stays in each. An empty table gives an empty
    result; other columns are not read. A text takes about 60 times its length in a worker.
    """
    spans = repeated_spans(docs, min_words, min_part_words).withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    ids = docs.select("doc_id", F.xxhash64("text").alias("_own"))
    joined = ids.join(spans, ids["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_row")), "left")
    words = F.aggregate(F.transform("spans", lambda s: s["words"]), F.lit(0).cast("long"), lambda x, y: x + y)
    return joined.select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).alias("_n"), words.alias("words"), "spans").select(
        "doc_id", F.greatest("_n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("words", F.lit(0)).cast("long").alias("words_removed"), F.coalesce("spans", F.array().cast("array<struct<a:int,b:int,words:bigint>>")).alias("spans")
    )


def cut_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_part_words: int = MIN_PART_WORDS) -> DataFrame:
    """docs with the passages taken out of their texts; all columns stay, texts without a passage are as they were."""
    lost = fresh(docs, "_lost")
    spans = repeated_spans(docs, min_words, min_part_words).select(F.struct("doc_id", "row", "spans").alias(lost))
    l = F.col(lost)  # noqa: E741
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(l["doc_id"]) & (F.xxhash64(docs["text"]) == l["row"]), "left")
    state = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))
    take = lambda s, x: F.struct(F.concat(s["s"], F.substring(docs["text"], s["at"] + F.lit(1), x["a"] - s["at"])).alias("s"), x["b"].alias("at"))
    rest = lambda s: F.concat(s["s"], F.substring(docs["text"], s["at"] + F.lit(1), F.length(docs["text"])))
    text = F.when(l.isNull(), docs["text"]).otherwise(F.aggregate(l["spans"], state, take, rest))
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
