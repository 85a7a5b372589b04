"""Quality classification by an interpolated modified Kneser-Ney model of byte n-grams, one for each language.

The model is trained on trusted text. Counts of the highest order are summed by n-gram; each lower order counts the
distinct n-grams one longer that end alike, and the interpolated probabilities come from joining every order's counts
with its contexts' totals and with the next lower order's probabilities, all sharded by (language, n-gram). Scoring
looks up the longest known n-gram at every byte, with the weights of the contexts left unmatched. The tables are
broadcast while they have at most BROADCAST_ROWS rows; above it the distinct n-grams of all documents are scored once by
joins with the sharded tables, and each document's n-grams joined with their scores. Logarithms are whole numbers of
1 / UNIT, taken where the tables are made, so sums don't depend on their order and both ways give the same bits. A
document is kept if its perplexity lies within quantiles of its language's trusted documents that the counts leave out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import binary, cut, pieces

ORDER = 5
BROADCAST_ROWS = 3_000_000
#: Logarithms are counted in units of 1 / UNIT.
UNIT = 1 << 24
#: One in HELD of the trusted documents, by hash, gives quantiles instead of counts.
HELD = 5
#: Quantiles of the held-out trusted documents' perplexities, and how far beyond them a document may lie.
LOW, HIGH, SLACK = 0.1, 0.9, 1.3
CHUNK = 1 << 20


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte (the latest byte lowest, zero bytes before a text) and each byte's text."""
    pad = b"\0" * (order - 1)
    flat = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint64)
    ends = np.cumsum([len(t) + order - 1 for t in texts])
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    at = np.arange(len(text)) + np.repeat(starts - np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]), [len(t) for t in texts]).astype(np.int64)
    out = np.zeros(len(at), np.uint64)
    for k in range(order):
        out |= flat[at - k] << np.uint64(8 * k)
    return out, text


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes in all, or one longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def passed(lang: str) -> pa.RecordBatch:
            keys, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "g", "c"])

        for batch in pieces(batches):
            by: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for a, b in chunks(texts):
                    held.setdefault(lang, []).append(np.unique(grams(texts[a:b], order)[0], return_counts=True))
                if len(held[lang]) > 16:
                    held[lang] = [merged(held[lang])]
                    if len(held[lang][0][0]) > 1 << 21:
                        yield passed(lang)
        for lang in list(held):
            yield passed(lang)

    return run


def discounts(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Chen and Goodman's D1, D2, D3+ for each language; a language's count of counts is four numbers."""
    rows = counts.groupBy("lang").agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()
    out = {}
    for r in rows:
        n1, n2, n3, n4 = (r[f"n{k}"] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        out[r["lang"]] = tuple(min(max(d, 0.1 * k), 0.95 * k) for k, d in enumerate(raw, 1))
    return out


def discount(found: dict[str, tuple], count: Column, k: int | None = None) -> Column:
    """D of a count, or D of k, by language."""
    table = F.create_map(*(F.lit(x) for lang, ds in found.items() for x in (lang, F.array(*(F.lit(d) for d in ds)))))
    return F.get(table[F.col("lang")], F.least(count, F.lit(3)).cast("int") - 1 if k is None else F.lit(k - 1))


def train(trusted: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(lang, n, g, p): interpolated probabilities; (lang, n, g, w): weights of contexts g of n-grams of order n. Both are
    logarithms in units.

    trusted: lang, text; rows with null in either aren't used.
    """
    rows = trusted.where("lang is not null and text is not null").select("lang", "text")
    counts = {order: cut(rows.mapInArrow(counted(order), "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")))}
    for n in range(order - 1, 0, -1):
        counts[n] = cut(counts[n + 1].groupBy("lang", F.col("g").bitwiseAND((1 << 8 * n) - 1).alias("g")).agg(F.count("*").alias("c")))
    lower, probabilities, weights = None, None, None
    for n in range(1, order + 1):
        found = discounts(counts[n])
        if not found:
            empty = counts[n].select("lang", F.lit(n).alias("n"), "g")
            return empty.withColumn("p", F.lit(0).cast("long")), empty.withColumn("w", F.lit(0).cast("long"))
        each = counts[n].withColumn("ctx", F.shiftright("g", 8))
        some = [F.count_if(F.col("c") == 1) * discount(found, None, 1), F.count_if(F.col("c") == 2) * discount(found, None, 2), F.count_if(F.col("c") >= 3) * discount(found, None, 3)]
        context = each.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), *(F.count_if(x).alias(f"k{k}") for k, x in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))))
        gamma = sum((F.col(f"k{k}") * discount(found, None, k) for k in (1, 2, 3)), F.lit(0.0)) / F.col("total")
        context = context.select("lang", "ctx", "total", gamma.alias("gamma"))
        joined = each.join(context, ["lang", "ctx"])
        if n > 1:
            joined = joined.withColumn("rest", F.col("g").bitwiseAND((1 << 8 * (n - 1)) - 1)).join(lower, ["lang", "rest"])
        else:
            joined = joined.withColumn("q", F.lit(1 / 256))
        lower = cut(joined.select("lang", F.lit(n).alias("n"), "g", ((F.col("c") - discount(found, F.col("c"))) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")))
        own = context.select("lang", F.lit(n).alias("n"), F.col("ctx").alias("g"), units(F.log("gamma")).alias("w"))
        found = lower.select("lang", "n", "g", units(F.log("p")).alias("p"))
        probabilities = found if probabilities is None else probabilities.unionByName(found)
        weights = own if weights is None else weights.unionByName(own)
        lower = lower.select("lang", F.col("g").alias("rest"), F.col("p").alias("q"))
    return probabilities, cut(weights)


def units(log: Column) -> Column:
    return F.round(log * UNIT).cast("long")


#: The logarithm of any byte's probability where nothing is known, in units, less its sign.
UNIFORM = round(np.log(256) * UNIT)


class Table:
    """Open addressing from n-grams to whole numbers, looked up for whole arrays."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, ~np.uint64(0))
        self.values = np.full(1 << self.bits, self.NONE)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[slot] == ~np.uint64(0)
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[todo[won]], values[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, NONE where a key isn't there."""
        slot = self.slot(keys)
        out, have = self.values[slot], self.keys[slot]
        todo = np.flatnonzero((have != keys) & (have != ~np.uint64(0)))
        out[have != keys] = self.NONE
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot]
            hit = have == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            going = ~hit & (have != ~np.uint64(0))
            todo, slot = todo[going], slot[going]
        return out


class Scorer:
    def __init__(self, probabilities: dict, weights: dict, order: int) -> None:
        self.order = order
        self.p = {k: Table(*x) for k, x in probabilities.items()}
        self.w = {k: Table(*x) for k, x in weights.items()}
        self.languages = {lang for lang, _ in self.p}

    def sums(self, lang: str, texts: list[bytes]) -> np.ndarray:
        """Log-likelihood of each text in units."""
        out = np.zeros(len(texts), np.int64)
        for a, b in chunks(texts):
            g, text = grams(texts[a:b], self.order)
            score, todo = np.zeros(len(g), np.int64), np.arange(len(g))
            for n in range(self.order, 0, -1):
                here = g[todo] & np.uint64((1 << 8 * n) - 1)
                found = self.p[lang, n](here)
                miss = found == Table.NONE
                score[todo[~miss]] += found[~miss]
                todo = todo[miss]
                if not len(todo):
                    break
                # A context never seen leaves all its weight to the next order.
                weight = self.w[lang, n](here[miss] >> np.uint64(8))
                score[todo] += np.where(weight == Table.NONE, 0, weight)
            score[todo] -= UNIFORM
            np.add.at(out[a:b], text, score)
        return out


def scored_by_broadcast(docs: DataFrame, probabilities: DataFrame, weights: DataFrame, order: int) -> DataFrame:
    """doc_id, lang, total (log-likelihood in units) and size in bytes; null for texts without either."""
    tables = []
    for frame, column in ((probabilities, "p"), (weights, "w")):
        found = frame.select("lang", "n", "g", column).toArrow()
        lang, n = np.array(found.column("lang").to_pylist(), object), found.column("n").to_numpy()
        g, v = found.column("g").to_numpy().view(np.uint64), found.column(column).to_numpy()
        tables.append({(x, k): (g[m], v[m]) for x in set(lang) for k in range(1, order + 1) if (m := (lang == x) & (n == k)).any()})
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Scorer(*shared.value, order)
        for batch in pieces(batches):
            lang, texts = batch.column(1).to_pylist(), [t or b"" for t in binary(batch.column(2))]
            total: list = [None] * len(texts)
            for x in set(lang) & one.languages:
                at = [i for i, y in enumerate(lang) if y == x and texts[i]]
                for i, t in zip(at, one.sums(x, [texts[i] for i in at]).tolist(), strict=True):
                    total[i] = t
            size = [None if t is None else len(x) for t, x in zip(total, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "lang", "total", "size"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, total long, size long")


def scored_by_join(docs: DataFrame, probabilities: DataFrame, weights: DataFrame, order: int) -> DataFrame:
    """The same with the tables sharded: distinct n-grams are scored order by order, once for all documents."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in counted(order)(pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["lang", "text"]) for b in batches):
            yield batch.select(["lang", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            for doc_id, lang, row, text in zip(*(c.to_pylist() for c in batch.columns[:3]), binary(batch.column(3)), strict=True):
                if text and lang is not None:
                    g, k = np.unique(grams([text], order)[0], return_counts=True)
                    same = [pa.array([x] * len(g), t) for x, t in ((doc_id, pa.int64()), (lang, pa.string()), (row, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(g.view(np.int64)), pa.array(k)], names=["doc_id", "lang", "row", "g", "k"])

    known = F.broadcast(probabilities.select("lang").distinct())
    rows = docs.select("doc_id", "lang", F.xxhash64("lang", "text").alias("row"), "text")
    todo = rows.where("text is not null and lang is not null").select("lang", "text").mapInArrow(distinct, "lang string, g long").distinct().join(known, "lang")
    todo, scores = todo.select("lang", "g", F.col("g").alias("whole"), F.lit(0).cast("long").alias("s")), None
    for n in range(order, 0, -1):
        p = probabilities.where(F.col("n") == n).select("lang", "g", "p")
        w = weights.where(F.col("n") == n).select("lang", F.col("g").alias("ctx"), "w")
        tried = cut(todo.withColumn("g", F.col("g").bitwiseAND((1 << 8 * n) - 1)).join(p, ["lang", "g"], "left"))
        found = tried.where("p is not null").select("lang", "whole", (F.col("s") + F.col("p")).alias("s"))
        scores = found if scores is None else scores.unionByName(found)
        todo = tried.where("p is null").drop("p").withColumn("ctx", F.shiftright("g", 8)).join(w, ["lang", "ctx"], "left")
        # A context never seen leaves all its weight to the next order.
        todo = todo.select("lang", "g", "whole", (F.col("s") + F.coalesce("w", F.lit(0))).alias("s"))
    scores = scores.unionByName(todo.select("lang", "whole", (F.col("s") - UNIFORM).alias("s"))).withColumnRenamed("whole", "g")
    each = rows.mapInArrow(run, "doc_id long, lang string, row long, g long, k long").join(scores, ["lang", "g"])
    # Rows that are the same add to both sums alike.
    alike = rows.groupBy("doc_id", "lang", "row").agg(F.count("*").alias("n")).withColumnsRenamed({"doc_id": "_d", "row": "_r", "lang": "_l"})
    sums = each.groupBy(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("row").alias("_r")).agg(F.sum(F.col("k") * F.col("s")).alias("total"), F.sum("k").alias("size"))
    same = F.struct("_d", "_l", "_r")
    sums = sums.withColumn("same", same).drop("_d", "_l", "_r").join(alike.withColumn("same", same), "same")
    sums = sums.select("_d", "_r", F.expr("total div n").alias("total"), F.expr("size div n").alias("size"))
    return rows.drop("text").join(sums, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left").select("doc_id", "lang", "total", "size")


def quality_lm(docs: DataFrame, trusted: DataFrame, order: int = ORDER, low: float = LOW, high: float = HIGH, slack: float = SLACK, limit: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lang, perplexity, low, high, kept for every row of docs (doc_id long, text string, lang string).

    trusted: doc_id of the documents to learn from; one in HELD, by hash, gives the quantiles. Perplexity is by byte.
    It is null for null and empty texts and for languages (null too) without trusted text; these aren't kept, as nothing
    speaks for them. A language none of whose held-out documents has a perplexity has no bounds and keeps all others. doc_ids of docs and trusted match as given; null matches nothing; rows that repeat a doc_id count each.
    An empty table gives an empty result; other columns are not read.
    """
    names = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    # Broadcast only while the ids are few; the count is of 8-byte rows.
    few = names.limit(2_000_001).count() <= 2_000_000
    names = F.broadcast(names) if few else names
    held = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(HELD)) == 0
    own = docs.select("doc_id", "lang", "text")
    probabilities, weights = train(own.where(~held).join(names, F.col("doc_id") == F.col("_id"), "left_semi"), order)
    small = probabilities.limit(limit + 1).count() + weights.limit(limit + 1).count() <= limit
    score = scored_by_broadcast if small else scored_by_join
    perplexity = F.exp(-F.col("total") / UNIT / F.col("size")).alias("perplexity")
    scored = cut(score(own, probabilities, weights, order).select("doc_id", "lang", perplexity))
    bounds = scored.where(held).join(names, F.col("doc_id") == F.col("_id"), "left_semi").groupBy("lang").agg(*(F.percentile_approx("perplexity", q, 10000).alias(k) for k, q in (("low", low), ("high", high))))
    # A row for each language that has trusted text.
    bounds = F.broadcast(bounds.select(F.col("lang").alias("_l"), (F.col("low") / slack).alias("low"), (F.col("high") * slack).alias("high")))
    rows = scored.join(bounds, F.col("lang") == F.col("_l"), "left")
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.col("perplexity").isNotNull())
    return rows.select("doc_id", "lang", "perplexity", "low", "high", inside.alias("kept"))
