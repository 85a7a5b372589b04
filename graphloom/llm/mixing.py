"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents are dealt to shards by hash and stand there in a seeded order; every `block` words of a shard are a
block, cut inside a document where they must. The sources' targets are apportioned as whole blocks to the highest
quotients target / (2 k + 1), and a source's blocks again to its shards by their sizes. A shard with quota q of n blocks
plays all blocks q // n times and q % n of them, chosen by a seeded permutation, once more. Only one row for each source
comes to the driver; shards are apportioned source by source in the cluster.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD_CLASS, cut, fresh

WEIGHTS, CEILING, SEED = (5, 2, 1), 3, 7
#: Words of a block, and of one where a source is small: its target makes PARTS blocks, but none under LEAST words.
BLOCK, LEAST, PARTS = 4096, 16, 64
#: Shards of a source at most (a power of two), and documents in one below that.
SHARDS, SHARD_DOCS = 1 << 14, 400
#: Sources whose plan is broadcast; with more it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def water_level(total: int, sizes: list[int], weights: list[int], ceiling: int) -> list[Fraction]:
    """Shares of the total by weight, none above ceiling times its size; what is cut off is shared again."""
    out, open_, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > ceiling * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = Fraction(ceiling * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def apportion(votes: list[Fraction], seats: int, most: list[int]) -> list[int]:
    """Seats to the highest quotients votes / (2 k + 1), ties to the first; nobody gets over its most."""
    quota = [0] * len(votes)
    open_ = [i for i, v in enumerate(votes) if v > 0 and most[i] > 0]
    seats = min(seats, sum(most[i] for i in open_))
    if not open_:
        return quota
    # Any common divisor gives a start whose quotients are the highest of their number; then add or take one by one.
    unit = sum(votes[i] for i in open_) / max(1, seats)
    for i in open_:
        quota[i] = min(most[i], int(votes[i] / unit + Fraction(1, 2)))
    have = sum(quota)
    add = [(-votes[i] / (2 * quota[i] + 1), i) for i in open_ if quota[i] < most[i]]
    heapq.heapify(add)
    while have < seats:
        _, i = heapq.heappop(add)
        quota[i] += 1
        have += 1
        if quota[i] < most[i]:
            heapq.heappush(add, (-votes[i] / (2 * quota[i] + 1), i))
    take = [(votes[i] / (2 * quota[i] - 1), -i) for i in open_ if quota[i]]
    heapq.heapify(take)
    while have > seats:
        _, i = heapq.heappop(take)
        quota[-i] -= 1
        have -= 1
        if quota[-i]:
            heapq.heappush(take, (votes[-i] / (2 * quota[-i] - 1), i))
    return quota


def sources_plan(rows: list[tuple[str | None, int, int]], weights=WEIGHTS, ceiling: int = CEILING, block: int | None = None) -> list[tuple]:
    """(source, source_size, target, block, quota, shards) from (source, documents, words) of each source."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    sizes, total = [r[2] for r in rows], sum(r[2] for r in rows)
    targets = water_level(total, sizes, [weights[i % len(weights)] for i in range(len(rows))], ceiling)
    least = min((t for t in targets if t), default=Fraction(1))
    block = block or int(max(LEAST, min(BLOCK, least // PARTS)))
    # A shard has at most one block that isn't full.
    most = [ceiling * (-(-size // block) if size else 0) for size in sizes]
    quotas = apportion(targets, int(total / Fraction(block) + Fraction(1, 2)), most)
    out = []
    for (name, docs, size), target, quota in zip(rows, targets, quotas, strict=True):
        shards = 1
        # Shards hold many blocks each, so that those which aren't full count little.
        while shards < SHARDS and shards * SHARD_DOCS < docs and shards * 64 * block < size:
            shards *= 2
        out.append((name, size, float(target), block, quota, shards))
    return out


def shards_plan(source: str, sizes: dict[int, int], block: int, quota: int, ceiling: int, seed: int) -> list[tuple]:
    """(shard, n, passes, extra, stride, first) for each shard of a source. Block b of n is played once more than `passes`
    if (b * stride + first) % n < extra; stride has no divisor in common with n, so just `extra` blocks are."""
    own = sorted(sizes.items())
    n = [-(-words // block) for _, words in own]
    parts = apportion([Fraction(words) for _, words in own], quota, [ceiling * k for k in n])
    out = []
    for (shard, _), k, q in zip(own, n, parts, strict=True):
        draw = xxhash.xxh64_intdigest(f"{source}/{shard}", seed)
        stride, first = (draw >> 32) % k + 1 if k else 1, (draw & 0xFFFFFFFF) % k if k else 0
        while k and math.gcd(stride, k) > 1:
            stride += 1
        out.append((shard, k, q // k if k else 0, q % k if k else 0, stride, first))
    return out


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def chosen(block: Column) -> Column:
    """Whether a block is played once more."""
    return F.pmod(block * F.col("stride") + F.col("first"), F.greatest(F.col("n"), F.lit(1))) < F.col("extra")


def planned(docs: DataFrame, whole: bool, weights, ceiling: int, seed: int, block: int | None) -> DataFrame:
    """row (a struct of doc_id, or of all columns), size, start (words of its shard before it) and its shard's plan."""
    spark = docs.sparkSession
    # The row's own text is part of the draw: rows that repeat a doc_id, or have none, don't meet in one shard.
    draw = lambda k: F.xxhash64(F.lit(seed + k), "doc_id", "text")
    kept = F.struct(*(docs[c] for c in docs.columns)) if whole else F.struct("doc_id")
    # A key that is never null.
    source = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    rows = docs.select(kept.alias("row"), source.alias("source"), words(F.col("text")).alias("size"), draw(0).alias("order"), F.pmod(draw(1), F.lit(SHARDS)).cast("int").alias("deal"))
    if not whole:
        rows = cut(rows)
    fine = cut(rows.groupBy("source", "deal").agg(F.count("*").alias("docs"), F.sum("size").alias("w")))
    totals = [(r["source"][1:] if r["source"] else None, r["docs"], r["w"]) for r in fine.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("w").alias("w")).collect()]
    plan = [("" if name is None else f"={name}", *rest) for name, *rest in sources_plan(totals, weights, ceiling, block)]
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, block long, quota long, shards int")
    if len(totals) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    shard = F.col("deal").bitwiseAND(F.col("shards") - 1)
    sums = fine.join(plan, "source").groupBy("source", "block", "quota", shard.alias("shard")).agg(F.sum("w").alias("w"))

    def apportioned(group: pd.DataFrame) -> pd.DataFrame:
        name, size, quota = group["source"].iloc[0], int(group["block"].iloc[0]), int(group["quota"].iloc[0])
        found = shards_plan(name, dict(zip(group["shard"].tolist(), group["w"].tolist(), strict=True)), size, quota, ceiling, seed)
        return pd.DataFrame([(name, *x) for x in found], columns=["source", "shard", "n", "passes", "extra", "stride", "first"])

    # A group has at most SHARDS rows.
    shards = cut(sums.groupBy("source").applyInPandas(apportioned, "source string, shard int, n long, passes long, extra long, stride long, first long"))
    before = Window.partitionBy("source", "shard").orderBy("order", "size", "row.doc_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(plan, "source").withColumn("shard", shard).join(shards, ["source", "shard"])
    return joined.withColumn("start", F.sum("size").over(before) - F.col("size"))


def mix(docs: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, seed: int = SEED, block: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes for every row of docs (doc_id, text, source).

    A document's size is its number of words (null text: 0). Sources, by code point with null last, weigh in turn
    `weights` and share all words; targets over `ceiling` times a source's size are cut and shared again. taken counts
    the words the mix takes: `passes` whole copies and the document's share of the blocks that are played once more.
    block is the words of a block; without it BLOCK, or less where the least target wouldn't make PARTS such blocks. A
    source of no words has target 0. Rows that repeat a doc_id count each; rows with equal doc_id and text are
    interchangeable. An empty table gives an empty result. A row for each distinct source must fit the driver.
    """
    rows = planned(docs, False, weights, ceiling, seed, block)
    low, high, size = F.col("start"), F.col("start") + F.col("size"), F.col("block")
    blocks = F.sequence(F.floor(low / size), F.floor((high - 1) / size))
    inside = lambda b: F.when(chosen(b), F.least(high, (b + 1) * size) - F.greatest(low, b * size)).otherwise(F.lit(0)).cast("long")
    extra = F.when((F.col("extra") > 0) & (F.col("size") > 0), F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + inside(b))).otherwise(F.lit(0))
    taken = (F.col("passes") * F.col("size") + extra).cast("long")
    return rows.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"), "passes")


def mixed(docs: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, seed: int = SEED, block: int | None = None) -> DataFrame:
    """The mix itself, with the columns of docs: each row's text once for each pass, and once more what of it lies in the
    blocks that are played again: the text as it is if that is all of it, else those words joined by a space.

    Every row is taken as `mix` plans it, whatever other rows have its doc_id or text; a row's columns travel with it.
    """
    text = fresh(docs, "_text")
    rows = planned(docs, True, weights, ceiling, seed, block)
    low, high, size = F.col("start"), F.col("start") + F.col("size"), F.col("block")
    blocks = F.sequence(F.floor(low / size), F.floor((high - 1) / size))
    some = (F.col("extra") > 0) & (F.col("size") > 0)
    rows = rows.withColumn("all", F.when(some, F.forall(blocks, chosen)).otherwise(False)).withColumn("any", F.when(some, F.exists(blocks, chosen)).otherwise(False))
    played = lambda _, k: chosen(F.floor((low + k) / size))
    part = F.array_join(F.filter(F.regexp_extract_all("row.text", F.lit(WORD_CLASS), F.lit(0)), played), " ")
    more = F.when(F.col("all"), F.array("row.text")).when(F.col("any"), F.array(part)).otherwise(F.array().cast("array<string>"))
    passes = F.when(F.col("size") > 0, F.col("passes")).otherwise(F.lit(0)).cast("int")
    copies = rows.where((passes > 0) | F.col("any")).select("row", F.explode(F.concat(F.array_repeat("row.text", passes), more)).alias(text))
    return copies.select(*[F.col(text).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
