"""Chat formatting: logged snapshots of growing conversations are collapsed before rendering.

A conversation's turns are numbered by order; the rolling hash after k turns combines the hashes of (number, role, text)
of the first k by XOR, twice with other salts, so it grows along a window and is 128 bits wide. Conversations that are a
prefix of a longer one, or a copy of one with a smaller id, are taken out by anti-joins on (turns, hash). Turns are
windowed in chunks of CHUNK, so that one conversation with many rows is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut

CHUNK = 256
#: The template: what stands before and after a turn.
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, turn, role, text and the hashes p, q of what was said; null and the empty string differ."""
    parts = [F.col("role").isNull(), F.col("text").isNull(), "role", "text"]
    return turns.select("conv_id", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK).alias("chunk"), "turn", "role", "text", F.xxhash64(F.lit(1), *parts).alias("p"), F.xxhash64(F.lit(2), *parts).alias("q"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, k (from 1) and x, y, the hashes of (k, role, text). Texts aren't shuffled."""
    rows = ordered(turns).select("conv_id", "chunk", "turn", "role", "p", "q")
    sums = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "p", "q")
    placed = rows.withColumn("at", F.row_number().over(within))
    placed = placed.join(sums, placed["conv_id"].eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).withColumn("k", F.col("at") + F.col("before"))
    return placed.select("conv_id", "chunk", "k", F.xxhash64("k", "p").alias("x"), F.xxhash64("k", "q").alias("y"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, k, a, b: the rolling hashes."""
    sums = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), F.coalesce(F.bit_xor("x").over(ahead), zero).alias("_x"), F.coalesce(F.bit_xor("y").over(ahead), zero).alias("_y"))
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("conv_id", "chunk", "k", F.bit_xor("x").over(so_far).alias("a"), F.bit_xor("y").over(so_far).alias("b"))
    joined = within.join(sums, within["conv_id"].eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k")))
    return joined.select("conv_id", "k", F.col("a").bitwiseXOR(F.col("_x")).alias("a"), F.col("b").bitwiseXOR(F.col("_y")).alias("b"))


def maximal(rolling: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no prefix of another, the least id of equal ones."""
    size = F.max("k").alias("k")
    last = rolling.groupBy("conv_id").agg(size, F.max_by("a", "k").alias("a"), F.max_by("b", "k").alias("b"))
    last = last.groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    # Every snapshot that another conversation grew out of: its hash occurs before that one's last turn.
    ends = rolling.groupBy("conv_id").agg(F.max("k").alias("n")).withColumnRenamed("conv_id", "_c")
    inner = rolling.join(ends, rolling["conv_id"].eqNullSafe(F.col("_c"))).where("k < n").groupBy("k", "a", "b").agg(F.count("*").alias("longer"))
    return last.join(inner, ["k", "a", "b"], "left_anti").select("conv_id")


def rendered(role: Column, text: Column) -> Column:
    head, tail = OPEN.split("{role}")
    return F.concat(F.lit(head), F.coalesce(role, F.lit("")), F.lit(tail), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def chat(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered for each maximal conversation of turns (conv_id, turn, role, text).

    Turns stand by turn, then role, nulls first, then by a hash of what was said; rows that repeat all of these count
    each. Null role and text are rendered as empty strings but differ from them in comparison. Null conv_id is one
    conversation. Conversations compare by the order of their turns, not by the turns' numbers. An empty table gives an
    empty result; other columns are not read. A rendered conversation is one string and must fit a row.
    """
    rolling = cut(prefixes(cut(numbered(turns))))
    keep = maximal(rolling).withColumnRenamed("conv_id", "_c")
    rows = ordered(turns)
    kept = rows.join(keep, rows["conv_id"].eqNullSafe(F.col("_c")), "left_semi")
    said = F.struct(F.col("turn").isNotNull().alias("a"), "turn", F.col("role").isNotNull().alias("b"), "role", "p", "q", rendered(F.col("role"), F.col("text")).alias("s"))
    joined = lambda items: F.array_join(F.transform(items, lambda x: x["s"]), "")
    # Dealt by conversation once; chunks and then whole conversations are put together there.
    chunks = kept.select("conv_id", "chunk", said.alias("said")).repartition("conv_id").groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), joined(F.array_sort(F.collect_list("said"))).alias("s"))
    return chunks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), joined(F.array_sort(F.collect_list(F.struct("chunk", "s")))).alias("rendered"))
