"""What the training-data operators share: where they checkpoint, how they read and how they drop rows."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids of at most this many rows (8 bytes each) are broadcast; above it rows are joined by shuffle.
BROADCAST_IDS = 2_000_000

#: Bytes of an Arrow batch between the JVM and a Python worker, both of which hold a few at a time.
ARROW_BYTES = 4 << 20

#: ASCII white space, as the contracts count it.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def settle(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir, or where none is set, as in tests, a local folder on a
    local master; elsewhere executors would lose files there without a word, so it is an error.

    Also bounds the bytes of an Arrow batch, unless the session has its own bound."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = context.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) == f"{64 << 20}b":
        spark.conf.set(bound, str(ARROW_BYTES))
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder: lineage ends, each row is computed once."""
    settle(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{settle(spark)}/tables/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: bytes) -> bytes:
    """A-Z lower-cased, every other byte as it is."""
    return text.lower()


def binary(column: pa.Array) -> list:
    """The UTF-8 bytes (or None) of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a step holds is bounded whatever the texts' lengths. At the end of
    the task the worker gives back what it no longer uses; it may live on for many tasks."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        release()


def release() -> None:
    """Hand free memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def without(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of docs whose doc_id isn't in ids.doc_id (null matches null).

    The ids are broadcast when there are at most `limit` of them, counted first; else both sides are shuffled.
    """
    gone = fresh(docs, "_gone")
    ids = cut(ids.select(F.col("doc_id").alias(gone)).distinct())
    if ids.limit(limit + 1).count() <= limit:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col(gone)), "left_anti")


def one_of_each(docs: DataFrame, decided: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """docs with exactly one row of each group; all columns stay.

    decided has doc_id, row (the hash of its text as it is), group and first for every row of docs. The row of a group that
    stays is one that is first, of several texts the one of least hash, of equal doc_ids and texts the least row by all its
    columns (which must have an order). Each row is judged by doc_id and text, so other rows with its doc_id, or with none,
    are left alone. What goes or is repeated is counted and then broadcast or shuffled, as by `without`.
    """
    mark, id_, row_ = fresh(docs, "_mark"), fresh(docs, "_id"), fresh(docs, "_row")
    gone = decided.where(~F.col("first")).select("doc_id", "row", F.lit(True).alias("gone")).distinct()
    turn = F.row_number().over(Window.partitionBy("group").orderBy("row"))
    may = decided.where("first").groupBy("group", "doc_id", "row").agg(F.count("*").alias("n")).withColumn("turn", turn)
    gone = gone.unionAll(may.where("turn > 1 or n > 1").select("doc_id", "row", (F.col("turn") > 1).alias("gone")))
    marks = cut(gone.select(F.struct("doc_id", "row", "gone").alias(mark)))
    small = marks.limit(limit + 1).count() <= limit
    m = F.col(mark)

    def of(rows: DataFrame, how: str) -> DataFrame:
        return docs.join(F.broadcast(rows) if small else rows, docs["doc_id"].eqNullSafe(m["doc_id"]) & (F.xxhash64(docs["text"]) == m["row"]), how)

    left, several = of(marks, "left_anti"), marks.where(~m["gone"])
    if several.isEmpty():
        return left
    each = of(several, "left_semi").groupBy(F.col("doc_id").alias(id_), F.xxhash64("text").alias(row_))
    return left.unionByName(each.agg(F.min(F.struct(*docs.columns)).alias(mark)).select(f"{mark}.*"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
