"""Source files as a stream: each micro-batch of changed files replaces its repositories' rows in the store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.materialize import cut
from graphloom.sources.go_source import index
from graphloom.sources.sinks import Store

FILES = "path string, content string, repo string, root string, at timestamp"


def latest(files: DataFrame) -> DataFrame:
    """The newest version of each file (path, at); an empty content is a deletion and is left out."""
    newest = Window.partitionBy("repo", "path").orderBy(F.col("at").desc(), F.length("content").desc())
    return files.withColumn("_r", F.row_number().over(newest)).where("_r = 1 and content <> ''").drop("_r")


def follow(spark: SparkSession, changes: str, history: str, store: Store, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """A query that reads file versions (FILES, as Parquet) from `changes`.

    A batch re-indexes the repositories it touched; names resolve across a repository, so it is replaced as a whole.
    Versions are kept below `history`, a folder for each repository, so a batch reads what the repositories it touches
    have had, and of the store writes only their rows. A batch that runs again does the same again.
    """

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()
        try:
            # A row for each repository of one micro-batch.
            for row in batch.groupBy("repo").agg(F.count("*").alias("n")).collect():
                repo = row["repo"]
                # Names have slashes in them.
                path = f"{history}/{hashlib.sha256(repo.encode()).hexdigest()}"
                batch.where(F.col("repo") == repo).drop("repo").write.mode("overwrite").parquet(f"{path}/batch={number}")
                every = session.read.schema(FILES.replace("repo string, ", "")).parquet(f"{path}/*").withColumn("repo", F.lit(repo))
                files = cut(latest(every))
                graph = index(files.select("path", "content", "repo", "root"))
                if store.versions():
                    store.replace_repo(repo, graph)
                else:
                    store.write(graph)
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(FILES).parquet(changes)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def error_counts(diagnostics: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Diagnostics of a stream (at, repo) counted by repository and window; later rows than `late` are dropped."""
    return diagnostics.withWatermark("at", late).groupBy(F.window("at", window), "repo").agg(F.count("*").alias("n"))
