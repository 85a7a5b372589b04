"""Writing relations: merging, deduplicating and upserting rows, and snapshots that are switched atomically."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.model import SCHEMAS, Graph


def merge_edges(uses: DataFrame) -> DataFrame:
    """One edge for each (repo, from, to, type) of uses (from_ref, to_ref, edge_type, file, line, column, repo).

    Sites are the distinct uses in (file, line, column) order; the edge's position is the first of them.
    """
    site = F.struct("file", "line", "column")
    rows = uses.groupBy("repo", "from_ref", "to_ref", "edge_type").agg(F.array_sort(F.collect_set(site)).alias("sites"))
    first = F.get("sites", F.lit(0))
    return rows.select("from_ref", "to_ref", "edge_type", first["file"].alias("pos_file"), first["line"].alias("pos_line"), "sites", "repo")


def union_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of two writes: sites are united, the position of the first write stays."""
    both = old.withColumn("_w", F.lit(0)).unionByName(new.withColumn("_w", F.lit(1)))
    key = ["repo", "from_ref", "to_ref", "edge_type"]
    at = F.min_by(F.struct("pos_file", "pos_line"), "_w").alias("p")
    return both.groupBy(*key).agg(at, F.array_sort(F.array_distinct(F.flatten(F.collect_list("sites")))).alias("sites")).select("from_ref", "to_ref", "edge_type", "p.pos_file", "p.pos_line", "sites", "repo")


def dedup_symbols(symbols: DataFrame) -> DataFrame:
    """The first row of each (qualified_name, pos_file, pos_line), in the order of kind, signature and receiver."""
    order = Window.partitionBy("qualified_name", "pos_file", "pos_line").orderBy("kind", "signature", "receiver")
    return symbols.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, action (insert, update, delete) to get from old to new files; same content and repo is no row.

    Contents are compared by digest, so only digests are shuffled.
    """
    digest = lambda d, n: d.select("path", F.sha2(F.concat_ws("\u0000", F.coalesce("repo", F.lit("")), F.coalesce("content", F.lit(""))), 256).alias(n))
    both = digest(old, "a").join(digest(new, "b"), "path", "full")
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "update")
    return both.select("path", action.alias("action")).where("action is not null")


def apply_churn(symbols: DataFrame, churn: DataFrame) -> DataFrame:
    """symbols with churn_count of their file (churn: path, commits); files without commits count 0."""
    return symbols.drop("churn_count").join(churn.select(F.col("path").alias("pos_file"), F.col("commits").cast("int").alias("churn_count")), "pos_file", "left").fillna(0, ["churn_count"])


def suppress(suppressions: DataFrame, from_ref: str, to_ref: str) -> DataFrame:
    """suppressions with a pair added; adding it again changes nothing."""
    one = suppressions.sparkSession.createDataFrame([(from_ref, to_ref)], "from_ref string, to_ref string")
    return suppressions.select("from_ref", "to_ref").unionByName(one).distinct()


class Conflict(RuntimeError):
    """Another writer has made a newer snapshot."""


class Store:
    """Snapshots of a graph below one folder, on any file system Spark writes to.

    Rows are written to new folders only. A snapshot is a numbered file that names its folders and, for each and by
    relation, the repositories whose rows there no longer count; it is made once those folders are complete, and only if no other
    writer took its number. Readers see the old snapshot or the new one. Replacing a repository writes its own rows
    alone; after FOLDERS folders all are written together again.
    """

    FOLDERS = 16

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[str]:
        """Names of the snapshots, oldest first."""
        fs, path = self._fs(f"{self.root}/current")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.isdigit())

    def folders(self, version: str) -> list[dict]:
        """What a snapshot consists of: folder, and without, the repositories left out of it by relation."""
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.root}/current/{version}", wholetext=True).collect())
        return json.loads(text) if text else []

    def _point(self, folders: list[dict], after: str | None) -> str:
        """A snapshot of these folders, the next one after `after`."""
        name = f"{int(after) + 1 if after else 0:08d}"
        fs, path = self._fs(f"{self.root}/current/{name}")
        if fs.exists(path):
            raise Conflict(f"snapshot {name} of {self.root} was made meanwhile")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"snapshot {name} of {self.root} was made meanwhile") from e
            raise
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        return name

    def _rows(self, graph: Graph) -> str:
        """A new folder with the relations of a graph."""
        folder = uuid.uuid4().hex
        for relation in SCHEMAS:
            rows = getattr(graph, relation)
            if rows is not None:
                writer = rows.write.mode("overwrite")
                (writer.partitionBy("repo") if "repo" in rows.columns else writer).parquet(f"{self.root}/data/{folder}/{relation}")
        return folder

    def write(self, graph: Graph) -> str:
        """All relations as a new snapshot; its name. Raises Conflict if another writer was faster."""
        after = (self.versions() or [None])[-1]
        return self._point([{"folder": self._rows(graph), "without": {}}], after)

    def read(self, version: str | None = None) -> Graph:
        """The newest snapshot; relations that weren't written are empty."""
        names = self.versions()
        if not names:
            raise FileNotFoundError(f"{self.root} has no snapshot")
        folders = self.folders(version or names[-1])
        return Graph(**{relation: self._relation(relation, folders) for relation in SCHEMAS})

    def _relation(self, relation: str, folders: list[dict]) -> DataFrame:
        owner, out = "module_path" if relation == "repos" else "repo", None
        for f in folders:
            base = f"{self.root}/data/{f['folder']}/{relation}"
            fs, path = self._fs(base)
            if not fs.exists(path) or all(s.getPath().getName().startswith("_") for s in fs.listStatus(path)):
                continue
            rows = self.spark.read.parquet(base)
            if owner in rows.columns:
                rows = rows.withColumn(owner, F.col(owner).cast("string"))
                if gone := f["without"].get(relation):
                    rows = rows.where(~F.coalesce(F.col(owner).isin(gone), F.lit(False)))
            elif out is not None:
                continue  # relations of no repository come from the oldest folder
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return self.spark.createDataFrame([], StructType.fromDDL(SCHEMAS[relation])) if out is None else out

    def replace_repo(self, repo: str, new: Graph, tries: int = 5) -> str:
        """A snapshot in which the rows of one repository come from `new` and all others stay.

        Only the repository's rows are written; relations that `new` doesn't have stay as they are. If another writer is faster, the snapshot is made anew from that one's.
        """
        own = {}
        for relation in SCHEMAS:
            rows, owner = getattr(new, relation), "module_path" if relation == "repos" else "repo"
            if rows is not None and owner in rows.columns:
                own[relation] = rows.where(F.col(owner) == repo)
        folder = self._rows(Graph(**own))
        for k in range(tries):
            version = self.versions()[-1]
            old = self.folders(version)
            folders = [{"folder": f["folder"], "without": f["without"] | {r: sorted({*f["without"].get(r, ()), repo}) for r in own}} for f in old] + [{"folder": folder, "without": {}}]
            if len(folders) > self.FOLDERS:
                folders = [{"folder": self._rows(Graph(**{r: self._relation(r, folders) for r in SCHEMAS})), "without": {}}]
            try:
                return self._point(folders, version)
            except Conflict:
                if k == tries - 1:
                    raise
        raise Conflict(repo)
