"""Differences between two states of the source: changed symbols, files and their effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.plans.materialize import cut


def masked(text, name):
    """A declaration's text with its own name replaced by a placeholder, so that renames compare equal."""
    quoted = F.regexp_replace(name, r"([.\\+*?\[^\]$(){}=!<>|:\-#/])", r"\\$1")
    return F.regexp_replace(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])"), quoted, F.lit(r"(?![A-Za-z0-9_])")), F.lit("_"))


def changed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change (added, removed, modified, renamed), was: between shape tables (name, shape).

    Of the names that only one side has, those with equal shapes are paired as renames, in the order of their names.
    """
    a = old.select("name", F.col("shape").alias("before"))
    b = new.select("name", F.col("shape").alias("after"))
    both = a.join(b, "name", "full")
    modified = both.where("before is not null and after is not null and before <> after").select("name", F.lit("modified").alias("change"), F.lit(None).cast("string").alias("was"))
    turn = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("name"))
    removed = both.where("after is null").select(F.col("name").alias("was"), F.col("before").alias("shape"), turn("before").alias("turn"))
    added = both.where("before is null").select("name", F.col("after").alias("shape"), turn("after").alias("turn"))
    paired = removed.join(added, ["shape", "turn"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("name").isNull(), "removed").otherwise("renamed")
    moved = paired.select(F.coalesce("name", "was").alias("name"), change.alias("change"), F.when(change == "renamed", F.col("was")).alias("was"))
    return modified.unionAll(moved)


def working_changes(g: Graph, root: str, ref: str | None = None, repo: str | None = None, bodies: bool = False, tests: bool = False) -> DataFrame:
    """section (symbol, renamed_file, diagnostic), name, change, was, kind, file, line, detail, direct_callers: the working
    tree against a ref (without one, the default branch). repo is the module's name in the index, found by its folder.

    A symbol's row says where it is now, or was if it is gone; detail is its body on request, a diagnostic's message. Its
    callers are counted in the index under the name that they know, a renamed one's old name.
    """
    from graphloom.sources import vcs

    ref = ref or vcs.default_ref(root)
    if repo is None:
        known = [] if g.repos is None else g.repos.where(F.rtrim("dir", F.lit("/")) == root.rstrip("/")).select("module_path").head(1)
        repo = known[0][0] if known else ""
    old, new = (cut(vcs.declarations_at(g.spark, root, at, repo)) for at in (ref, None))
    if not tests:
        old, new = (x.where(~F.col("is_test")) for x in (old, new))
    shape = lambda x: x.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("shape")), "\n").alias("shape"))
    changes = changed_symbols(shape(old), shape(new))
    place = lambda x, mark: x.groupBy(F.col("name").alias("_n")).agg(F.min(F.struct("file", "line", "kind", "body")).alias(mark))
    rows = changes.join(place(new, "_new"), F.col("name") == F.col("_n"), "left").drop("_n").join(place(old, "_old"), F.col("name") == F.col("_n"), "left").drop("_n")
    uses = g.edges.where(F.col("edge_type").isin("calls", "references")).groupBy(F.col("to_ref").alias("_ref")).agg(F.count("*").alias("direct_callers"))
    rows = rows.withColumn("_at", F.coalesce("_new", "_old")).join(uses, F.coalesce("was", "name") == F.col("_ref"), "left")
    none = F.lit(None).cast("string")
    found = rows.select(F.lit("symbol").alias("section"), "name", "change", "was", "_at.kind", "_at.file", "_at.line", (F.col("_at.body") if bodies else none).alias("detail"), F.coalesce("direct_callers", F.lit(0)).cast("long").alias("direct_callers"))
    moved = vcs.statuses(g.spark, root, ref).where("status in ('R', 'C')")
    found = found.unionByName(moved.select(F.lit("renamed_file").alias("section"), F.col("path").alias("name"), F.lit("renamed").alias("change"), "was", none.alias("kind"), F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), none.alias("detail"), F.lit(None).cast("long").alias("direct_callers")))
    if g.diagnostics is None:
        return found
    return found.unionByName(g.diagnostics.select(F.lit("diagnostic").alias("section"), "file", "line", F.col("message").alias("detail")), allowMissingColumns=True)


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: added, modified, removed, renamed."""
    return changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "removed", "renamed")))


def workspace_changes(repos: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """changed_symbols of each repository, tagged with it."""
    rows = None
    for repo, (old, new) in repos.items():
        here = changed_symbols(old, new).withColumn("repo", F.lit(repo))
        rows = here if rows is None else rows.unionByName(here)
    return rows


def fingerprint(files: DataFrame) -> DataFrame:
    """repo, fingerprint: SHA-256 over the digests of a repository's files in path order."""
    each = files.select("repo", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("d"))
    return each.groupBy("repo").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: F.concat(x["path"], F.lit("\u0000"), x["d"])), "\n"), 256).alias("fingerprint"))


def stale(files: DataFrame, stored: DataFrame) -> DataFrame:
    """repo, reason: repositories whose sources aren't those of the stored fingerprints (repo, fingerprint)."""
    both = fingerprint(files).withColumnRenamed("fingerprint", "now").join(stored.withColumnRenamed("fingerprint", "was"), "repo", "full")
    reason = F.when(F.col("was").isNull(), "never indexed").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "source changed")
    return both.select("repo", reason.alias("reason")).where("reason is not null")


HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunks(lines: DataFrame) -> DataFrame:
    """path, side (added, removed), first, last: line ranges of a unified diff's headers (path, text)."""
    rows = lines.where(F.col("text").rlike(HUNK))
    n = lambda k: F.regexp_extract("text", HUNK, k)
    size = lambda k: F.when(n(k) == "", F.lit("1")).otherwise(n(k)).cast("int")
    each = lambda side, k: rows.select("path", F.lit(side).alias("side"), n(k).cast("int").alias("first"), (n(k).cast("int") + size(k + 1) - 1).alias("last"), size(k + 1).alias("n")).where("n > 0").drop("n")
    return each("removed", 1).unionAll(each("added", 3))
