"""Git as a source: churn, statuses, blobs and hunks of a working tree, as DataFrames. Git runs on the driver."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GitError(RuntimeError):
    pass


class NoCommits(GitError):
    """The repository has no commit yet."""


class NotInRef(GitError):
    """The file doesn't exist at the ref."""


def git(root: str, *args: str, text: bool = True):
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=text, check=False)
    except FileNotFoundError as e:
        raise GitError("git isn't installed") from e
    if done.returncode:
        message = done.stderr if text else done.stderr.decode(errors="replace")
        if "does not have any commits" in message or "unknown revision" in message and "HEAD" in args:
            raise NoCommits(message.strip())
        raise GitError(message.strip())
    return done.stdout


def is_repo(root: str) -> bool:
    try:
        return git(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except GitError:
        return False


def head(root: str) -> str:
    return git(root, "rev-parse", "HEAD").strip()


def default_ref(root: str) -> str:
    """The branch that the remote's head names (without the remote), else the current branch, else HEAD."""
    for args, remote in ((("symbolic-ref", "--short", "refs/remotes/origin/HEAD"), True), (("symbolic-ref", "--short", "HEAD"), False)):
        try:
            name = git(root, *args).strip()
        except GitError:
            continue
        if name := name.partition("/")[2] if remote and "/" in name else name:
            return name
    return "HEAD"


def churn(spark: SparkSession, root: str) -> DataFrame:
    """path (absolute), commits of each .go file. Counting is a job: only the log's lines come from git."""
    top = git(root, "rev-parse", "--show-toplevel").strip()
    names = [(os.path.join(top, x),) for x in git(root, "log", "--name-only", "-z", "--pretty=format:", "--", "*.go").replace("\n", "\0").split("\0") if x.endswith(".go")]
    return spark.createDataFrame(names, "path string").groupBy("path").agg(F.count("*").cast("int").alias("commits"))


def statuses(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """path, was, status: changed files of the working tree against a ref; renames and copies have the old path."""
    parts, rows, k = git(root, "diff", "--name-status", "-z", "-M", ref).split("\0"), [], 0
    while k < len(parts) - 1:
        status = parts[k][:1]
        two = status in ("R", "C")
        rows.append((parts[k + 2] if two else parts[k + 1], parts[k + 1] if two else None, status))
        k += 3 if two else 2
    return spark.createDataFrame([r for r in rows if r[0].endswith(".go")], "path string, was string, status string")


def changed(root: str, ref: str) -> list[str]:
    return [x for x in git(root, "diff", "--name-only", "-z", ref).split("\0") if x.endswith(".go")]


def deleted(root: str, ref: str) -> list[str]:
    return [x for x in git(root, "diff", "--name-only", "--diff-filter=D", "-z", ref).split("\0") if x.endswith(".go")]


def untracked(root: str) -> list[str]:
    return [x for x in git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if x.endswith(".go")]


def show(root: str, ref: str, path: str) -> str:
    """A file's content at a ref."""
    try:
        return git(root, "show", f"{ref}:{path}")
    except GitError as e:
        if "does not exist" in str(e) or "exists on disk, but not in" in str(e):
            raise NotInRef(str(e)) from e
        raise


def diff_lines(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """path, text: the header lines of a diff without context, for operators.delta.hunks."""
    rows, path = [], ""
    for line in git(root, "diff", "-U0", ref, "--", "*.go").splitlines():
        if line.startswith("+++ "):
            path = line[6:] if line.startswith("+++ b/") else path
        elif line.startswith("--- a/"):
            path = line[6:]
        elif line.startswith("@@"):
            rows.append((path, line))
    return spark.createDataFrame(rows, "path string, text string")


def shapes_at(spark: SparkSession, root: str, ref: str | None, repo: str) -> DataFrame:
    """name, shape of the declarations of all .go files at a ref (None: the working tree), for delta.changed_symbols."""
    found = declarations_at(spark, root, ref, repo)
    return found.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("shape")), "\n").alias("shape"))


def declarations_at(spark: SparkSession, root: str, ref: str | None, repo: str) -> DataFrame:
    """name, shape (the text with the own name masked), kind, file (relative), line, body, is_test."""
    from graphloom.operators.delta import masked
    from graphloom.sources.go_source import exploded, parsed

    if ref is None:
        names = [*git(root, "ls-files", "-z", "--", "*.go").split("\0"), *untracked(root)]
        files = []
        for x in names:
            if x and os.path.exists(os.path.join(root, x)):
                with open(os.path.join(root, x)) as f:
                    files.append((x, f.read()))
    else:
        files = [(x, show(root, ref, x)) for x in git(root, "ls-tree", "-r", "-z", "--name-only", ref).split("\0") if x.endswith(".go")]
    rows = spark.createDataFrame(files, "path string, content string").withColumn("repo", F.lit(repo)).withColumn("root", F.lit(""))
    symbols = exploded(parsed(rows).where("error is null"), "symbols", "path")
    texts = symbols.join(rows.select(F.col("path").alias("_p"), "content"), F.col("path") == F.col("_p"))
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    test = F.endswith("path", F.lit("_test.go"))
    return texts.select(F.col("qualified_name").alias("name"), masked(body, F.col("name")).alias("shape"), "kind", F.col("path").alias("file"), F.col("pos_line").alias("line"), body.alias("body"), test.alias("is_test"))
