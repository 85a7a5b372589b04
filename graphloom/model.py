"""Relations of the property graph, as explicit schemas, and the Graph that holds them as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMAS: dict[str, str] = {
    "repos": "module_path string, dir string, missing boolean, indexed_at timestamp",
    "packages": "path string, name string, dir string, doc string, is_test boolean, is_generated boolean, repo string",
    "symbols": "qualified_name string, package_path string, name string, kind string, receiver string, signature string, doc string, pos_file string, pos_line int, exported boolean, is_test boolean, is_generated boolean, complexity int, churn_count int, importance double, repo string, fields array<struct<go_name:string,wire_name:string,go_type:string>>, fields_json string",
    "edges": "from_ref string, to_ref string, edge_type string, pos_file string, pos_line int, sites array<struct<file:string,line:int,column:int>>, repo string",
    "files": "path string, content string, repo string",
    "diagnostics": "file string, line int, col int, message string, repo string",
    "contracts": "from_ref string, to_ref string, direction string, confidence double, severity string, suggested boolean, evidence string, indexed_at timestamp, repo string",
    "runtime_contracts": "kind string, pattern string, from_ref string, to_ref string, direction string, evidence string, indexed_at timestamp, repo string",
    "drift": "from_ref string, to_ref string, severity string, fields array<struct<wire_name:string,type_a:string,type_b:string,repo_a:string,repo_b:string,status:string>>, indexed_at timestamp, repo string",
    "suppressions": "from_ref string, to_ref string",
    "meta": "key string, value string",
    "response_chunks": "response_id string, tool string, section_idx int, title string, content string, byte_count long, created_at timestamp",
    "spans": "qualified_name string, file string, start_line int, end_line int, start_col int, doc_line int",
}

#: Edge types that keep a symbol alive, and all types a traversal may follow.
LIVE = ("calls", "references", "satisfies", "embeds")
EDGE_TYPES = (*LIVE, "imports", "contract")
KINDS = ("function", "method", "type", "interface", "alias", "const", "var")
TYPE_KINDS = ("type", "interface", "alias")


class NotFound(LookupError):
    """A named thing isn't indexed; `suggestions` has up to five candidates."""

    def __init__(self, message: str, suggestions: list[str] | None = None) -> None:
        self.suggestions = suggestions or []
        super().__init__(message + (f"; did you mean: {', '.join(self.suggestions)}?" if self.suggestions else ""))


class Ambiguous(LookupError):
    """A short name stands for several things."""


class NoPath(LookupError):
    """Both ends exist, but no path joins them within the depth."""


@dataclass
class Graph:
    """The relations, each a DataFrame with at least the columns of SCHEMAS that an operator reads."""

    repos: DataFrame | None = None
    packages: DataFrame | None = None
    symbols: DataFrame | None = None
    edges: DataFrame | None = None
    files: DataFrame | None = None
    diagnostics: DataFrame | None = None
    contracts: DataFrame | None = None
    runtime_contracts: DataFrame | None = None
    drift: DataFrame | None = None
    suppressions: DataFrame | None = None
    meta: DataFrame | None = None
    response_chunks: DataFrame | None = None
    spans: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return next(d for f in fields(self) if (d := getattr(self, f.name)) is not None).sparkSession

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(**{n: spark.createDataFrame([], StructType.fromDDL(s)) for n, s in SCHEMAS.items()})


def normalize_name(name: str) -> str:
    """pkg.(*T).M and pkg.(T).M are written pkg.T.M."""
    head, found, rest = name.partition("(")
    if not found:
        return name
    inner, closed, tail = rest.partition(")")
    return name if not closed else head + inner.lstrip("*") + tail
