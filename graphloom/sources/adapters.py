"""The driver's tables as a code graph. Each relation is one SQL text that Spark and DuckDB both run.

Parts are symbols, type/brand pairs packages, part types repositories; in an order, the part of a line refers to the part
of the next one, and the line's flags give the edge type. Documents are files, error events diagnostics.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.plans.materialize import cut
from graphloom.sources import sinks

PARTS = """
SELECT p_partkey AS k, p_type || '/' || p_brand AS package_path, 'P' || CAST(p_partkey AS STRING) AS name, p_type AS repo, p_name, p_size,
       CAST(substr(p_brand, 7) AS INT) % 5 = 0 AS is_test, p_size % 11 = 0 AS is_generated, p_partkey % 3 <> 0 AS exported,
       CASE p_size % 7 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'type' WHEN 3 THEN 'interface' WHEN 4 THEN 'alias' WHEN 5 THEN 'const' ELSE 'var' END AS kind
FROM part"""

#: A method belongs to the first type (odd keys) or the first interface (even keys) of its package.
OWNERS = f"""
SELECT package_path AS owner_path, min(CASE WHEN kind = 'type' THEN k END) AS owner_type, min(CASE WHEN kind = 'interface' THEN k END) AS owner_interface
FROM ({PARTS}) GROUP BY package_path"""

NAMED = f"""
SELECT p.*, CASE WHEN kind <> 'method' THEN NULL WHEN k % 2 = 0 THEN owner_interface ELSE owner_type END AS owner
FROM ({PARTS}) p JOIN ({OWNERS}) o ON p.package_path = o.owner_path"""

SYMBOLS = f"""
SELECT package_path || '.' || CASE WHEN owner IS NULL THEN '' ELSE 'P' || CAST(owner AS STRING) || '.' END || name AS qualified_name, package_path, name, kind,
       CASE WHEN owner IS NULL THEN '' ELSE 'P' || CAST(owner AS STRING) END AS receiver,
       'func(a P' || CAST(k * 7 % 97 AS STRING) || ', b ' || p_name || ') P' || CAST(k * 13 % 211 AS STRING) AS signature, p_name || '. Part of ' || package_path AS doc,
       package_path || '/f' || CAST(k % 3 AS STRING) || CASE WHEN is_test THEN '_test.go' ELSE '.go' END AS pos_file, CAST(k AS INT) AS pos_line,
       exported, is_test, is_generated, CASE WHEN kind IN ('function', 'method') THEN p_size ELSE 0 END AS complexity, repo, k
FROM ({NAMED})"""

PACKAGES = f"""
SELECT package_path AS path, substr(package_path, length(repo) + 2) AS name, '/src/' || package_path AS dir, '' AS doc, bool_and(is_test) AS is_test, bool_and(is_generated) AS is_generated, repo
FROM ({PARTS}) GROUP BY package_path, repo"""

REPOS = """SELECT DISTINCT p_type AS module_path, '/src/' || p_type AS dir, p_type = 'PROMO' AS missing FROM part"""

#: Every use: one row for each pair of neighbouring lines. Some targets are outside of the index.
SITES = f"""
WITH s AS ({SYMBOLS}),
     n AS (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag || l_linestatus AS flags, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS next_part FROM lineitem),
     e AS (SELECT f.qualified_name AS from_symbol, CASE WHEN next_part % 19 = 0 THEN 'ext/lib' || CAST(next_part % 4 AS STRING) || '.F' || CAST(next_part AS STRING) ELSE t.qualified_name END AS to_symbol,
                  f.package_path AS from_package, CASE WHEN next_part % 17 = 0 THEN CASE WHEN next_part % 2 = 0 THEN 'ext.org/' ELSE 'std' END || CAST(next_part % 8 AS STRING) ELSE t.package_path END AS to_package,
                  flags, f.repo AS repo, 'o' || CAST(l_orderkey % 500 AS STRING) || CASE WHEN l_orderkey % 5 = 0 THEN '_test.go' ELSE '.go' END AS file, l_linenumber AS line, CAST(l_orderkey % 80 AS INT) AS col
           FROM n JOIN s f ON n.l_partkey = f.k JOIN s t ON n.next_part = t.k)
SELECT CASE WHEN flags = 'RO' THEN from_package ELSE from_symbol END AS from_ref, CASE WHEN flags = 'RO' THEN to_package ELSE to_symbol END AS to_ref,
       CASE flags WHEN 'RF' THEN 'calls' WHEN 'AF' THEN 'references' WHEN 'NF' THEN 'satisfies' WHEN 'NO' THEN 'embeds' WHEN 'RO' THEN 'imports' ELSE 'contract' END AS edge_type,
       file, line, col, repo
FROM e WHERE flags <> 'RO' OR from_package <> to_package"""

#: Merged edges without their sites: what most oracles need.
EDGES = f"""SELECT DISTINCT from_ref, to_ref, edge_type FROM ({SITES})"""

CHURN = """SELECT l_partkey AS churn_key, CAST(count(*) AS INT) AS churn_count FROM lineitem GROUP BY l_partkey"""

FILES = """SELECT source || '/' || coalesce(lang, '') || '/' || CAST(doc_id AS STRING) AS path, text AS content, source AS repo FROM documents"""

DIAGNOSTICS = """
SELECT 'u' || CAST(user_id % 50 AS STRING) || '.go' AS file, CAST(user_id AS INT) AS line, CAST(event_id % 80 AS INT) AS col, props AS message, 'R' || CAST(user_id % 3 AS STRING) AS repo
FROM events WHERE event_type = 'error'"""

CONTRACTS = f"""
SELECT from_ref, to_ref, CASE CAST(count(*) AS INT) % 3 WHEN 0 THEN 'producer' WHEN 1 THEN 'consumer' ELSE 'shared' END AS direction, CASE WHEN min(line) % 2 = 0 THEN 1.0 ELSE 0.4 END AS confidence,
       CASE WHEN min(col) % 3 = 0 THEN 'breaking' WHEN min(col) % 3 = 1 THEN 'compatible' ELSE 'unknown' END AS severity, min(line) % 2 = 1 AS suggested, min(repo) AS repo
FROM ({SITES}) WHERE edge_type = 'contract' GROUP BY from_ref, to_ref"""

SUPPRESSIONS = f"""SELECT DISTINCT to_ref AS from_ref, from_ref AS to_ref FROM ({CONTRACTS}) WHERE from_ref < to_ref AND severity = 'breaking'"""

CONSTANTS = """
SELECT r_name AS repo, r_name || '/' || n_name AS package_path, c_mktsegment AS name, c_mktsegment || '_' || CAST(count(*) % 3 AS STRING) AS value, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, c_mktsegment"""

#: One message type for each package, with a field for each constant whose count isn't a multiple of 4.
FIELDS = f"""
SELECT repo, package_path, package_path || '.Message' AS type_ref, name AS wire_name, 'T' || CAST(n % 2 AS STRING) AS go_type FROM ({CONSTANTS}) WHERE n % 4 <> 0"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark", "labels", "embeddings")


class Tables:
    """The driver's tables of one folder and the relations over them, each a DataFrame built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """A relation's SQL over the tables it names; more: further DataFrames by name."""
        used = {n: self.table(n) for n in TABLES if f" {n}" in text}
        return self.spark.sql(_named(text, [*used, *more]), **used, **more)

    @cached_property
    def symbols(self) -> DataFrame:
        churn = self.sql(CHURN)
        rows = self.sql(SYMBOLS)
        return rows.join(churn, rows["k"] == churn["churn_key"], "left").withColumn("churn_count", F.coalesce("churn_count", F.lit(0))).drop("churn_key", "k")

    @cached_property
    def sites(self) -> DataFrame:
        return self.sql(SITES)

    @cached_property
    def edges(self) -> DataFrame:
        return sinks.merge_edges(self.sites.withColumnRenamed("col", "column"))

    @cached_property
    def bare_edges(self) -> DataFrame:
        """Merged edges without sites."""
        return self.sites.select("from_ref", "to_ref", "edge_type").distinct()

    def graph(self, sites: bool = True) -> Graph:
        """The graph; without sites, edges are bare and cost less."""
        return Graph(repos=self.sql(REPOS), packages=self.sql(PACKAGES), symbols=self.symbols, edges=self.edges if sites else self.bare_edges, files=self.sql(FILES), diagnostics=self.sql(DIAGNOSTICS), contracts=self.sql(CONTRACTS), suppressions=self.sql(SUPPRESSIONS))

    def looped(self, sites: bool = False) -> Graph:
        """The graph for operators that read edges and symbols again and again: both are computed once."""
        g = self.graph(sites)
        g.edges, g.symbols = cut(g.edges), cut(g.symbols)
        return g


def _named(text: str, names: list[str]) -> str:
    """SQL whose table names are parameters of spark.sql."""
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2}", text) if names else text
