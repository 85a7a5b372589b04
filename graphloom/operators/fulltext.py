"""Full-text search over symbols and files: token, trigram-ranked and substring strategies, fusion, typo correction."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from graphloom.functions.stem import stem
from graphloom.functions.text import contains_ci
from graphloom.model import Graph
from graphloom.operators.lookup import ranked
from graphloom.plans.materialize import shipped

LINES, MOST_TERMS, MOST_EDITS, LEAST_LETTERS, RRF = 100, 4, 2, 3, 60
#: Okapi BM25's usual constants.
K1, B = 1.2, 0.75


def alternatives(pattern: str) -> list[str]:
    """The parts between bars, trimmed; empty ones and those without a letter or digit are dropped."""
    return [a for p in pattern.split("|") if (a := p.strip()) and any(c.isalnum() for c in a)]


def terms_of(pattern: str) -> list[list[str]]:
    return [a.split() for a in alternatives(pattern)]


# -- symbols ---------------------------------------------------------------------------------------------------------


@F.pandas_udf(BooleanType())
def has_stem(tokens: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([any(stem(t) == w for t in ts) for ts, w in zip(tokens, wanted, strict=True)])


def beginning(tokens: str, head: str) -> Column:
    """The tokens that begin with head."""
    return F.filter(tokens, lambda x: F.startswith(x, F.lit(head)))


def symbol_matches(symbols: DataFrame, pattern: str, runs: bool = False) -> DataFrame:
    """Symbols for which some alternative has all its terms, as a stemmed token of any column or a prefix of the name.

    With runs, terms are cut at characters that don't belong to identifiers. Rows that can't hold a term's stem are
    filtered out before the stemmer sees them.
    """
    shipped(symbols.sparkSession)
    text = F.lower(F.concat_ws(" ", "qualified_name", "name", "kind", "receiver", "signature", "doc"))
    rows = symbols.withColumn("_tokens", F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+")))
    may, found = [], []
    for terms in terms_of(pattern):
        if runs:
            terms = [r for t in terms for r in re.findall(r"\w+", t)]
        may_all, all_ = [], []
        for low in map(str.lower, terms):
            named = F.startswith(F.lower("name"), F.lit(low))
            stems = [stem(t) for t in re.split(r"[\W_]+", low) if t]
            # Steps of the stemmer change at most the last letters of what they leave.
            near = [beginning("_tokens", s[: max(1, len(s) - 2)]) for s in stems]
            may_all.append(named | (all_of([F.size(x) > 0 for x in near]) if stems else F.lit(False)))
            all_.append(named | (all_of([has_stem(x, F.lit(s)) for x, s in zip(near, stems, strict=True)]) if stems else F.lit(False)))
        if terms:
            may.append(all_of(may_all))
            found.append(all_of(all_))
    # The first filter has no Python in it, so it runs before the stemmer.
    return rows.where(any_of(may)).where(any_of(found)).drop("_tokens")


# -- files -----------------------------------------------------------------------------------------------------------


def lines_of(files: DataFrame) -> DataFrame:
    """path, line (from 1), text."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("_i", "text")).select("path", (F.col("_i") + 1).alias("line"), "text")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def frequency(text: Column, phrase: str) -> Column:
    """Times the phrase stands in text, case aside, without overlaps."""
    low = F.lower(text)
    return (F.length(low) - F.length(F.replace(low, F.lit(phrase.lower())))) / len(phrase)


def bm25(files: DataFrame, phrases: list[str]) -> DataFrame:
    """files (content) with score: Okapi BM25 of the phrases; a file's length is its number of trigrams.

    Collection statistics are one row: the number of files, their mean length and each phrase's document frequency.
    """
    size = F.greatest(F.length("content") - 2, F.lit(0))
    counts = [F.count_if(contains_ci(F.col("content"), p)).alias(f"d{k}") for k, p in enumerate(phrases)]
    stats = files.agg(F.count("*").alias("n"), F.avg(size).alias("mean"), *counts).first()
    score = F.lit(0.0)
    for k, p in enumerate(phrases):
        idf = F.log(F.lit(1.0 + (stats["n"] - stats[f"d{k}"] + 0.5) / (stats[f"d{k}"] + 0.5)))
        f = frequency(F.col("content"), p)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.lit(stats["mean"] or 1.0)))
    return files.withColumn("score", score)


def search_fts(g: Graph, pattern: str, file: str | None = None, limit: int = LINES) -> DataFrame:
    """path, line, text, rank: lines with an alternative verbatim, files by BM25 and path, at most `limit` lines.

    An alternative with a run of under three letters and digits can't be scored by trigrams: files then go by path.
    """
    alts = alternatives(pattern)
    files = g.files.where(F.contains("path", F.lit(file))) if file else g.files
    verbatim = lambda c: any_of([F.contains(c, F.lit(a)) for a in alts])
    short = any(len(r) < 3 for a in alts for r in re.findall(r"[^\W_]+", a))
    rows = files.withColumn("score", F.lit(0.0)) if short or not alts else bm25(files, alts)
    hits = rows.where(verbatim(F.col("content"))).select("path", "score", F.posexplode(F.split("content", "\n")).alias("_i", "text")).where(verbatim(F.col("text")))
    best = [F.col("score").desc(), F.col("path"), F.col("line")]
    return ranked(hits.select("path", "score", (F.col("_i") + 1).alias("line"), "text").orderBy(*best).limit(limit), *best).select("path", "line", "text", "rank")


def search_lines(g: Graph, pattern: str, file: str | None = None, limit: int = LINES) -> DataFrame:
    """path, line, text, rank: lines with a term of an alternative all of whose terms are in the file, case aside.

    Files with more such lines come first. Skipped when there are over MOST_TERMS terms.
    """
    alts = terms_of(pattern)
    files = g.files.where(F.contains("path", F.lit(file))) if file else g.files
    if sum(map(len, alts)) > MOST_TERMS:
        files = files.where("false")
    every = any_of([all_of([contains_ci(F.col("content"), t) for t in ts]) for ts in alts])
    some = any_of([contains_ci(F.col("text"), t) for ts in alts for t in ts])
    hits = lines_of(files.where(every)).where(some)
    counted = hits.withColumn("n", F.count("*").over(Window.partitionBy("path")))
    best = [F.col("n").desc(), F.col("path"), F.col("line")]
    return ranked(counted.orderBy(*best).limit(limit), *best).select("path", "line", "text", "rank")


def search_regex(g: Graph, pattern: str, file_pattern: str | None = None) -> DataFrame:
    """path, line, text: lines that match; ^ and $ are a line's ends."""
    files = g.files.where(F.col("path").rlike(file_pattern)) if file_pattern else g.files
    return lines_of(files).where(F.col("text").rlike(pattern))


def fuse(*lists: tuple[str, DataFrame]) -> DataFrame:
    """path, line, text, score, sources: reciprocal rank fusion of ranked lists (path, line, text, rank)."""
    rows = reduce(DataFrame.unionByName, [d.select("path", "line", "text", "rank", F.lit(name).alias("source")) for name, d in lists])
    first = rows.groupBy("path", "line", "source").agg(F.min("rank").alias("rank"), F.min("text").alias("text"))
    return first.groupBy("path", "line").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"), F.min("text").alias("text"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"))


def proximity(rows: DataFrame, pattern: str) -> DataFrame:
    """rows with score times min(2, 1 + 1 / window): window is the least span of a file's result lines that holds all
    terms of an alternative of two terms or more."""
    alts = [sorted({t.lower() for t in ts if any(c.isalnum() for c in t)}) for ts in terms_of(pattern)]
    alts = [ts for ts in alts if len(ts) > 1]
    if not alts:
        return rows
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    spans, out = [], rows
    for k, ts in enumerate(alts):
        # The latest line of each term up to here: the window that ends here starts at the least of them.
        last = [F.last(F.when(contains_ci(F.col("text"), t), F.col("line")), ignorenulls=True).over(order) for t in ts]
        complete = all_of([x.isNotNull() for x in last])
        out = out.withColumn(f"_w{k}", F.when(complete, F.col("line") - F.least(*last) + 1))
        spans.append(F.min(f"_w{k}"))
    best = F.least(*spans) if len(spans) > 1 else spans[0]
    windows = out.groupBy(F.col("path").alias("_p")).agg(best.alias("_w"))
    joined = rows.join(windows, rows["path"] == F.col("_p"), "left")
    return joined.withColumn("score", F.col("score") * F.when(F.col("_w").isNull(), 1.0).otherwise(F.least(F.lit(2.0), 1.0 + 1.0 / F.col("_w")))).select(*rows.columns)


def lexicon(g: Graph) -> DataFrame:
    """entry: distinct lower-cased symbol names."""
    return g.symbols.select(F.lower("name").alias("entry")).where("entry <> ''").distinct()


def corrections(g: Graph, terms: list[str], edits: int = MOST_EDITS) -> DataFrame:
    """term, corrected: the one lexicon entry nearest to a term within `edits`; none for ties, short or known terms."""
    asked = sorted({t for t in terms if len(t) >= LEAST_LETTERS and any(c.isalnum() for c in t)})
    asked = g.spark.createDataFrame([(t, t.lower(), d) for t in asked for d in range(-edits, edits + 1)], "term string, low string, d int").withColumn("size", F.length("low") + F.col("d"))
    entries = lexicon(g).withColumn("size", F.length("entry"))
    # A query has few terms; entries are compared only if their length is near enough.
    near = entries.join(F.broadcast(asked), "size").withColumn("distance", F.levenshtein("low", "entry", edits)).where("distance >= 0")
    best = near.groupBy("term").agg(F.min("distance").alias("distance"))
    found = near.join(best, ["term", "distance"]).groupBy("term", "distance").agg(F.count("*").alias("n"), F.min("entry").alias("corrected"))
    return found.where("n = 1 and distance > 0").select("term", "corrected")


def search_text(g: Graph, pattern: str, file: str | None = None, limit: int = LINES) -> DataFrame:
    """path, line, text, score, sources, rank: both strategies fused and reranked; see `search_corrected` for typos."""
    rows = proximity(fuse(("fts", search_fts(g, pattern, file, limit)), ("substring", search_lines(g, pattern, file, limit))), pattern)
    return ranked(rows, F.col("score").desc(), F.col("path"), F.col("line"))


def search_corrected(g: Graph, pattern: str, file: str | None = None, limit: int = LINES) -> tuple[DataFrame, dict[str, str], str | None]:
    """Results, corrections made or suggested, and a hint.

    Without results, misspelt terms are replaced and the search runs once more. With results, alternatives none of whose
    terms is in a result line get suggestions only.
    """
    rows, alts = search_text(g, pattern, file, limit), terms_of(pattern)
    if not rows.isEmpty():
        lines = [r["text"].lower() for r in rows.select("text").collect()]
        lost = [t for ts in alts if not any(t.lower() in x for t in ts for x in lines) for t in ts]
        return rows, {r["term"]: r["corrected"] for r in corrections(g, lost).collect()} if lost else {}, None
    made = {r["term"]: r["corrected"] for r in corrections(g, [t for ts in alts for t in ts]).collect()} if alts else {}
    hint = "the pattern looks like a regular expression; use search_regex" if re.search(r"[\\\[\](){}*+?^$]", pattern) else None
    if made:
        rows = search_text(g, "|".join(" ".join(made.get(t, t) for t in ts) for ts in alts), file, limit)
    return rows, made, hint
