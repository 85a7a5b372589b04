"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document's counts. Expectation-maximisation over the table of
vote patterns, at most 3 ** rules rows, estimates the share of good documents and for each rule how often it votes
either way on good and on bad ones; the posterior probability of "good" then replaces all-must-pass filtering. The EM
itself is one SQL expression: an aggregate over the iterations whose state is an array of parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE_CLASS, WORD_CLASS, cut

WINDOW, ROUNDS, PRIOR = 8, 25, 0.9
LEAST_WORDS, MOST_REPEATED = 20, 30
#: P(1|good), P(-1|good), P(1|bad), P(-1|bad) of any rule before the first round.
START = (0.8, 0.02, 0.4, 0.3)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the text: windows are hashed, sorted with their places, and runs of
    equal hashes give the places whose windows are then laid over each other."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(places: Column) -> Column:
        n = F.size(places)
        h = lambda i: F.get(places, i)["h"]
        twice = F.filter(places, lambda p, k: ((k > 0) & (h(k - 1) == p["h"])) | ((k < n - 1) & (h(k + 1) == p["h"])))
        starts = F.array_sort(F.transform(twice, lambda p: p["i"]))
        state = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-window).alias("last"))
        step = lambda s, i: F.struct((s["total"] + F.least(F.lit(window), i - s["last"])).alias("total"), i.alias("last"))
        return F.aggregate(starts, state, step, lambda s: s["total"])

    def counted(hashes: Column) -> Column:
        # Few texts repeat a window; only those are sorted.
        places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bound(places, covered)).otherwise(0)

    return F.when(F.size(words) <= window, 0).otherwise(bound(hashes, counted)).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("t")).select("doc_id", "t", F.filter(F.split("t", SPACE_CLASS + "+"), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_CLASS)).alias("lines"))
    number = lambda c: c.cast("long")
    return rows.select(
        "doc_id",
        number(F.size("w")).alias("n_words"),
        number(F.length(F.array_join("w", ""))).alias("word_chars"),
        number(F.regexp_count("t", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        number(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        number(F.size("lines")).alias("n_lines"),
        number(F.size(F.array_distinct("w"))).alias("n_distinct"),
        number(F.regexp_count("t", F.lit(r"\p{Lu}"))).alias("n_upper"),
        number(F.regexp_count("t", F.lit(r"\p{L}"))).alias("n_letters"),
        number(F.regexp_count("t", F.lit(r"[.!?]"))).alias("n_stops"),
        number(F.regexp_count("t", F.lit(r"!!"))).alias("n_shouts"),
    )


def vote(good: Column | None, bad: Column) -> Column:
    """-1, 1 or 0. Most rules only know what bad text looks like and otherwise abstain."""
    found = F.when(bad, -1)
    return (found if good is None else found.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """Name and vote of each rule. Ratios are multiplied out, so nothing is divided by zero."""
    c = F.col
    words, chars, letters = c("n_words"), c("word_chars"), c("n_letters")
    enough = words >= LEAST_WORDS
    return {
        "length": vote(None, ~enough),
        "symbols": vote(enough & (c("n_symbols") * 50 < words), c("n_symbols") * 10 > words),
        "density": vote(None, c("n_symbols") * 50 > chars),
        "letters": vote(enough & (letters * 100 > chars * 93), letters * 100 < chars * 75),
        "repeats": vote(None, c("n_repeat_words") * 100 > words * 25),
        "lines": vote(None, c("n_dup_lines") * 10 > c("n_lines") * 6),
        "variety": vote(None, enough & (c("n_distinct") * 100 < F.least(words, F.lit(400)) * 30)),
        "case": vote(enough & (c("n_upper") * 100 < letters * 12), c("n_upper") * 10 > letters * 3),
        "shouting": vote(None, c("n_shouts") * 5 > words),
        "sentences": vote(enough & c("n_stops").between(words / 50, words / 3), enough & (c("n_stops") * 100 < words)),
    }


def model(patterns: DataFrame, names: list[str], rounds: int = ROUNDS, prior: float = PRIOR) -> DataFrame:
    """One row: params, an array of the share of good documents and, for each rule, P(1|good), P(-1|good), P(1|bad),
    P(-1|bad). Abstaining tells nothing. patterns: a column for each rule and n."""
    size = len(names)
    table = patterns.agg(F.collect_list(F.struct(F.array(*names).alias("v"), F.col("n").cast("double").alias("n"))).alias("p"))
    first = F.array(F.lit(prior), *(F.lit(x) for _ in names for x in START))
    step = lambda s, _: maximised(s, F.col("p"), size)
    return table.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step).alias("params"))


def log_odds(params, votes, size: int) -> Column:
    """Log of P(good | votes) / P(bad | votes). params[i], votes[i]: columns."""
    out = F.log(params[0]) - F.log(1.0 - params[0])
    for r in range(size):
        g1, g2, b1, b2 = (params[1 + 4 * r + k] for k in range(4))
        out = out + F.when(votes[r] == 1, F.log(g1) - F.log(b1)).when(votes[r] == -1, F.log(g2) - F.log(b2)).otherwise(0.0)
    return out


def maximised(params: Column, table: Column, size: int) -> Column:
    """One round of EM. Counts are smoothed towards rules that are right more often than not."""
    p = lambda i: F.get(params, F.lit(i))
    posterior = lambda x: 1.0 / (1.0 + F.exp(-log_odds([p(i) for i in range(1 + 4 * size)], [F.get(x["v"], F.lit(r)) for r in range(size)], size)))
    weighed = F.transform(table, lambda x: F.struct(x["v"].alias("v"), (x["n"] * posterior(x)).alias("g"), x["n"].alias("n")))
    zero = F.array_repeat(F.lit(0.0), 2 + 4 * size)

    def add(s: Column, x: Column) -> Column:
        bad = x["n"] - x["g"]
        parts = [F.get(s, F.lit(0)) + x["g"], F.get(s, F.lit(1)) + x["n"]]
        for r in range(size):
            v = F.get(x["v"], F.lit(r))
            for k, (sign, w) in enumerate(((1, x["g"]), (-1, x["g"]), (1, bad), (-1, bad))):
                parts.append(F.get(s, F.lit(2 + 4 * r + k)) + F.when(v == sign, w).otherwise(0.0))
        return F.array(*parts)

    def shares(s: Column) -> Column:
        g, n = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        out = [(g + 9.0) / (n + 10.0)]
        for r in range(size):
            for k, (of, more) in enumerate(((g, 4.0), (g, 0.5), (n - g, 0.5), (n - g, 4.0))):
                out.append((F.get(s, F.lit(2 + 4 * r + k)) + more) / (of + 10.0))
        return F.array(*out)

    return F.aggregate(weighed, zero, add, shares)


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good, votes for every
    row of docs (doc_id long, text string).

    Words are runs without ASCII white space. A document is kept if it passes the base (20 words, no more than 30 in 100
    repeated) and its posterior probability of being good reaches the threshold. Null and empty texts have no words and
    fail the base. Rows that repeat a doc_id count each. An empty table gives an empty result; other columns are not
    read. The model is fitted to the votes on all rows.
    """
    named = rules()
    names = list(named)
    rows = cut(counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(v.alias(k) for k, v in named.items())))
    params = model(rows.groupBy(*names).agg(F.count("*").alias("n")), names).first()["params"]
    odds = log_odds([F.lit(x) for x in params], [F.col(n) for n in names], len(names))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    good = 1.0 / (1.0 + F.exp(-odds))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (good >= threshold)).alias("kept"), good.alias("p_good"), F.array(*names).alias("votes"))
