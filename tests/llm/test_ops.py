"""Each operator against a plain version over one small table with every awkward row, and over an empty one."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from graphloom.llm import bloom, bpe, chat, exact_dedup, language_id, line_dedup, mixing, quality_lm, quality_rules, simhash, substring_dedup
from graphloom.llm.common import fresh, one_of_each, without

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, _gone int, _plan string, passes string, kept string, lang_pred string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PAIR = "doc_id long, text string, source string"
LINE = "This line is well over forty characters long, Ünïcode too."


def texts():
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta.", "theta", "iota,", "kappa"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(n))
    base = prose(120)
    passage = prose(70)
    out = [None, "", " \t\r\n", "\n\n", "A", "a", "Same Text", "same text", "SAME TEXT", "É", "é", "x" * 5000, base, base, base.replace("alpha", "Alpha", 1), prose(2000), "word " * 300, "日本語 の テキスト", "👍🏽" * 20, "a\x0bb\x0cc\xa0d"]
    out += [f"{prose(5)}\n  {LINE.upper() if k % 2 else LINE} \n{prose(4)}" for k in range(7)]
    out += [f"{prose(9)} {passage} {prose(8)}" for _ in range(3)] + [f"{LINE}\n{LINE}"]
    near = prose(400).split()
    for k in range(4):
        near[k * 50] = "changed"
        out.append(" ".join(near))
    return out + [prose(rng.randrange(1, 60)) for _ in range(25)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None, "s0")[i % 4] if i % 5 else "s1", len(t or ""), "d", 1, "p", "q", "k", "l") for i, t in enumerate(texts())]
    return [*out, (None, "null id", "en", "s1", 7, "d", 1, "p", "q", "k", "l"), out[12], (out[20][0], "same id, other text", "en", "s2", 3, *out[0][5:])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def greatest(ids):
    known = [i for i in ids if i is not None]
    return max(known) if known else None


def test_exact_dedup(docs, none, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = Counter((r[0], greatest(groups[lower(r[1])]), len(groups[lower(r[1])]), r[0] == greatest(groups[lower(r[1])]), hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want
    # Tiny budgets: folds are flushed often, and tries spill subtree by subtree over several rounds.
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, fold=100, budget=600).collect())) == want
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 50)), max_size=40), st.booleans())
def test_trie(pairs, largest):
    trie, want = exact_dedup.Trie(largest), {}
    for text, i in pairs:
        trie.insert(text, i, 1)
        best, n = want.get(text, (i, 0))
        want[text] = ((max if largest else min)(best, i), n + 1)
    assert {t: (b, n) for t, b, n in trie.items()} == want
    if len(want) > 1:
        prefix = trie.heaviest()
        gone = {t: (b, n) for t, b, n in trie.remove(prefix)}
        assert gone and all(t.startswith(prefix) for t in gone)
        assert gone | {t: (b, n) for t, b, n in trie.items()} == want


@pytest.mark.parametrize("limit", [line_dedup.FILTER_BYTES, 0])
def test_line_dedup(docs, none, rows, limit):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n") if len(key(x)) >= 40}:
            holders[k].append(r[0])
    stays = {k: greatest(ids) for k, ids in holders.items() if len(ids) >= 5}
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in stays or stays[key(x)] == r[0]]
        want[r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = line_dedup.line_dedup(docs, filter_bytes=limit)
    assert Counter(tuple(r)[:4] for r in got.collect()) == want
    assert sum(n * k[2] for k, n in want.items()) > 3
    assert line_dedup.line_dedup(none).count() == 0


def test_bloom():
    rng = np.random.default_rng(1)
    held, other = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(0, 2**63, 3000).astype(np.uint64)
    one = bloom.Bloom(1 << 16)
    one.add(held)
    assert one.holds(held).all() and one.holds(other).mean() < 0.02
    small = bloom.Bloom(1 << 20)
    small.add(held)
    folded = small.folded()
    assert folded.bits < small.bits and folded.holds(held).all() and folded.holds(other).mean() < 0.05


def test_sharded_filter(spark):
    """Within its bound, and without a miss however small that is."""
    held, other = (np.random.default_rng(k).integers(-(2**63), 2**63 - 1, 3000) for k in (2, 3))
    df = spark.createDataFrame([(int(x),) for x in held], "x long")
    for limit in (1 << 20, 1 << 12, 0):
        shards, parts = bloom.sharded(df, limit)
        assert sum(len(w) for *_, w in parts) <= max(limit, shards * 8)
        test = bloom.Filter(shards, parts)
        assert test(held.view(np.uint64)).all() and (limit < 1 << 20 or test(other.view(np.uint64)).mean() < 0.02)
    assert not bloom.Filter(*bloom.sharded(df.limit(0), 1 << 20))(held.view(np.uint64)).any()


def slow_fingerprint(text):
    words = lower(text).encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", words) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(docs, none, rows):
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, p in prints:
        least[find(p)].append(i)
    want = Counter((i, f"{p:016x}", min((x for x in least[find(p)] if x is not None), default=None)) for i, p in prints)
    assert Counter(tuple(r)[:3] for r in simhash.simhash(docs).collect()) == want
    assert simhash.simhash(none).count() == 0
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()


@pytest.mark.parametrize("large", [simhash.LARGE, 3])
def test_bit_sliced_links(monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(2)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2}
    got = set()
    for mask in simhash.PAIRS:
        buckets = defaultdict(list)
        for p in prints:
            buckets[p & mask].append(p)
        for group in buckets.values():
            for a, b in simhash.bucket_links(np.array(group, np.uint64), mask):
                got |= {(min(int(x), int(y)), max(int(x), int(y))) for x, y in zip(a, b, strict=True)}
    assert got == want


@pytest.mark.parametrize("most", [simhash.BROADCAST_LINKS, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_LINKS", most)
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in root} == {n: find(n) for n in root}


ALPHABET = st.sampled_from(["a", "b", "the", " ", "  ", "\n", "'", "s", "'re", "1", "23", "é", "ß", "!", "-", "中", "\t", "　", "👍", "\xa0", "²", "_", "\x1c", "\x85"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=80).map("".join))
def test_bpe_tree(text):
    one = bpe.codec(VOCABULARY, PATTERN)
    leaf, window, long = bpe.LEAF, bpe.WINDOW, bpe.LONG_MATCH
    bpe.LEAF, bpe.WINDOW, bpe.LONG_MATCH = 6, 2, 10
    try:
        small = bpe.Codec(VOCABULARY, PATTERN) if not hasattr(test_bpe_tree, "one") else test_bpe_tree.one
        test_bpe_tree.one = small
        ids = small.encode(text)
    finally:
        bpe.LEAF, bpe.WINDOW, bpe.LONG_MATCH = leaf, window, long
    assert ids == one.leaf.encode_ordinary(text)
    assert one.decode(ids) == text.encode()


def test_bpe(docs, none, rows):
    leaf = bpe.codec(VOCABULARY, PATTERN).leaf
    want = Counter()
    for r in rows:
        ids = leaf.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = bpe.encode_decode(docs, VOCABULARY, PATTERN, with_ids=True)
    assert Counter(tuple(r)[:4] for r in got.collect()) == want
    back = bpe.decode(got.withColumnRenamed("n_tokens", "bytes"), VOCABULARY, PATTERN)
    assert all(hashlib.sha256(r["_bytes"]).hexdigest() == r["decoded_sha256"] for r in back.collect())
    assert bpe.encode_decode(none, VOCABULARY, PATTERN).count() == 0


def sainte_lague(votes, seats, most):
    want = [0] * len(votes)
    for _ in range(min(seats, sum(most))):
        open_ = [i for i, v in enumerate(votes) if v and want[i] < most[i]]
        if not open_:
            break
        k = max(open_, key=lambda i: (Fraction(votes[i], 2 * want[i] + 1), -i))
        want[k] += 1
    return want


def plain_mix(df, block):
    """Rows (doc_id, text, source) with the words that each gives, word by word and block by block."""
    seed, shards = mixing.SEED, mixing.SHARDS
    rows = df.select("doc_id", "text", "source", F.xxhash64(F.lit(seed), "doc_id", "text").alias("o"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(shards)).alias("d")).collect()
    size = lambda r: len(WORDS.findall(r["text"] or ""))
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r) for r in rows if r["source"] == s) for s in names]
    targets = mixing.water_level(sum(sizes), sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    quotas = sainte_lague(targets, int(sum(sizes) / Fraction(block) + Fraction(1, 2)), [3 * -(-s // block) for s in sizes])
    out = []
    for name, total, target, quota in zip(names, sizes, targets, quotas, strict=True):
        own, n_shards = [r for r in rows if r["source"] == name], 1
        while n_shards < shards and n_shards * mixing.SHARD_DOCS < len(own) and n_shards * 64 * block < total:
            n_shards *= 2
        by = defaultdict(list)
        for r in sorted(own, key=lambda r: (r["o"], size(r))):
            by[r["d"] % n_shards].append(r)
        keys = sorted(by)
        words = [sum(map(size, by[k])) for k in keys]
        n = [-(-w // block) for w in words]
        parts = sainte_lague(words, quota, [3 * k for k in n])
        for shard, k, q in zip(keys, n, parts, strict=True):
            (_, _, passes, extra, stride, first), = [x for x in mixing.shards_plan("" if name is None else f"={name}", dict(zip(keys, words, strict=True)), block, quota, 3, seed) if x[0] == shard]
            assert passes * k + extra == q and len({(b * stride + first) % k for b in range(k)}) == k
            again = {b for b in range(k) if (b * stride + first) % k < extra}
            at = 0
            for r in by[shard]:
                found = WORDS.findall(r["text"] or "")
                more = [w for i, w in enumerate(found) if (at + i) // block in again]
                at += len(found)
                out.append((r, passes, more, float(target), total))
    return out


@pytest.mark.parametrize("block", [None, 3, 40])
def test_mixing(docs, none, rows, block):
    """Every row, repeated and null doc_ids too, gives the words that a plain plan gives it, and mixed() has just those."""
    size = lambda t: len(WORDS.findall(t or ""))
    got = mixing.mix(docs, block=block)
    want = plain_mix(docs, block or mixing.sources_plan([(s, *x) for s, x in source_sizes(rows).items()])[0][3])
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got.collect()) == Counter((r["doc_id"], size(r["text"]), total, target, passes * size(r["text"]) + len(more)) for r, passes, more, target, total in want)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got.collect())
    again = mixing.mix(docs.repartition(7), block=block)
    assert Counter(again.select("doc_id", "size", "taken").collect()) == Counter(got.select("doc_id", "size", "taken").collect())
    whole = mixing.mixed(docs, block=block)
    assert whole.columns == docs.columns
    text = Counter()
    for r, passes, more, _, _ in want:
        text[r["doc_id"], r["text"]] += passes if size(r["text"]) else 0
        if more:
            text[r["doc_id"], r["text"] if len(more) == size(r["text"]) else " ".join(more)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in whole.collect()) == +text
    assert mixing.mix(none, block=block).count() == 0 and mixing.mixed(none, block=block).count() == 0


def source_sizes(rows):
    out = {}
    for r in rows:
        n, w = out.get(r[3], (0, 0))
        out[r[3]] = (n + 1, w + len(WORDS.findall(r[1] or "")))
    return out


def test_mixing_repeated_rows(spark):
    """Rows with one doc_id, or none, are planned and taken one by one."""
    rows = [(1, f"w{k} " * 20, "a") for k in range(21)] + [(None, "null id " * 10, "b")] * 9 + [(2, "same row " * 9, "b")] * 5
    df = spark.createDataFrame(rows, PAIR)
    planned = Counter()
    for r in mixing.mix(df, block=7).collect():
        planned[r["doc_id"]] += r["taken"]
    taken = Counter()
    for r in mixing.mixed(df, block=7).collect():
        taken[r["doc_id"]] += len(WORDS.findall(r["text"]))
    assert taken == planned and sum(taken.values()) > 0


def test_mixing_near_targets(spark):
    rows = [(i, "w " * (i % 97 + 1), f"s{i % 7}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[f"s{r['doc_id'] % 7}"] += r["taken"]
        target[f"s{r['doc_id'] % 7}"] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 20 for s in target)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague(votes, seats):
    most = [9] * len(votes)
    assert mixing.apportion([Fraction(v) for v in votes], seats, most) == sainte_lague(votes, seats, most)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8))
def test_water_level(sizes):
    shares = mixing.water_level(sum(sizes), sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert sum(shares) == sum(sizes)
    assert all(0 <= share <= 3 * size for share, size in zip(shares, sizes, strict=True))


def test_quality_rules(docs, none, rows):
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = WORDS.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    got = quality_rules.quality_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_rules_learn(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["there", "was", "a", "quiet", "house.", "by", "some", "river", "and", "trees"]) + rng.choice("abcdefgh") for _ in range(n)) + "."
    good = [(i, ". ".join(prose(12) for _ in range(8))) for i in range(180)]
    bad = [(200 + i, " ".join(w + "###" for w in prose(80).split())) for i in range(12)] + [(300 + i, " ".join(w.upper() + "!!" for w in prose(80).split())) for i in range(12)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def plain_votes(text):
    """The rules' votes on one text, counted with Python's own means."""
    words, t = WORDS.findall(text or ""), text or ""
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeats = len({j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t))
    letters, upper = len(regex.findall(r"\p{L}", t)), len(regex.findall(r"\p{Lu}", t))
    stops, shouts, enough = len(re.findall(r"[.!?]", t)), t.count("!!"), n >= 20
    pick = lambda good, bad: -1 if bad else 1 if good else 0
    votes = [
        pick(False, not enough), pick(enough and symbols * 50 < n, symbols * 10 > n), pick(False, symbols * 50 > chars), pick(enough and letters * 100 > chars * 93, letters * 100 < chars * 75), pick(False, repeats * 100 > n * 25),
        pick(False, (len(lines) - len(set(lines))) * 10 > len(lines) * 6), pick(False, enough and len(set(words)) * 100 < min(n, 400) * 30), pick(enough and upper * 100 < letters * 12, upper * 10 > letters * 3), pick(False, shouts * 5 > n),
        pick(enough and n / 50 <= stops <= n / 3, enough and stops * 100 < n),
    ]
    return votes, n < 20 or 100 * repeats > 30 * n


def plain_posteriors(votes):
    """P(good) of each row of votes after 25 rounds of expectation-maximisation, row by row."""
    size = len(votes[0])
    share, rates = 0.9, [list(quality_rules.START) for _ in range(size)]

    def posterior(row):
        good, bad = share, 1 - share
        for v, (g1, g2, b1, b2) in zip(row, rates, strict=True):
            if v:
                good, bad = good * (g1 if v == 1 else g2), bad * (b1 if v == 1 else b2)
        return good / (good + bad)

    for _ in range(25):
        p = [posterior(row) for row in votes]
        good, bad = sum(p), len(p) - sum(p)
        share = (good + 9) / (len(p) + 10)
        new = []
        for r in range(size):
            sums = [sum(w for row, w in zip(votes, ws, strict=True) if row[r] == v) for ws in (p, [1 - x for x in p]) for v in (1, -1)]
            new.append([(s + more) / (of + 10) for s, of, more in zip(sums, (good, good, bad, bad), (4.0, 0.5, 0.5, 4.0), strict=True)])
        rates = new
    return [posterior(row) for row in votes]


def test_quality_rules_em(docs, rows):
    """Votes, posteriors and verdicts are those of the rules and the EM written out plainly."""
    got = quality_rules.quality_rules(docs).collect()
    plain = [plain_votes(r[1]) for r in rows]
    good = plain_posteriors([v for v, _ in plain])
    want = Counter((r[0], tuple(v), not failed and p >= 0.5, round(p, 6)) for r, (v, failed), p in zip(rows, plain, good, strict=True))
    assert Counter((r["doc_id"], tuple(r["votes"]), r["kept"], round(r["p_good"], 6)) for r in got) == want
    assert len({k[2] for k in want}) == 2


def plain_language(texts, labelled, penalty):
    """(language, score) of each text: counts of trigrams by name, scores letter by letter, labels word by word."""

    def words_of(text):
        text = (text or "").lower()
        return [[text[k - 1 : k + 2].ljust(2 + (k > 0)) if k else " " + text[:2] for k in range(m.start(), m.end())] for m in re.finditer(r"[^\W\d_]+", text)]

    blank = lambda gram: "".join(c if c.isalpha() else "\0" for c in gram.ljust(3))
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    script = lambda c: language_id.SCRIPTS[max(i for i, (first, _) in enumerate(language_id.SCRIPTS) if first <= ord(c))][1]
    for text, lang in labelled:
        for word in words_of(text):
            counts[lang].update(map(blank, word))
            scripts[lang].update(script(gram[1]) for gram in word)
    names = sorted(counts)
    used = Counter()
    for c in scripts.values():
        used.update(c)
    out = []
    for text in texts:
        best, came, letters = {}, [], []
        for word in words_of(text):
            here, score = script(word[0][1]), {}
            allowed = [x for x in names if scripts[x][here] * 100 >= max(used[here], 1)] or names
            for x in names:
                total = sum(counts[x].values()) + language_id.SMOOTH * language_id.BUCKETS
                score[x] = sum(np.log((counts[x][blank(g)] + language_id.SMOOTH) / total) for g in word) - (0 if x in allowed else 1000)
            top = max(names, key=lambda x: (best.get(x, 0), -names.index(x)))
            from_ = {x: x if not best or best[x] >= best[top] - penalty else top for x in names}
            best = {x: score[x] + (0 if not best else best[x] if from_[x] == x else best[top] - penalty) for x in names}
            came.append(from_)
            letters.append(len(word))
        if not letters:
            out.append(("und", 0.0))
            continue
        label, share = max(names, key=lambda x: (best[x], -names.index(x))), Counter()
        for k in range(len(letters) - 1, -1, -1):
            share[label] += letters[k]
            label = came[k][label]
        name = max(names, key=lambda x: (share[x], -names.index(x)))
        out.append((name, share[name] / sum(letters)))
    return out


def test_language_matches_plain_model(spark):
    """lang_pred and score of every row are those of the model, the labelling and the shares written out plainly."""
    vocabulary = {"aa": ["banana", "kana", "mabana", "lana"], "bb": ["thrix", "oplix", "grix"], "ru": ["слово", "дело"], "el": ["λόγος"]}
    rng = random.Random(4)
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", ".", "1", "\n"]) for _ in range(n))
    rows = [(i, say(lang, 12), lang) for i, lang in enumerate(["aa", "bb", "ru", "el"] * 15)]
    rows += [(100 + i, " ".join(say(rng.choice(list(vocabulary)), rng.randrange(1, 9)) for _ in range(4)), None) for i in range(40)] + [(200, None, "aa"), (201, "7 !", None), (202, "BANANA Дело", None), (203, "漢字", None), (None, "kana", None)]
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], round(r["score"], 9)) for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    labelled = [(t, lang) for i, t, lang in rows if i is not None and lang and t and zlib.crc32(str(i).encode()) % 4 != 2]
    want = plain_language([t for _, t, _ in rows], labelled, language_id.PENALTY)
    assert got == {(i, t): (lang, round(score, 9)) for (i, t, _), (lang, score) in zip(rows, want, strict=True)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_language_held_out_accuracy(spark):
    rows = language_id.language_id(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und")).collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_chat(spark):
    hello, long = ("user", "hello"), [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(600)]
    logs = {1: [hello], 2: [hello, ("assistant", "hi")], 3: [hello, ("assistant", "hi"), ("user", None)], 4: [hello, ("assistant", "hi"), ("user", "")], 5: [hello, ("assistant", "hi"), ("user", None)], 6: long, 7: long[:300], 8: long[:299] + [("user", "other")], 9: [(None, None)], None: [("user", "no id")], 10: [("user", "same"), ("user", "same")], 11: [("user", "same")]}
    turns = [(c, t, *x, "extra") for c, ts in logs.items() for t, x in enumerate(ts)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, k string").repartition(5)
    got = {r["conv_id"]: r for r in chat.chat(df).collect()}
    keep = {c for c, x in logs.items() if not any(len(y) > len(x) and y[: len(x)] == x or y == x and c is not None and (d is None or d < c) for d, y in logs.items() if d != c)}
    assert set(got) == keep
    for c in keep:
        assert got[c]["n_turns"] == len(logs[c])
        assert got[c]["rendered"] == "".join(f"<|{role or ''}|>\n{text or ''}\n<|end|>\n" for role, text in logs[c])
    assert chat.chat(df.limit(0)).count() == 0


def test_language(spark):
    words = {"aa": ["banana", "kana", "mabana"], "bb": ["thrix", "oplix", "grix"], "ru": ["слово", "дело"]}
    rng = random.Random(6)
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(["aa", "bb", "ru"] * 40)]
    rows += [(900, None, None), (901, "12 34 !!", "aa"), (902, "", None), (903, say("aa", 20) + " " + say("bb", 30) + " " + say("ru", 5), None), (904, "x", None), (None, say("bb", 9), None), (905, say("ru", 40000), None)]
    df = spark.createDataFrame([(*r, "s", "t") for r in rows], "doc_id long, text string, lang string, lang_pred string, score string").repartition(3)
    got = {r["doc_id"]: r for r in language_id.language_id(df, spans=True).collect()}
    assert all(got[i]["_lang_pred"] == lang and got[i]["_score"] == 1 for i, _, lang in rows[:120])
    assert all(got[i]["_lang_pred"] == "und" and got[i]["_score"] == 0 for i in (900, 901, 902))
    assert [s["lang"] for s in got[903]["spans"]] == ["aa", "bb", "ru"] and got[903]["_lang_pred"] == "bb"
    assert got[905]["_lang_pred"] == "ru"
    first = got[903]["spans"][0]
    assert set(rows[-4][1][first["from"] : first["to"]].split()) <= set(words["aa"])
    assert language_id.language_id(df.limit(0)).count() == 0
    kept = language_id.drop_unknown(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    folds = spark.range(50).select(language_id.held_out(F.col("id")).alias("h")).collect()
    assert [r["h"] for r in folds] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)]


def test_language_in_parts(monkeypatch):
    """A text read in parts gives what it gives as a whole; offsets count the original's code points."""
    import pyarrow as pa

    counts, scripts = {}, {}
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "bb"]), pa.array(["banana kana mabana " * 9, "thrix oplix grix " * 9])], names=["lang", "text"])
    for rows in language_id.counted(iter([batch])):
        lang, slots = rows.column(0)[0].as_py(), np.zeros(language_id.BUCKETS + len(language_id.NAMES), np.int64)
        slots[rows.column(1).to_numpy()] = rows.column(2).to_numpy()
        counts[lang], scripts[lang] = slots[: language_id.BUCKETS], slots[language_id.BUCKETS :]
    model = language_id.Model(counts, scripts)
    texts = ["banana kana\nmabana! thrix oplix grix thrix grix", "", None, "İİİ banana kana banana", "x" * 40, "kana"]
    whole = model.predict(texts, 2.0, True)
    assert [s["lang"] for s in whole[3][0]] == ["aa", "bb"] and texts[3][whole[3][3][0]["from"] : whole[3][3][0]["to"]].endswith("kana banana")
    monkeypatch.setattr(language_id, "CHUNK", 16)
    got = model.predict([t for t in texts if t != "x" * 40], 2.0, True)
    assert got == tuple([x for x, t in zip(column, texts, strict=True) if t != "x" * 40] for column in whole)
    assert "".join(part for _, part in language_id.cut_up("x" * 40, 16)) == "x" * 40


def test_viterbi_matches_search():
    rng = np.random.default_rng(0)
    model = language_id.Model({"a": np.ones(language_id.BUCKETS, np.int64), "b": np.ones(language_id.BUCKETS, np.int64)}, {"a": np.ones(len(language_id.NAMES)), "b": np.ones(len(language_id.NAMES))})
    text = np.repeat([0, 1, 2], [6, 1, 4])
    scores = rng.normal(size=(11, 2)).astype(np.float32) * 3
    labels = model.label(text, scores, 2.0)
    for t in range(3):
        own = scores[text == t]
        best = max(range(2 ** len(own)), key=lambda c: sum(own[i, c >> i & 1] for i in range(len(own))) - 2 * sum((c >> i & 1) != (c >> (i + 1) & 1) for i in range(len(own) - 1)))
        assert [best >> i & 1 for i in range(len(own))] == list(labels[text == t])


def word_hash(word):
    low = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c for c in word.encode()), np.uint8)
    return int(substring_dedup.mixed(np.array([((low.astype(np.uint64) + np.uint64(1)) * substring_dedup.PLACE[np.arange(len(low)) & 1023]).sum(dtype=np.uint64) + np.uint64(len(low))]))[0])


def slow_units(text):
    """(w, words, a, b, line, part): lines (part is None) and parts by the same rule, window by window; digests are words."""
    out, at, w = [], 0, 0
    for line in (text or "").split("\n"):
        found = [(m.start() + at, m.end() + at, lower(m.group()), word_hash(m.group())) for m in WORDS.finditer(line)]
        at += len(line) + 1
        if not found:
            continue
        size, whole = substring_dedup.WINDOW, tuple(x[2] for x in found)
        out.append((w, len(found), found[0][0], found[-1][1], whole, None))
        ends = {len(found) - 1} | {max(range(i, i + size), key=lambda k: (-found[k][3], k)) for i in range(len(found) - size)}
        first, parts = 0, []
        for k in sorted(ends):
            parts.append((w + first, k + 1 - first, found[first][0], found[k][1], tuple(x[2] for x in found[first : k + 1])))
            first = k + 1
        turn, had = 0, Counter()
        for k, (*where, words) in enumerate(parts):
            turn = turn + 1 if k and parts[k - 1][4] == words else 0
            out.append((*where, (whole, had[words, turn]), (words, turn)))
            had[words, turn] += 1
        w += len(found)
    return out


def slow_substring_dedup(rows, least, least_parts):
    """Spans of each (doc_id, text, row)."""
    place = lambda r, u: (r[0] is None, r[0] or 0, r[2], u[0])
    units = [(r, u) for r in rows for u in slow_units(r[1])]
    lines, parts, marks = defaultdict(list), defaultdict(list), defaultdict(set)
    for r, u in units:
        if u[5] is None:
            lines[u[4]].append(place(r, u))
        else:
            parts[u[5]].append(place(r, u))
            marks[u[5]].add(u[4])
    out = []
    for r in rows:
        lost, by_line = set(), set()
        for u in slow_units(r[1]):
            mine = range(u[0], u[0] + u[1])
            if u[5] is None and min(lines[u[4]]) != place(r, u):
                by_line.update(mine)
            elif u[5] is not None and len(marks[u[5]]) > 1 and min(parts[u[5]]) != place(r, u):
                lost.update(mine)
        every = [(m.start(), m.end()) for m in WORDS.finditer(r[1] or "")]
        spans, run = [], []
        for k in range(len(every) + 1):
            if k in lost or k in by_line:
                run.append(k)
            elif run:
                if len(run) >= least_parts or len(run) >= least and by_line & set(run):
                    spans.append((every[run[0]][0], every[run[-1]][1], len(run)))
                run = []
        out.append((r[0], len(spans), sum(n for *_, n in spans), tuple(spans)))
    return Counter(out)


@pytest.mark.parametrize(("least", "least_parts"), [(1, 30), (30, 30), (5, 12)])
def test_substring_dedup(docs, none, least, least_parts):
    rows = docs.select("doc_id", "text", F.xxhash64("text")).collect()
    got = Counter((r["doc_id"], r["n_removed"], r["words_removed"], tuple(map(tuple, r["spans"]))) for r in substring_dedup.substring_dedup(docs, least, least_parts).collect())
    want = slow_substring_dedup(rows, least, least_parts)
    assert got == want and sum(k[1] for k in want) >= 4
    assert substring_dedup.substring_dedup(none, least, least_parts).count() == 0
    short = substring_dedup.cut_spans(docs, least, least_parts)
    assert short.columns == docs.columns and short.count() == docs.count()


def pasted(seed, size=51):
    """Pairs of texts without a line end that share a passage of size words in mid-line, and nothing else."""
    rng = random.Random(seed)
    some = lambda n: [f"{rng.choice('qxzvk')}{rng.randrange(10**9)}" for _ in range(n)]
    for _ in range(40):
        passage, around = some(size), [some(rng.randrange(1, 40)) for _ in range(4)]
        yield " ".join(around[0] + passage + around[1]), " ".join(around[2] + passage + around[3])


def test_substring_dedup_pasted(spark):
    """Each passage of 51 words pasted into the middle of a line is found in the later text; 30 words of it at least, and
    no word beside it but what was glued on, are taken out."""
    pairs = list(pasted(3))
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert len(found) == 2 * len(pairs)
    for i, (early, late) in enumerate(pairs):
        assert found[2 * i]["n_removed"] == 0
        assert found[2 * i + 1]["n_removed"] == 1 and 30 <= found[2 * i + 1]["words_removed"] <= 51
        (a, b, n), = found[2 * i + 1]["spans"]
        assert late[a:b] in early and len(late[a:b].split()) == n
    # The same within one text, in mid-line; a word said over and over is no repeat of itself.
    one = [(k, " ".join(p)) for k, p in enumerate(pairs)] + [(1000, "word " * 300)]
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(spark.createDataFrame(one, "doc_id long, text string")).collect()}
    assert found.pop(1000) == 0 and set(found.values()) == {1}


def slow_kneser_ney(texts, order):
    """Probability of each byte after its context, by the formulas."""
    grams = Counter()
    for t in texts:
        padded = b"\0" * (order - 1) + t
        grams.update(padded[i : i + order] for i in range(len(t)))
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    ds = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        ds[n] = [min(max(d, 0.1 * k), 0.95 * k) for k, d in enumerate(raw, 1)]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        mates = {g: v for g, v in counts[n].items() if g[:-1] == gram[:-1]}
        if not mates:
            return p(gram[1:])
        total = sum(mates.values())
        gamma = sum(ds[n][min(v, 3) - 1] for v in mates.values()) / total
        c = mates.get(gram, 0)
        return (c - ds[n][min(c, 3) - 1] if c else 0) / total + gamma * p(gram[1:])

    return p


def test_kneser_ney(spark):
    rng = random.Random(8)
    make = lambda: "".join(rng.choice("abcde ") for _ in range(60))
    rows = [(i, make(), "xx") for i in range(40)] + [(100, "zzzz \x00é", "xx"), (101, "", "xx"), (102, None, "xx"), (103, "abc", None), (104, "abc", "yy"), (None, "abcab", "xx"), (3, "other text with id three", "xx"), (105, "abc", "xx"), (105, "abc", "xx")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, perplexity string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(None,), (3,)], "doc_id long")
    held = {r["id"] for r in spark.range(200).where("pmod(xxhash64(5, id), 5) = 0").collect()}
    p = slow_kneser_ney([t.encode() for i, t, lang in rows if i is not None and i < 30 and i not in held and lang == "xx"], 3)
    want = Counter()
    for i, t, lang in rows:
        b = (t or "").encode()
        padded = b"\0\0" + b
        value = round(float(np.exp(-sum(np.log(p(padded[k : k + 3])) for k in range(len(b))) / len(b))), 4) if b and lang == "xx" else None
        want[i, value] += 1
    both = [quality_lm.quality_lm(df, trusted, order=3, limit=limit).collect() for limit in (quality_lm.BROADCAST_ROWS, 0)]
    # The same bits either way, so no document's verdict depends on the tables' size.
    assert Counter(map(tuple, both[0])) == Counter(map(tuple, both[1]))
    for got in both:
        assert Counter((r["doc_id"], None if r["perplexity"] is None else round(r["perplexity"], 4)) for r in got) == want
        assert not any(r["kept"] for r in got if r["perplexity"] is None or r["doc_id"] == 100)
    assert quality_lm.quality_lm(df.limit(0), trusted, order=3).count() == 0
    assert quality_lm.quality_lm(df, trusted.limit(0), order=3).where("kept").count() == 0


def test_without(spark, docs, rows):
    ids = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    for limit in (10, 0):
        left = without(docs, ids, limit)
        assert left.columns == docs.columns
        assert Counter(r["doc_id"] for r in left.collect()) == Counter(r[0] for r in rows if r[0] not in (1, None))
    assert fresh(docs, "TEXT") == "_TEXT"


def test_drop_by_row(spark):
    """Both stages keep exactly one row of each group, whatever other rows have its doc_id or none."""
    letters = ["alpha bravo", "charlie delta", "echo foxtrot golf", "hotel india", "juliett kilo lima", "mike november"]
    a, b, c, d, e, f = (" ".join(f"{w}{k}" for k in range(30) for w in x.split()) for x in letters)
    rows = [(5, a, "s"), (9, a, "s"), (5, b, "s"), (None, a, "s"), (None, c, "s"), (None, d, "s"), (None, d, "t"), (None, d, "s"), (7, e, "s"), (7, e, "s"), (7, e.upper(), "s"), (8, f, "t"), (8, f, "s")]
    docs = spark.createDataFrame(rows, PAIR).repartition(3)
    exact = Counter((r["doc_id"], lower(r["text"])) for r in exact_dedup.drop_copies(docs).collect())
    assert exact == Counter([(9, a), (5, b), (None, c), (None, d), (7, e), (8, f)])
    assert Counter(r["doc_id"] for r in exact_dedup.drop_copies(docs, "smallest").collect()) == Counter([5, 5, None, None, 7, 8])
    near = Counter((r["doc_id"], lower(r["text"])) for r in simhash.drop_near(docs).collect())
    assert near == Counter([(5, a), (5, b), (None, c), (None, d), (7, e), (8, f)])
    assert {r["source"] for r in exact_dedup.drop_copies(docs.where("doc_id = 8")).collect()} == {"s"}
    # Above the limit for a broadcast, and with one group over several texts of a doc_id.
    decided = docs.select("doc_id", F.xxhash64("text").alias("row"), F.lit(1).alias("group"), F.lit(True).alias("first"))
    for limit in (100, 0):
        assert one_of_each(docs, decided, limit).count() == 1


def test_pipeline(spark, docs, none):
    import corpus_pipeline

    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language_id", "exact_dedup", "simhash", "mixing", "bpe"]
    plain = docs.dropDuplicates(["doc_id"])
    for start in (plain, none):
        now = start
        for k, (_, stage) in enumerate(stages):
            after = stage(spark, now, "")
            if k < len(stages) - 1:
                assert after.columns == start.columns
                after = spark.createDataFrame(after.collect(), after.schema)
            now = after
        assert now.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (now.count() > 0) == (start is plain)


def test_pipeline_run(spark, docs, tmp_path):
    """run() gives what the stages give one by one; near copies and equal texts are gone, sizes follow the mix."""
    import corpus_pipeline

    plain = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in got) == Counter((r["doc_id"], r["ids_sha256"]) for r in now.collect())
    texts = {r["doc_id"]: r["text"] for r in plain.collect()}
    ids = {r["doc_id"] for r in got}
    assert len({lower(texts[i]) for i in ids}) == len(ids)
    prints = [slow_fingerprint(texts[i]) for i in ids]
    assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[k + 1 :])
    assert all(re.search(r"[^\W\d_]", texts[i]) for i in ids)


def test_pipeline_matches_plain(spark, docs, tmp_path):
    """run() over rows with repeated and null ids against the stages written out plainly, in their order."""
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # Language ID has its own plain version; what it keeps is taken over.
    now = [(r["doc_id"], r["text"], r["source"]) for r in language_id.drop_unknown(read).collect()]
    least = lambda rows: min(rows, key=lambda r: (row_hash[r[1]], str(r)))
    row_hash = {r["text"]: r["h"] for r in read.select("text", F.xxhash64("text").alias("h")).collect()}
    groups = defaultdict(list)
    for r in now:
        groups[lower(r[1])].append(r)
    now = [least([r for r in g if r[0] == greatest([x[0] for x in g])]) for g in groups.values()]
    prints = [slow_fingerprint(r[1]) for r in now]
    root = list(range(len(now)))
    for i in range(len(now)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    parts = defaultdict(list)
    for r, k in zip(now, root, strict=True):
        parts[k].append(r)
    smallest = lambda g: min((r[0] for r in g if r[0] is not None), default=None)
    now = [least([r for r in g if r[0] == smallest(g)]) for g in parts.values()]
    left = spark.createDataFrame(now, PAIR)
    block = mixing.sources_plan([(s, *x) for s, x in source_sizes([(r[0], r[1], None, r[2]) for r in now]).items()])[0][3]
    leaf, want = bpe.codec(VOCABULARY, PATTERN).leaf, Counter()
    for r, passes, more, _, _ in plain_mix(left, block):
        whole = len(more) == len(WORDS.findall(r["text"]))
        for text in [r["text"]] * passes + ([r["text"] if whole else " ".join(more)] if more else []):
            ids = leaf.encode_ordinary(text)
            want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want and len(want) > 20
