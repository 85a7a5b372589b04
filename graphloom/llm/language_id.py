"""Language identification of mixed text: script ranges, scores by word, and Viterbi with a switching penalty.

A word is a run of letters. The script of its first letter narrows the languages down to those that were learned with
this script; each gets the word's log-likelihood under its letter trigrams (hashed into BUCKETS counts). The most likely
labelling of a text's words, with `penalty` for every change of language, gives spans; the language of most letters is
the text's. The model is fitted on at most SAMPLE labelled texts for each language, chosen by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import fresh, pieces

SAMPLE, BUCKETS, PENALTY, SMOOTH = 2000, 1 << 18, 12.0, 0.2
#: Characters scored at a time, and scores (words times languages) labelled at a time.
CHUNK, SCORES = 1 << 20, 1 << 22

#: First code points of script ranges that matter for telling languages apart, and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS], np.int16)

_letters = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def lowered(text: str) -> str:
    """Lower case with as many code points: a letter whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def cut_up(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(offset, part): a long text in parts that end after something that isn't a letter, or after size letters."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + size
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def letters_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(code points with 0 for non-letters, places of letters, bucket of each letter's trigram, each letter's text)."""
    low = [lowered(t) for t in texts]
    joined = "\n".join(low) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letter_table()[points], points, 0).astype(np.uint64)
    at = np.flatnonzero(points)
    before = np.where(at > 0, points[at - 1], 0)
    mixed = before * np.uint64(0x9E3779B97F4A7C15) ^ points[at] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[at + 1] * np.uint64(0x165667B19E3779F9)
    bucket = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    ends = np.cumsum([len(t) + 1 for t in low])
    return points, at, bucket.astype(np.int64), np.searchsorted(ends, at, "right")


def scripts_of(points: np.ndarray) -> np.ndarray:
    return SCRIPT_OF[np.searchsorted(STARTS, points, "right") - 1]


class Model:
    """languages in order; table: log-likelihoods (BUCKETS, languages); allowed: (scripts, languages)."""

    def __init__(self, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        n = np.array([counts[x] for x in self.languages], np.float64).reshape(-1, BUCKETS).T
        self.table = np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)
        s = np.array([scripts[x] for x in self.languages], np.float64).reshape(-1, len(NAMES)).T
        # A language is a candidate for a script that has one in a hundred of its letters.
        self.allowed = s * 100 >= np.maximum(s.sum(axis=0), 1)
        self.allowed[~self.allowed.any(axis=1)] = True

    def words(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text, first place, letters, scores by language) of each word; places count from the text's start."""
        out, held, size = [], [], 0
        for i, text in enumerate(texts):
            for at, part in cut_up(text, CHUNK):
                if held and size + len(part) > CHUNK:
                    out.append(self.some_words(held))
                    held, size = [], 0
                held.append((i, at, part))
                size += len(part) + 1
        out.append(self.some_words(held))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def some_words(self, parts: list[tuple[int, int, str]]) -> tuple[np.ndarray, ...]:
        """The words of (text, offset, part)."""
        numbers, offsets, texts = zip(*parts, strict=True)
        points, at, bucket, text = letters_of(texts)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(self.languages)), np.float32)
        starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        scores = np.add.reduceat(self.table[bucket], starts, axis=0)
        scores[~self.allowed[scripts_of(points[at[starts]])]] -= 1000
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])[text[starts]] - np.array(offsets)[text[starts]]
        return np.array(numbers)[text[starts]], at[starts] - begin, np.diff(starts, append=len(at)), scores

    def label(self, text: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
        """The language of each word: Viterbi over all texts at once, word by word."""
        n_words = len(text)
        labels = np.zeros(n_words, np.int16)
        if not n_words:
            return labels
        firsts = np.flatnonzero(np.diff(text, prepend=-1))
        sizes = np.diff(firsts, append=n_words)
        order = np.argsort(-sizes, kind="stable")
        firsts, sizes = firsts[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        best = scores[firsts].copy()
        came = np.zeros((n_words, scores.shape[1]), np.int16)
        stay = np.arange(scores.shape[1], dtype=np.int16)
        final = np.zeros(len(firsts), np.int16)
        for t in range(1, sizes[0]):
            k = active[t]
            if k < len(best):
                final[k : len(best)] = best[k:].argmax(axis=1)
                best = best[:k]
            top = best.argmax(axis=1).astype(np.int16)
            switched = best[np.arange(k), top] - np.float32(penalty)
            at = firsts[:k] + t
            keeps = best >= switched[:, None]
            came[at] = np.where(keeps, stay, top[:, None])
            best = np.where(keeps, best, switched[:, None]) + scores[at]
        final[: len(best)] = best.argmax(axis=1)
        now = final
        for t in range(sizes[0] - 1, -1, -1):
            k = active[t]
            at = firsts[:k] + t
            labels[at] = now[:k]
            if t:
                now[:k] = came[at, now[:k]]
        return labels

    def predict(self, texts: list[str | None], penalty: float, spans: bool) -> tuple[list, list, list, list]:
        """Language, score, number of spans and the spans of each text."""
        n, size = len(texts), max(1, len(self.languages))
        names, scores, counts, found = ["und"] * n, [0.0] * n, [0] * n, [[] for _ in range(n)]
        if not self.languages or not n:
            return names, scores, counts, found
        text, place, letters, likelihood = self.words([t or "" for t in texts])
        if not len(text):
            return names, scores, counts, found
        labels = self.label(text, likelihood, penalty)
        share = np.zeros((n, size))
        np.add.at(share, (text, labels), letters)
        change = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
        total = np.bincount(text[change], minlength=n)
        for i in np.flatnonzero(share.sum(axis=1)):
            k = int(share[i].argmax())
            names[i], scores[i], counts[i] = self.languages[k], float(share[i, k] / share[i].sum()), int(total[i])
        if spans:
            last = np.append(change[1:], len(text)) - 1
            for a, b in zip(change, last, strict=True):
                found[text[a]].append({"from": int(place[a]), "to": int(place[b] + letters[b]), "lang": self.languages[labels[a]]})
        return names, scores, counts, found


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): trigram counts at slots below BUCKETS, script counts above."""
    held: dict = {}
    for batch in pieces(batches, 64):
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            points, at, bucket, _ = letters_of([text])
            slots = held.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
            slots += np.bincount(np.concatenate([bucket, BUCKETS + scripts_of(points[at]).astype(np.int64)]), minlength=len(slots))
    for lang, slots in held.items():
        some = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(slots[some])], names=["lang", "slot", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 11) -> Model:
    """A model from (doc_id, text, lang): at most about `sample` texts of each language, those of the least hash of
    their doc_id. Rows without text or lang aren't used. What comes to the driver is bounded by languages times BUCKETS."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return Model({}, {})
    # Thresholds on a hash of 30 bits, so choosing needs no sort.
    limit = F.create_map(*(F.lit(x) for lang, n in size.items() for x in (lang, min(1 << 30, (sample << 30) // n))))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < limit[F.col("lang")])
    sums = chosen.select("lang", "text").mapInArrow(counted, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts, scripts = {}, {}
    lang = np.array(sums.column("lang").to_pylist(), object)
    slot, n = sums.column("slot").to_numpy(), sums.column("n").to_numpy()
    for name in sorted(set(lang)):
        slots = np.zeros(BUCKETS + len(NAMES), np.int64)
        slots[slot[lang == name]] = n[lang == name]
        counts[name], scripts[name] = slots[:BUCKETS], slots[BUCKETS:]
    return Model(counts, scripts)


#: crc32(doc_id as text) mod FOLDS of the documents that nothing is learned from.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def language_id(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """docs with lang_pred, score, n_spans (and spans, an array of from, to, lang) added; see `predicted` for names.

    lang_pred is the language of most letters, `und` with score 0 if the text is null, has no letter or nothing was
    learned; score is that language's share of the letters. Ties go to the first language in order. Offsets count code
    points. A long text is read in parts of CHUNK characters and labelled as a whole; it takes about ten bytes for each
    character, and for each word six for each language. Without a model, one is fitted to the rows of docs that aren't held out. Every row
    is predicted from its text alone; rows that repeat a doc_id count each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = model or fit(docs.where(~held_out(F.col("doc_id"))))
    shared = spark.sparkContext.broadcast(model)
    names = predicted(docs, spans)
    added = T.StructType.fromDDL("a string, b double, c int, d array<struct<from:int,to:int,lang:string>>").fields
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, added, strict=False))])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        rows = 2048

        def done(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = one.predict(batch.column(place).to_pylist(), penalty, spans)
            types = [pa.string(), pa.float64(), pa.int32(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lang", pa.string())]))]
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(found[: len(names)], types, strict=False))], names=[*batch.schema.names, *names])

        for batch in pieces(batches, rows):
            # Long texts make smaller batches, so the scores of a batch stay bounded but for a single text.
            lengths, begin, size = batch.column(place).fill_null("").to_pylist(), 0, 0
            for i, text in enumerate(lengths):
                if size and (size + len(text)) * max(1, len(one.languages)) > 4 * SCORES:
                    yield done(batch.slice(begin, i - begin))
                    begin, size = i, 0
                size += len(text)
            yield done(batch.slice(begin))

    return docs.mapInArrow(run, schema)


def predicted(docs: DataFrame, spans: bool = False) -> list[str]:
    """The names of the added columns: lang_pred, score, n_spans, spans, with _ in front where docs has them."""
    return [fresh(docs, n) for n in ("lang_pred", "score", "n_spans", "spans")[: 3 + spans]]


def drop_unknown(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without texts that have no language or none with at least `least` of the letters; all columns stay."""
    name, score, _ = predicted(docs)
    return language_id(docs).where((F.col(name) != "und") & (F.col(score) >= least)).select(*docs.columns)
