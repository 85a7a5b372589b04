"""Column functions over names, refs and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ci(column: Column, pattern: str) -> Column:
    """LIKE '%pattern%' with %, _ and \\ taken literally and ASCII letters compared without case."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(fold(column), fold(F.lit(pattern)))


def short_name(ref: Column) -> Column:
    """What follows the last dot; the whole ref without one."""
    return F.substring_index(ref, ".", -1)


def owner_name(ref: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.when(F.contains(ref, F.lit(".")), F.substring(ref, F.lit(1), F.length(ref) - F.length(short_name(ref)) - 1)).otherwise("")


def prefixes(ref: Column, *separators: str) -> Column:
    """The ref and every part of it that ends before one of the separators, as an array."""
    ends = F.filter(F.sequence(F.lit(1), F.length(ref)), lambda i: F.substring(ref, i, F.lit(1)).isin(*separators))
    return F.array_append(F.transform(ends, lambda i: F.substring(ref, F.lit(1), i - 1)), ref)


def suffixes(path: Column) -> Column:
    """The path and every part of it that starts after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def is_test_file(path: Column) -> Column:
    return F.endswith(path, F.lit("_test.go"))


def is_test_entry(name: Column) -> Column:
    return F.startswith(name, F.lit("Test")) | F.startswith(name, F.lit("Benchmark")) | F.startswith(name, F.lit("Fuzz"))


def is_generated_file(path: Column, content: Column) -> Column:
    """By marker comment or by the file's name."""
    base = F.substring_index(path, "/", -1)
    named = F.endswith(base, F.lit(".pb.go")) | F.endswith(base, F.lit("_string.go")) | F.startswith(base, F.lit("mock_")) | F.endswith(base, F.lit("_mock.go")) | F.startswith(base, F.lit("zz_generated"))
    return named | content.rlike(r"(?m)^// Code generated .* DO NOT EDIT\.$")


def first_sentence(doc: Column) -> Column:
    """Up to and with the first full stop before white space or the end; lines joined."""
    flat = F.trim(F.regexp_replace(doc, r"\s+", " "))
    found = F.regexp_extract(flat, r"^(.*?\.)(?:\s|$)", 1)
    return F.when(found == "", flat).otherwise(found)


def cut_at_word(text: Column, most: int) -> Column:
    """Texts over `most` characters end at the last blank within them, with an ellipsis."""
    head = F.substring(text, 1, most)
    word = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r"\s+\S*$", "")).otherwise(head)
    return F.when(F.length(text) > most, F.concat(word, F.lit("…"))).otherwise(text)


def mentions(text: Column, name: Column) -> Column:
    """Whether name stands in text as a whole identifier."""
    quoted = F.regexp_replace(name, r"([.\\+*?\[^\]$(){}=!<>|:\-#/])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])"), quoted, F.lit(r"(?![A-Za-z0-9_])")))
