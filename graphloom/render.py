"""Rows as text: JSON, compact lines and a token-sparing table notation, and long responses in sections."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a response before it is cut into sections, of the sections kept in all, of a section at least, and the room
#: that a section's header takes when it is read back.
GATE, STORED, LEAST, HEADER = 16 << 10, 4 << 20, 512, 160
FORMATS = ("json", "table", "compact")


def json_rows(df: DataFrame) -> list[str]:
    """Each row as a JSON object; the rows are made on the executors."""
    return [r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def scalar(value) -> str:
    """A cell: bare where it can't be mistaken, else a JSON string."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return f"{value:g}" if isinstance(value, float) else str(value)
    if isinstance(value, list | dict):
        return json.dumps(json.dumps(value, ensure_ascii=False, separators=(",", ":")), ensure_ascii=False)
    plain = re.fullmatch(r"[^\s\",:\[\]{}\\#-][^\",\n\r\\]*", value) and value == value.strip() and not re.fullmatch(r"true|false|null|[-+0-9.eE]+", value)
    return value if plain else json.dumps(value, ensure_ascii=False)


def table(name: str, rows: list[dict]) -> str:
    """name[count]{columns}: and a line for each row. Repository columns that are empty everywhere are left out."""
    if not rows:
        return f"{name}[0]:"
    columns = [c for c in rows[0] if c != "repo" or any(r[c] for r in rows)]
    return "\n".join([f"{name}[{len(rows)}]{{{','.join(columns)}}}:", *("  " + ",".join(scalar(r[c]) for c in columns) for r in rows)])


def render(name: str, df: DataFrame, form: str = "table") -> str:
    if form not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    rows = [json.loads(x) for x in json_rows(df)]
    if form == "json":
        return json.dumps({name: rows}, ensure_ascii=False, separators=(",", ":"))
    return table(name, rows) if form == "table" else "\n".join(" ".join(str(v) for v in r.values() if v not in (None, "")) for r in rows)


@dataclass
class Section:
    title: str
    content: str

    @property
    def size(self) -> int:
        return len(self.content.encode())


def cut_bytes(text: str, most: int) -> str:
    """The start of a text in at most so many bytes, no character split."""
    return text.encode()[:most].decode(errors="ignore")


def by_key(text: str) -> list[Section]:
    """A JSON object by its top-level keys; the parts put together are the text."""
    try:
        pairs = json.loads(text, object_pairs_hook=list)
    except ValueError:
        return []
    if not text.startswith("{") or not isinstance(pairs, list) or not pairs:
        return []
    depth, inside, starts, at = 0, False, [], 0
    while at < len(text):
        c = text[at]
        if inside:
            at += c == "\\"
            inside = c != '"'
        elif c == '"':
            if depth == 1 and text[:at].rstrip()[-1] in "{,":
                starts.append(at)
            inside = True
        else:
            depth += (c in "{[") - (c in "}]")
        at += 1
    cuts = [0, *starts[1:], len(text)]
    return [Section(str(k), text[a:b]) for (k, _), a, b in zip(pairs, cuts, cuts[1:], strict=False)]


def by_block(text: str) -> list[Section]:
    """Tables and blocks after an empty line that aren't indented."""
    out, blank = [], True
    for line in text.splitlines(keepends=True):
        head = re.match(r"[A-Za-z_]\w*(\[\d+\])?(\{[^}]*\})?:", line) or blank and not line[:1].isspace()
        if line.strip() and (head or not out):
            out.append(Section(cut_bytes(line.strip(), 80), line))
        elif out:
            out[-1].content += line
        else:
            out.append(Section("part", line))
        blank = not line.strip()
    return out


def by_size(text: str, most: int) -> list[Section]:
    """Whole lines up to `most` bytes; longer lines are cut."""
    out = [""]
    for line in text.splitlines(keepends=True):
        while len(line.encode()) > most:
            head = cut_bytes(line, most)
            out += [head] if out[-1] else []
            out[-1] = head
            out.append("")
            line = line[len(head) :]
        if len((out[-1] + line).encode()) > most:
            out.append("")
        out[-1] += line
    return [Section(f"part-{k}", x) for k, x in enumerate(x for x in out if x)]


def sections(text: str, limit: int = GATE) -> list[Section]:
    """A long response in titled sections that each fit the limit with their header; small ones join the next."""
    if not text:
        return []
    limit = max(LEAST, limit - HEADER)
    parts = by_key(text) or by_block(text)
    if len(parts) < 2 or any(p.size > limit for p in parts):
        parts = by_size(text, limit)
    out: list[Section] = []
    for p in parts:
        if out and out[-1].size < LEAST and out[-1].size + p.size <= limit:
            out[-1] = Section(p.title, out[-1].content + p.content)
        else:
            out.append(p)
    return out


def kept_responses(chunks: DataFrame, most: int = STORED) -> DataFrame:
    """response_chunks of the newest responses that fit the store together; the newest one always stays."""
    sizes = chunks.groupBy("response_id").agg(F.sum("byte_count").alias("n"), F.max("created_at").alias("at"))
    newest = Window.orderBy(F.col("at").desc(), "response_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = sizes.withColumn("upto", F.sum("n").over(newest)).withColumn("k", F.row_number().over(Window.orderBy(F.col("at").desc(), "response_id"))).where((F.col("upto") <= most) | (F.col("k") == 1))
    return chunks.join(kept.select("response_id"), "response_id", "left_semi")


def manifest(chunks: DataFrame) -> DataFrame:
    """response_id, tool, sections, bytes, created_at."""
    return chunks.groupBy("response_id", "tool").agg(F.count("*").alias("sections"), F.sum("byte_count").alias("bytes"), F.min("created_at").alias("created_at"))


def find_sections(chunks: DataFrame, response_id: str, text: str, limit: int = 10) -> DataFrame:
    """Sections of a response that contain a text, case aside, in order."""
    from graphloom.functions.text import contains_ci

    return chunks.where((F.col("response_id") == response_id) & contains_ci(F.col("content"), text)).orderBy("section_idx").limit(limit)


def usage(calls: DataFrame) -> DataFrame:
    """tool, calls, errors, response_bytes, raw_bytes, saved: the share of the raw bytes that rendering saved, 0 to 1."""
    rows = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.sum("response_bytes").alias("response_bytes"), F.sum("raw_bytes").alias("raw_bytes"))
    saved = F.when(F.col("raw_bytes") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("response_bytes") / F.col("raw_bytes")))).otherwise(0.0)
    return rows.withColumn("saved", saved)
