"""Workspace configuration: members, contract settings and custom extractors; problems are told, never skipped."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from graphloom.operators.runtime import DEFAULTS, NORMALIZERS, Extractor, merged

try:
    import yaml
except ImportError:  # JSON, a subset of YAML, is read without it
    yaml = None


class ConfigError(ValueError):
    pass


@dataclass
class Workspace:
    members: dict[str, str]
    missing: list[str] = field(default_factory=list)
    suppress: list[tuple[str, str]] = field(default_factory=list)
    threshold: float = 0.5
    extractors: tuple[Extractor, ...] = DEFAULTS


KEYS = {"members", "contracts"}
CONTRACT_KEYS = {"suppress", "confidence_threshold", "runtime_extractors"}
EXTRACTOR_KEYS = {"kind", "name", "producer_methods", "consumer_methods", "imports_match", "config_patterns", "literal_patterns", "const_prefix", "decode_switch", "arg_index", "normalize", "normalize_rules"}


def known(given: dict, allowed: set[str], where: str) -> None:
    if not isinstance(given, dict):
        raise ConfigError(f"{where}: expected a mapping")
    if extra := sorted(set(given) - allowed):
        raise ConfigError(f"{where}: unknown keys {', '.join(extra)}")


def load(path: str) -> Workspace:
    """The workspace of a YAML (or JSON) file. Member folders are relative to it; absent ones are listed as missing."""
    with open(path) as f:
        text = f.read()
    try:
        data = yaml.safe_load(text) if yaml else json.loads(text)
    except Exception as e:
        raise ConfigError(f"{path}: {e}") from e
    known(data or {}, KEYS, path)
    members, missing, base = {}, [], os.path.dirname(os.path.abspath(path))
    if not (data or {}).get("members"):
        raise ConfigError(f"{path}: no members")
    for member in data["members"]:
        folder = os.path.normpath(os.path.join(base, member))
        if not os.path.isdir(folder):
            missing.append(folder)
            continue
        name = read_module(folder)
        if name in members:
            raise ConfigError(f"{path}: {name} is a member twice")
        members[name] = folder
    contracts = data.get("contracts") or {}
    known(contracts, CONTRACT_KEYS, f"{path}: contracts")
    threshold = contracts.get("confidence_threshold", 0.5)
    if not isinstance(threshold, int | float) or not 0 <= threshold <= 1:
        raise ConfigError(f"{path}: confidence_threshold must be 0 to 1")
    pairs = []
    for entry in contracts.get("suppress") or []:
        names = entry.split("<->") if isinstance(entry, str) else entry
        if len(names) != 2 or not all(n.strip() for n in names):
            raise ConfigError(f"{path}: suppress wants two refs, not {entry!r}")
        pairs.append((names[0].strip(), names[1].strip()))
    custom = tuple(extractor(e, path) for e in contracts.get("runtime_extractors") or [])
    return Workspace(members, missing, pairs, float(threshold), merged(DEFAULTS, custom))


def extractor(given: dict, path: str) -> Extractor:
    known(given, EXTRACTOR_KEYS, f"{path}: runtime_extractors")
    if not given.get("kind"):
        raise ConfigError(f"{path}: an extractor needs a kind")
    if given.get("normalize", "raw") not in NORMALIZERS:
        raise ConfigError(f"{path}: normalize must be one of {', '.join(NORMALIZERS)}")
    rules = tuple((r["match"], r["replace"]) for r in given.get("normalize_rules", []))
    for pattern in [*given.get("config_patterns", []), *given.get("literal_patterns", []), *(r[0] for r in rules)]:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ConfigError(f"{path}: {pattern!r}: {e}") from e
    names = {"producer_methods": "producers", "consumer_methods": "consumers", "imports_match": "imports", "config_patterns": "config", "literal_patterns": "literals"}
    return Extractor(given["kind"], given.get("name", ""), **{to: tuple(given.get(key, ())) for key, to in names.items()}, const_prefix=given.get("const_prefix", ""), decode_switch=bool(given.get("decode_switch")), argument=int(given.get("arg_index", 0)), normalize=given.get("normalize", "raw"), rules=rules)


def read_module(folder: str) -> str:
    """The module path of a folder's go.mod."""
    try:
        with open(os.path.join(folder, "go.mod")) as f:
            found = re.search(r"^module\s+(\S+)", f.read(), re.M)
    except FileNotFoundError as e:
        raise ConfigError(f"{folder} has no go.mod") from e
    if not found:
        raise ConfigError(f"{folder}/go.mod names no module")
    return found[1].strip('"')


def siblings(folder: str) -> list[str]:
    """Folders beside a module whose module path has the same parent, sorted; the module itself is one."""
    folder = os.path.abspath(folder)
    prefix, out = read_module(folder).rpartition("/")[0], []
    for name in sorted(os.listdir(os.path.dirname(folder))):
        other = os.path.join(os.path.dirname(folder), name)
        try:
            if read_module(other).rpartition("/")[0] == prefix:
                out.append(other)
        except (ConfigError, NotADirectoryError):
            continue
    return out
