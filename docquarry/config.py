"""Typed options with their defaults."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Embeddings:
    dimension: int = 64
    seed: int = 1


@dataclass(frozen=True)
class Chunking:
    target_size: int = 2500
    overlap: int = 200


@dataclass(frozen=True)
class Search:
    keyword_weight: float = 0.4
    semantic_weight: float = 0.6
    top_k: int = 5


@dataclass(frozen=True)
class Config:
    embeddings: Embeddings = field(default_factory=Embeddings)
    chunking: Chunking = field(default_factory=Chunking)
    search: Search = field(default_factory=Search)
    index_path: str = "index"
    doc_dirs: tuple[str, ...] = ("docs",)

    @classmethod
    def load(cls, values: dict | None = None) -> Config:
        """From nested plain values, such as a parsed YAML file; an empty file is the
        defaults. Unknown keys are errors."""
        return _build(cls, values or {})

    @classmethod
    def read(cls, path: str) -> Config:
        """From a file of nested `name: value` lines and `- item` lists; a file that is not
        there is the defaults."""
        if not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as file:
            return cls.load(parse_text(file.read()))


def parse_text(text: str) -> dict:
    """Nested values of an indented text: the part of YAML that options need, which is maps,
    lists of plain values, numbers, booleans, quoted and plain strings, and comments."""
    lines = [(len(raw) - len(raw.lstrip()), body) for raw in text.split("\n") if (body := re.sub(r"(^|\s)#.*$", "", raw).strip())]

    def block(at: int, indent: int):
        if at < len(lines) and lines[at][1].startswith("- "):
            items = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                items.append(_plain(lines[at][1][2:].strip()))
                at += 1
            return items, at
        values: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            name, colon, rest = lines[at][1].partition(":")
            if not colon:
                raise ValueError(f"no 'name: value' line: {lines[at][1]}")
            at += 1
            if rest.strip():
                values[name.strip()] = _plain(rest.strip())
            elif at < len(lines) and (lines[at][0] > indent or lines[at][1].startswith("- ")):
                values[name.strip()], at = block(at, lines[at][0])
            else:
                values[name.strip()] = None
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"unexpected indentation: {lines[at][1]}")
        return values, at

    return block(0, lines[0][0])[0] if lines else {}


def _plain(value: str):
    if value[:1] == value[-1:] and value[:1] in "'\"" and len(value) > 1:
        return value[1:-1]
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return None if value in ("null", "~") else value


def _build(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown options: {sorted(extra)}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        made[name] = _build(type(default), value or {}) if is_dataclass(default) else tuple(value) if isinstance(default, tuple) else value
    return kind(**made)
