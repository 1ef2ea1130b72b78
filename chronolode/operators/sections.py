"""Sections of structured documents: XML to paragraphs, paragraphs to citation paths, paths to chunks.

The rules run over the paragraphs of one section in order, inside the row that holds them.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in characters, depth, and the marks that open a level.
TARGET, LARGEST, DEPTH = 900, 1800, 8
OPENERS = frozenset({"1", "a", "A", "i", "I"})
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_FIRST = re.compile(r"\(([A-Za-z0-9]+)\)\s*")
_AFTER_DASH = re.compile(r"[^—]{0,120}—\s*\(([A-Za-z0-9]+)\)\s*")


def roman(token: str) -> int | None:
    values = [_ROMAN.get(c) for c in token.lower()]
    if not values or None in values:
        return None
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def follows(token: str, before: str) -> bool:
    """Whether a designator is the next one of the same kind: numbers, letters, Roman numerals, in the same case."""
    if before.isdigit() or token.isdigit():
        return before.isdigit() and token.isdigit() and int(token) - int(before) == 1
    if before.isupper() != token.isupper():
        return False
    if len(before) == 1 and len(token) == 1 and ord(token) - ord(before) == 1:
        return True
    a, b = roman(before), roman(token)
    return a is not None and b is not None and b - a == 1


def designators(text: str) -> list[str]:
    """The designators that open a paragraph, then those behind a dash near its beginning; at most DEPTH."""
    found, at = [], 0
    for rule in (_FIRST, _AFTER_DASH):
        while len(found) < DEPTH and (m := rule.match(text, at)):
            found.append(m[1])
            at = m.end()
    return found


def paths(paragraphs: list[str]) -> list[list[str]]:
    """Each paragraph's designator path.

    The top level runs (a), (b), (c) ...: its next letter always returns there. A token that begins a sequence opens a
    level; another one continues the deepest level, below the top, that it follows; else it opens a level too.
    """
    path: list[str] = []
    top, out = "a", []
    for text in paragraphs:
        for token in designators(text):
            if token == top:
                path, top = [token], chr(ord(token) + 1)
                continue
            level = None if token in OPENERS else next((i for i in reversed(range(1, len(path))) if follows(token, path[i])), None)
            if level is not None:
                path = [*path[:level], token]
            elif len(path) < DEPTH:
                path = [*path, token]
        out.append(path)
    return out


def pack(paragraphs: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """(ordinal, path, text): consecutive (path, text) joined until TARGET is reached or LARGEST would be passed."""
    groups: list[list[tuple[str, str]]] = []
    size = 0
    for path, text in paragraphs:
        if not groups or size >= TARGET or size + len(text) > LARGEST:
            groups.append([])
            size = 0
        groups[-1].append((path, text))
        size += len(text) + 1
    return [(i, g[0][0], " ".join(t for _, t in g)) for i, g in enumerate(groups)]


def _flat(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def parse(xml: bytes | str, prefix: str) -> list[dict]:
    """Sections with heading and chunks of one snapshot; sections without a number and empty paragraphs are left out."""
    out = []
    for div in ET.fromstring(xml).iter("DIV8"):  # noqa: S314 - snapshots come from the store's own source
        number = (div.get("N") or "").strip()
        if div.get("TYPE") != "SECTION" or not number:
            continue
        texts = [t for t in map(_flat, div.iter("P")) if t]
        cited = [f"{prefix} {number}" + "".join(f"({d})" for d in p) for p in paths(texts)]
        out.append({"section": number, "heading": _flat(div.find("HEAD")), "chunks": pack(list(zip(cited, texts, strict=True)))})
    return out


def parse_snapshots(snapshots: DataFrame, prefix: str) -> DataFrame:
    """(day, section, heading, ordinal, citation_path, text) of snapshots(day, xml); one that is no XML fails its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s["section"], s["heading"], *c) for d, x in zip(b["day"], b["xml"], strict=True) if x is not None for s in parse(x, prefix) for c in s["chunks"]]
            yield pd.DataFrame(rows, columns=["day", "section", "heading", "ordinal", "citation_path", "text"])

    return snapshots.select("day", "xml").mapInPandas(run, "day date, section string, heading string, ordinal int, citation_path string, text string")


def pack_rows(paragraphs: DataFrame) -> DataFrame:
    """(key, ordinal, path, text) of rows (key, paragraphs array<struct<path, text>>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *c) for k, p in zip(b["key"], b["paragraphs"], strict=True) for c in pack([(x["path"], x["text"]) for x in p])]
            yield pd.DataFrame(rows, columns=["key", "ordinal", "path", "text"])

    return paragraphs.select(F.col("key").cast("long"), "paragraphs").mapInPandas(run, "key long, ordinal int, path string, text string")
