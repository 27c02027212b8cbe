"""Splitting oversized items at natural boundaries (problem 7).

Recursive bisection: a span over the limit is cut at the strongest boundary near its middle, and the halves are cut
again while they exceed the limit less the overlap. The overlap is then attached: each piece but the first starts
``overlap`` characters before its cut, so consecutive pieces share exactly that text and none exceeds the limit.

Text is first freed of white space at both ends. A null or blank text, a null limit and a limit of 0 or less mean
"never cut": one piece, or none for null and blank text. If the overlap is not less than the limit, it is lowered
to half the limit. A text without any boundary is cut between characters, never before a combining mark.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import maybe_broadcast

#: Boundaries, strongest first. A cut is at the end of a match.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*(?=#)|\n(?=#{1,6} )"),  # before a heading
    re.compile(r"\n[^\S\n]*\n\s*"),  # between paragraphs
    re.compile(r"[.!?…][\"'»”)]*\s+(?=[^\sa-zа-я])"),  # between sentences
    re.compile(r"\n"),  # between lines
    re.compile(r"[,;:]\s+"),  # between clauses
    re.compile(r"\s+"),  # between words
]
FENCE = re.compile(r"^```.*?(?:^```[^\n]*$|\Z)", re.M | re.S)
PIECES = "piece int, start int, stop int, text string"


def cuts(text: str, limit: int, overlap: int, target: int = 0) -> list[int]:
    """Cut positions, ascending, so that the spans between them are within ``limit - overlap`` (the first: limit)."""
    levels = [[m.end() for m in p.finditer(text)] for p in BOUNDARIES]
    fences = [m.span() for m in FENCE.finditer(text)]
    if fences:  # within fenced code only lines and words are boundaries
        levels[:3] = [[x for x in xs if not any(a < x < b for a, b in fences)] for xs in levels[:3]]
    size = limit - overlap
    want = min(max(target, 1), size) if target else size
    found: list[int] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= (limit if a == 0 else size):
            continue
        parts = max(2, -(-(b - a) // want))
        middle = a + (b - a) * (parts // 2) // parts
        reach = max(1, (b - a) // (2 * parts) if parts > 2 else (b - a) // 4)
        cut = 0
        for spots in levels:
            i = bisect.bisect_left(spots, middle)
            near = [x for x in spots[max(0, i - 1) : i + 1] if abs(x - middle) <= reach and a < x < b]
            if near:
                cut = min(near, key=lambda x: (abs(x - middle), x))
                break
        if not cut:
            cut = middle
            while cut > a + 1 and unicodedata.combining(text[cut]):
                cut -= 1
        found.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(found)


def pieces(text: str | None, limit: int | None, overlap: int | None, target: int | None = 0) -> list[tuple[int, int, int, str]]:
    """(piece, start, stop, text) with positions in the stripped text; see the module for the odd cases."""
    text = (text or "").strip()
    if not text:
        return []
    if not limit or limit <= 0 or len(text) <= limit:
        return [(1, 0, len(text), text)]
    over = max(0, overlap or 0)
    over = limit // 2 if over >= limit else over
    at = [0, *cuts(text, limit, over, target or 0), len(text)]
    starts = [0, *(max(0, x - over) for x in at[1:-1])]
    return [(i + 1, s, e, text[s:e]) for i, (s, e) in enumerate(zip(starts, at[1:], strict=True))]


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, *p) for i, t, lim, o, g in zip(b["item_id"], b["text"], b["above"], b["overlap"], b["target"], strict=True) for p in pieces(t, int(lim), int(o), int(g))]
        yield pd.DataFrame(rows, columns=["item_id", "piece", "start", "stop", "text"])


def split_items(items: DataFrame) -> DataFrame:
    """(item_id, text, above, overlap, target) -> (item_id, piece, start, stop, text).

    Only items that may exceed their limit go to Python; the others come out as one piece from the JVM. A repeated
    row gives its pieces once.
    """
    items = items.select("item_id", "text", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("target", F.lit(0)).alias("target"))
    kept = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    long = kept.where((F.col("above") > 0) & (F.length("text") > F.col("above")))
    short = kept.where((F.col("above") <= 0) | (F.length("text") <= F.col("above")))
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    whole = short.select("item_id", F.lit(1).alias("piece"), F.lit(0).alias("start"), F.length(bare).alias("stop"), bare.alias("text")).where(F.col("stop") > 0)
    return oversized_pieces(long).unionByName(whole).dropDuplicates(["item_id", "piece"])


def oversized_pieces(long: DataFrame) -> DataFrame:
    """The pieces of items longer than their limit before stripping."""
    kind = long.schema["item_id"].dataType.simpleString()
    return long.select("item_id", "text", "above", "overlap", "target").mapInPandas(_split, f"item_id {kind}, {PIECES}")


def chunk_items(chunks: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks with the limits of their source's kind."""
    kinds = sources.select("source_id", "kind").join(F.broadcast(limits.select("kind", "above", "target", "overlap")), "kind")
    return chunks.select("source_id", F.col("chunk_id").alias("item_id"), F.col("body").alias("text")).join(maybe_broadcast(kinds.drop("kind")), "source_id").drop("source_id")
