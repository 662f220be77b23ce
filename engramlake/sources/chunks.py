"""Overlapping slices of long texts, and secret redaction: operators with state along the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, THRESHOLD = 1400, 200, 1800


def boundary(text: str, start: int, end: int) -> int:
    """The cut: after the last sentence end in the second half of the window, else after the last blank, else its end."""
    half = start + (end - start) // 2
    window = text[half:end]
    for pattern in (r"[.!?\n]", r"\s"):
        last = None
        for last in re.finditer(pattern, window):
            pass
        if last:
            return half + last.end()
    return end


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, threshold: int = THRESHOLD) -> list[str]:
    """Slices of a text longer than the threshold; shorter texts have none."""
    if len(text) <= threshold:
        return []
    overlap = min(overlap, size // 2)
    out, start = [], 0
    while start < len(text):
        hard = min(start + size, len(text))
        end = hard if hard == len(text) else boundary(text, start, hard)
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = end - overlap if end > start + overlap else start + size - overlap
    return out


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, content) for texts that need slicing."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, i, c) for k, t in zip(p["k"], p["t"]) for i, c in enumerate(split_text(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "content"])

    long = df.where(F.length(text) > THRESHOLD).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return long.mapInPandas(run, f"{key} {kind}, chunk int, content string")
