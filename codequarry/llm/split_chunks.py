"""Splitting oversized items at natural boundaries, by recursive bisection.

An item over its limit is cut at the strongest boundary near its midpoint; halves still exceeding the limit less the overlap
are cut again; then each piece but the first gets the overlap, the characters that come before it, so no piece exceeds the
limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAK = re.compile(r"\r\n|\n|\r")
#: Boundaries from the strongest down, each as the end of its match: blank line; line break before an unindented line that
#: closes nothing; line break; end of a sentence or statement; white space. Anything else is the last resort.
_BOUNDARIES = [
    re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*(?=\S|\Z)"),  # blank lines at the end are passed in one step
    re.compile(r"(?:\r\n|\n|\r)(?=[^\s})\]])"),
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[.!?;}][\"')\]]*\s+|[。！？；][」』”’）]*"),
    re.compile(r"\s+"),
]
_COMBINING = re.compile(r"[̀-ͯ‍︀-️\U0001f3fb-\U0001f3ff]")


def bisect_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text over the limit, overlaps included.

    An overlap not under the limit counts as limit - 1. Boundaries count as near the midpoint within a quarter of the length
    to either side; of equally strong ones the nearest wins, then the first.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    core = limit - overlap
    places = [[m.end() for m in b.finditer(text)] for b in _BOUNDARIES]
    cores, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= core:
            cores.append((lo, hi))
            continue
        mid, near = (lo + hi) / 2, (hi - lo) / 4
        for ends in places:
            a, b = bisect_left(ends, max(lo + 1, mid - near)), bisect_right(ends, min(hi - 1, mid + near))
            if a < b:
                k = bisect_left(ends, mid, a, b)
                cut = min((ends[i] for i in (k - 1, k) if a <= i < b), key=lambda p: (abs(p - mid), p))
                break
        else:
            cut = (lo + hi) // 2
            while cut - lo > 1 and (_COMBINING.match(text, cut) or text[cut - 1] == "‍" or text[cut - 1 : cut + 1] == "\r\n"):
                cut -= 1
        todo += [(cut, hi), (lo, cut)]
    return [(max(0, s - overlap), e) for s, e in cores]


SCHEMA = "id string, project_path string, piece int, n_pieces int, start_offset int, end_offset int, start_line int, end_line int, content string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int32() for c in SCHEMA.split(", ")]
    for b in batches:
        out, size = [], 0
        for r in b.to_pylist():
            text, first = r["content"], r["start_line"]
            breaks = [m.end() for m in _BREAK.finditer(text)]
            spans = bisect_spans(text, r["max_chunk_size"], r["overlap"])
            for k, (s, e) in enumerate(spans):
                lines = (None, None) if first is None else (first + bisect_right(breaks, s), first + bisect_right(breaks, e - 1))
                out.append((r["id"], r["project_path"], k, len(spans), s, e, *lines, text[s:e]))
            size += 2 * len(text)
            if size > 8_000_000:  # a batch of very long texts leaves in parts
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def split_oversized(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """The pieces of every chunk whose content has more code points than its project's ``max_chunk_size``.

    Columns as in ``SCHEMA``: pieces count from 0; ``start_offset`` and ``end_offset`` are code points into the content,
    overlap included; lines count \\r\\n, \\n and \\r as one break each from the chunk's start_line (null: null lines). Joining
    the pieces without their overlaps gives the content back. Chunks within the limit, with null content, or of a project
    without a positive limit aren't split and give no row; a null overlap is 0. Rows repeated exactly count once.
    """
    limits = config.groupBy("project_path").agg(F.min(F.struct("max_chunk_size", F.coalesce("overlap", F.lit(0)).alias("overlap"))).alias("c"))
    limits = limits.select("project_path", "c.*").where(F.col("max_chunk_size") > 0)
    over = chunks.select("id", "project_path", "start_line", "content").join(limits, "project_path")
    over = over.where(F.char_length("content") > F.col("max_chunk_size")).distinct()
    return over.mapInArrow(_pieces, SCHEMA)


def oversized_ids(pieces: DataFrame) -> DataFrame:
    """The ids that were cut."""
    return pieces.where((F.col("n_pieces") > 1) & F.col("id").isNotNull()).select("id").distinct()
