"""Similarity by matching blocks: the longest common block, then those on both sides of it, and so on."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratios(left: list[str | None], right: list[str | None]) -> list[float | None]:
    """2 * matched characters / characters of both texts, for each pair; each pair of a batch is matched once."""
    matcher, known, of = SequenceMatcher(None), {}, None
    pairs = list(zip(left, right, strict=True))
    for a, b in sorted({p for p in pairs if None not in p}, key=lambda p: (p[1], p[0])):
        if b != of:  # what it learns of the second text serves all first ones
            matcher.set_seq2(b)
            of = b
        matcher.set_seq1(a)
        known[a, b] = matcher.ratio()
    return [known.get(p) for p in pairs]


def _block_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(_ratios(left.to_pylist(), right.to_pylist()), pa.float64())


def block_ratio(a: Column, b: Column) -> Column:
    """The share of both texts that lies in matching blocks, 0 to 1; 1 for two empty texts, null where one is null.

    From 200 characters on, characters that make up over 1 % of the second text
    begin no block, as in the usual heuristic of difference tools. The measure
    is not symmetric.
    """
    return F.arrow_udf(_block_ratio, "double")(a, b)
