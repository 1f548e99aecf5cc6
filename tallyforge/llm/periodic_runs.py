"""Periodic runs of words, found by recursive frequency splitting and a sampled lag-scan.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and a length of at least max(6, 4 * q) that no neighbouring word
extends keeping period q. Each of its words stands in it four times or more.

1. Splitting: words that occur fewer than four times in their segment (at first
   the whole document) can be in no run, so they split it; pieces of under six
   words go. Counting and splitting are repeated on what changed until no
   segment has such a word.
2. Lag-scan of the segments that survive: a run with period q matches itself q
   words later over 3 * q words at least, so it holds a place k * q of its
   segment from which 2 * q words match. Only those places are compared, by
   rolling hashes of whole windows, m log m comparisons for m words in place of
   m * m; equal hashes are then compared word by word around the place.
3. A stretch that lies inside a run whose period divides q has that smaller
   period, so it is not a run of its own.

All documents of a slice are split and scanned together as numpy arrays; a
document never leaves its task and nothing is shuffled.

Defined cases: a null text has no words, an empty collapsed text and no runs;
words are compared by 64 bits, exact up to 8 bytes a word; repeated rows get
repeated results; a null doc_id is passed on, and ``with_periodic_tails`` leaves
its text as it is; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _words

#: The shortest run, and how often a run holds its period at least.
MIN_LENGTH, MIN_REPEATS = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

#: Comparisons of the lag-scan that are in memory at once.
_AT_ONCE = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def split_by_frequency(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments in which each word occurs MIN_REPEATS times or more.

    words: numbers of the words of all documents; of: where each document's begin.
    """
    starts, ends = of[:-1], of[1:]
    stable_starts, stable_ends = [], []
    many = int(words.max(initial=0)) + 1
    while True:
        long = ends - starts >= MIN_LENGTH
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        n = ends - starts
        segment = np.repeat(np.arange(len(starts)), n)
        at = np.arange(n.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        key = segment * many + words[at]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        same = np.diff(np.concatenate([first, [len(key)]]))
        count = np.empty(len(key), np.int64)
        count[order] = np.repeat(same, same)
        rare = count < MIN_REPEATS
        changed = np.zeros(len(starts), bool)
        changed[segment[rare]] = True
        stable_starts.append(starts[~changed])
        stable_ends.append(ends[~changed])
        if not changed.any():
            break
        # what is left of the changed segments: stretches without a rare word
        good = ~rare & changed[segment]
        edge = np.concatenate([[True], segment[1:] != segment[:-1]])
        begins = good & (edge | ~np.concatenate([[False], good[:-1]]))
        stops = good & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([good[1:], [False]]))
        starts, ends = at[begins], at[stops] + 1
    if not stable_starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = np.concatenate(stable_starts), np.concatenate(stable_ends)
    order = np.argsort(starts)
    return starts[order], ends[order]


def _powers(n: int) -> np.ndarray:
    """The powers 0 to n of an odd number, modulo 2 ** 64."""
    out = np.full(n + 1, _ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _candidates(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segment, lag q and place i of every k * q from which 2 * q words seem to match those q later.

    A window's rolling hash is a difference of prefix sums, each word weighted
    by a power of its position.
    """
    power = _powers(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])
    n_lags = (ends - starts) // MIN_REPEATS
    segment = np.repeat(np.arange(len(starts)), n_lags)
    lag = np.arange(len(segment)) - np.repeat(np.cumsum(n_lags) - n_lags, n_lags) + 1
    places = (ends - starts)[segment] // lag - 2
    total = np.cumsum(places)
    first = 0
    while first < len(segment):
        last = max(first + 1, int(np.searchsorted(total, total[first] - places[first] + _AT_ONCE, "right")))
        many = places[first:last]
        s, q = np.repeat(segment[first:last], many), np.repeat(lag[first:last], many)
        k = np.arange(len(s)) - np.repeat(np.cumsum(many) - many, many)
        i = starts[s] + k * q
        middle, end = sums[i + q], sums[i + 2 * q]
        found = np.flatnonzero((end - sums[i]) * power[q] == sums[i + 3 * q] - middle)
        if len(found):
            yield s[found], q[found], i[found]
        first = last


def _divisors(q: int) -> list[int]:
    small = [d for d in range(1, int(q**0.5) + 1) if q % d == 0]
    return sorted({*small, *(q // d for d in small)} - {q})


def _scan_segment(words: np.ndarray, start: int, end: int, lags: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one segment from its candidates, which are ordered by lag and place."""
    found: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of runs, by period
    cuts = np.flatnonzero(np.diff(lags)) + 1
    for q, own in zip(lags[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
        smaller = [found[d] for d in _divisors(q) if d in found]

        def inside(a: np.ndarray, b: np.ndarray, smaller=smaller) -> np.ndarray:
            """Whether a run whose period divides q holds each stretch from a to b."""
            out = np.zeros(len(a), bool)
            for s, e in smaller:
                j = np.searchsorted(s, a, "right") - 1
                out |= (j >= 0) & (np.array(e)[j] >= b)
            return out

        own = own[~inside(own, own + 3 * q)]
        if not len(own):
            continue
        need = max(MIN_LENGTH, MIN_REPEATS * q) - q
        groups = np.flatnonzero(np.diff(own) > 2 * q) + 1
        stretches: dict[int, int] = {}
        for group in np.split(own, groups):
            low, high = max(start, int(group[0]) - q), min(end, int(group[-1]) + 4 * q)
            same = words[low : high - q] == words[low + q : high]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
            for a, b in zip((low + edges[::2]).tolist(), (low + edges[1::2]).tolist(), strict=True):
                if b - a >= need:
                    stretches[a] = max(b + q, stretches.get(a, 0))
        if stretches:
            a, b = np.array(sorted(stretches)), np.array([stretches[x] for x in sorted(stretches)])
            new = ~inside(a, b)
            if new.any():
                found[q] = (a[new].tolist(), b[new].tolist())
    return sorted((a, b - a, q) for q, (starts, ends) in found.items() for a, b in zip(starts, ends, strict=True))


def runs_of(part: _words.Words) -> list[list[tuple[int, int, int]]]:
    """Each document's runs as (start, length, period), by start and then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(part.n_docs)]
    hashes = part.hashes()
    words = np.unique(hashes, return_inverse=True)[1]
    starts, ends = split_by_frequency(words, part.of)
    if not len(starts):
        return out
    found = list(_candidates(hashes, starts, ends))
    if not found:
        return out
    segment, lag, place = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.searchsorted(part.of, starts, "right") - 1
    cuts = np.flatnonzero(np.diff(segment)) + 1
    for s, q, i in zip(segment[np.concatenate([[0], cuts])].tolist(), np.split(lag, cuts), np.split(place, cuts), strict=True):
        own = int(part.of[doc[s]])
        out[doc[s]] += [(a - own, n, p) for a, n, p in _scan_segment(words, int(starts[s]), int(ends[s]), q, i)]
    return out


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    words = text.split()  # bytes are split at ASCII white space: 0x20 and 0x09 to 0x0D
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return b" ".join([w for w, d in zip(words, np.cumsum(dropped[:-1]).tolist(), strict=True) if not d])


def _search(batches):
    for batch in batches:
        counts, runs, texts = [], [], []
        for part in _words.slices(_words.column(batch, "text"), _words.SPACED):
            counts.append(np.diff(part.of))
            own, whole = runs_of(part), part.data.tobytes()
            runs += own
            texts += [_collapsed(whole[a:b], r) for a, b, r in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist(), own, strict=True)]
        flat = np.array([x for own in runs for x in own], np.int64).reshape(-1, 3)
        fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(3)], names=["start", "length", "period"])
        offsets = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                _words.column(batch, "doc_id"), pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its runs in order, and its words without what runs repeat, joined by spaces."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_search, SCHEMA)


def _spaced_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; one document in ten, by its id, ends in repeats of its own words from a word on.

    With h the CRC-32 of the decimal id, g = h div 10 and n words: where
    h % 10 = 0, words from a = g % n on repeat a period of
    1 + (n - a) div (3 + g % 8) words.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.size("w").cast("long")
    marked = (
        docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, _spaced_words(F.col("text"))))
        .withColumn("n", F.when(n > 0, n)).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    )
    tail = F.expr("transform(sequence(a, n - 1), i -> element_at(w, cast(a + (i - a) % p + 1 as int)))")
    edited = F.array_join(F.concat(F.expr("slice(w, 1, cast(a as int))"), tail), " ")
    return marked.select("doc_id", F.when(F.col("n").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row per row of ``periodic_runs``: its longest run, and digests of all runs and of the collapsed text."""
    # the greatest of these is the longest, then the first, then that of the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.finer")).alias("period"),
        F.expr("(1000 * best.length) div -best.finer").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
