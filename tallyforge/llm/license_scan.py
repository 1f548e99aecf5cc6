"""Licence scan: ordered signature rules behind a keyword prefilter.

One pass over the texts in Arrow batches, no shuffle. A text goes on if one of
its words is a gate word (each rule's pattern needs one of its own); then an
Aho-Corasick automaton finds which keywords it has, and only their rules run. Detections of lower
priority inside a detection of higher priority (or equal priority, earlier
rule, longer span) are suppressed. The base phrases of the contract are counted
exactly beside the rules and their labels always stay.

Defined cases: null text is an empty text; a text without detections has empty
labels, null places and score 0; repeated rows give repeated results; columns
other than the id and the text are not touched.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm import _words
from tallyforge.llm.license_rules import HINT, NAMED, NOTICE, UNDER, VERSIONED, rules

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed by the contract: phrase and label.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, priority: int, first_word: long, n_words: long>>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("detections", pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64())]))),
])


_OPTIONAL = re.compile(r"\(\?:[^()]*\)[?*]")
_GROUP = re.compile(r"\(\?:([^()]*)\)")
_EITHER = re.compile(r"\[cs\]|.\?")
#: What may stand for any characters; a word beside it is not known.
_WILD = re.compile(r"(?:\[[^\]]*\]|\\[dwS]|\.)(?:\{[^}]*\}|[+*])?")


def _variants(pattern: str):
    """The pattern's texts without what is optional in groups; a line feed stands for any characters."""
    if m := _GROUP.search(pattern):
        for one in m[1].split("|"):
            yield from _variants(pattern[: m.start()] + one + pattern[m.end() :])
    elif m := _EITHER.search(pattern):
        for one in "cs" if m[0] == "[cs]" else ("", m[0][0]):
            yield from _variants(pattern[: m.start()] + one + pattern[m.end() :])
    else:
        yield _WILD.sub("\n", pattern)


@functools.cache
def gate_words(keyword: str, pattern: str) -> tuple[str, ...]:
    """Words of which each text that the pattern matches has one: of each variant a licence word, else the keyword's first, else the longest."""
    bare = re.sub(r"\\[()]", "\n", pattern.replace(UNDER, ""))
    while (less := _OPTIONAL.sub("", bare)) != bare:
        bare = less
    found = set()
    for text in _variants(bare):
        words = [w for w in text.split(" ") if w and "\n" not in w]
        found.add(max(words, key=lambda w: (w.startswith("licen"), w == keyword.split()[0], len(w))))
    return tuple(sorted(found))


@functools.cache
def _compiled():
    """Automaton over keywords, rules by keyword, base patterns, gate. Built once in each worker."""
    import ahocorasick

    by_keyword: dict[str, list[tuple[int, str, int, re.Pattern]]] = {}
    gate = {phrase.split()[0] for phrase, _ in BASE}
    for order, (label, priority, keyword, pattern) in enumerate(rules()):
        by_keyword.setdefault(keyword, []).append((order, label, priority, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")))
        gate.update(gate_words(keyword, pattern))
    automaton = ahocorasick.Automaton()
    for keyword in by_keyword:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    base = [(phrase.split()[0], re.compile(rf"(?<!{_WORD}){_GAP.join(phrase.split())}(?!{_WORD})"), label) for phrase, label in BASE]
    hashes = np.sort(_words.words(*_words.buffers(pa.array(sorted(gate))), _words.ALNUM).hashes())
    first = np.zeros(1 << 16, bool)
    first[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    return automaton, by_keyword, base, hashes, first


def detect(text: str) -> list[tuple[str, int, int, int]]:
    """(label, priority, first word, words) of what stands in words joined by blanks."""
    automaton, by_keyword, *_ = _compiled()
    found = []
    for keyword in {k for _, k in automaton.iter(text)}:
        for order, label, priority, pattern in by_keyword[keyword]:
            found += [(m.start(), m.end(), priority, order, label) for m in pattern.finditer(text)]
    found.sort(key=lambda x: (-x[2], x[0] - x[1], x[3], x[0]))
    kept = []
    # Whether one before it starts at or before it and ends at or after it: a running maximum over places, in log(n) steps.
    places = {at: i for i, at in enumerate(sorted({x[0] for x in found}), 1)}
    furthest = [0] * (len(places) + 1)
    for one in found:
        at, to = places[one[0]], 0
        while at:
            to, at = max(to, furthest[at]), at & (at - 1)
        if to >= one[1]:
            continue
        kept.append(one)
        at = places[one[0]]
        while at < len(furthest):
            furthest[at], at = max(furthest[at], one[1]), at + (at & -at)
    kept.sort()
    out, word, seen = [], 0, 0
    for start, end, priority, _, label in kept:
        word, seen = word + text.count(" ", seen, start), start
        out.append((label, priority, word, text.count(" ", start, end) + 1))
    return out


def score(detections: list[tuple[str, int, int, int]], n_base: int) -> float:
    """Trust in the best detection, 0 to 1: a notice .95, a version .85, a name .7, a hint .4; a base phrase .7 at least."""
    by_priority = {NOTICE: 0.95, VERSIONED: 0.85, NAMED: 0.7, HINT: 0.4}
    return max([by_priority[p] for _, p, _, _ in detections] + [0.7 if n_base else 0.0])


def _scan(batches):
    _, _, base, gate, first = _compiled()
    for batch in batches:
        ids, rows = _words.column(batch, "doc_id"), []
        for part in _words.slices(_words.column(batch, "text"), _words.ALNUM, lower=True):
            n = np.diff(part.of)
            hashed = part.hashes()
            maybe = np.flatnonzero(first[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
            hit = np.zeros(part.n_docs, bool)
            hit[np.searchsorted(part.of, maybe[np.isin(hashed[maybe], gate)], "right") - 1] = True
            whole = part.data.tobytes().decode("latin-1") if hit.any() else ""  # a character for each byte
            for d in range(part.n_docs):
                if not hit[d]:
                    rows.append((int(n[d]), 0, None, None, "", "", 0.0, []))
                    continue
                at, to = int(part.bounds[d]), int(part.bounds[d + 1])
                text = whole[at:to]
                own = slice(part.of[d], part.of[d + 1])
                places, labels = [], set()
                for start, pattern, label in base:
                    if start in text:
                        for m in pattern.finditer(text):
                            places.append(int(np.searchsorted(part.starts[own], at + m.start())))
                            labels.add(label)
                joined = " ".join(re.findall(f"{_WORD}+", text))
                found = detect(joined)
                rows.append((
                    int(n[d]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
                    ",".join(sorted(labels | {x[0] for x in found})), score(found, len(places)),
                    [{"label": a, "priority": b, "first_word": c, "n_words": e} for a, b, c, e in found],
                ))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, labels, score and the detections that stand."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
