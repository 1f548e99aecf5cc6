"""Periodic runs against a search of every stretch."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from edge import TEXTS, documents, empty_documents, odd_documents

from tallyforge.llm import _words, periodic_runs
from tallyforge.llm.registry import op11_periodic_runs

SF_DIR = "/root/testdata/sf0.001"


def words_of(text):
    return (text or "").encode().split()


def brute_runs(words):
    """Every stretch that is maximal for its smallest period, by trying each period at each place."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if j > i and len(stretch) >= max(6, 4 * q) and not any(all(stretch[x] == stretch[x + p] for x in range(len(stretch) - p)) for p in range(1, q)):
                found.add((i, len(stretch), q))
            i = max(j, i) + 1
    return sorted(found)


def brute_collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def edited(doc_id, text):
    words = words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def made(rng):
    """Words with runs inside runs, runs that meet and repeats that just miss."""
    out = []
    for _ in range(rng.randint(0, 8)):
        kind = rng.random()
        letters = [f"w{rng.randint(0, rng.choice([1, 2, 5, 40]))}" for _ in range(rng.randint(1, 9))]
        if kind < 0.6:
            own = letters * rng.randint(2, 7)
            out += own[: len(own) - rng.randint(0, len(letters) - 1)]
        else:
            out += letters
        if kind < 0.15:
            out = (out * rng.randint(2, 5))[:300]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [" ".join(made(rng)) for _ in range(120)]
    found = [own for part in _words.slices(pa.array(texts), _words.SPACED) for own in periodic_runs.runs_of(part)]
    assert found == [brute_runs(t.split()) for t in texts]
    assert sum(map(len, found)) > 60


def test_splitting_keeps_every_word_of_runs_and_is_stable():
    rng = random.Random(1)
    texts = [made(rng) for _ in range(60)]
    flat = [w for t in texts for w in t]
    numbers = np.unique(flat, return_inverse=True)[1]
    of = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends = periodic_runs.split_by_frequency(numbers, of)
    inside = np.zeros(len(flat), bool)
    for s, e in zip(starts, ends, strict=True):
        assert e - s >= 6 and min(np.unique(numbers[s:e], return_counts=True)[1]) >= 4
        assert np.searchsorted(of, s, "right") == np.searchsorted(of, e - 1, "right")
        inside[s:e] = True
    for d, t in enumerate(texts):
        for s, n, _ in brute_runs(t):
            assert inside[of[d] + s : of[d] + s + n].all()


def test_long_periodic_and_long_plain_texts():
    rng = random.Random(3)
    plain = [f"v{rng.randint(0, 50)}" for _ in range(40_000)]
    period = [f"v{rng.randint(0, 50)}" for _ in range(9_000)]
    texts = ["same " * 30_000, " ".join(period * 4 + period[:7]), " ".join(plain), " ".join(plain[:500] + ["x", "y", "z"] * 9_000 + plain)]
    found = [own for part in _words.slices(pa.array(texts), _words.SPACED) for own in periodic_runs.runs_of(part)]
    assert found[0] == [(0, 30_000, 1)]
    assert (0, 36_007, 9_000) in found[1] and len(found[1]) == 1
    assert (500, 27_000, 3) in found[3]


def test_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r.asDict() for r in op11_periodic_runs(spark, SF_DIR).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    for doc_id, text in texts.items():
        words = edited(doc_id, text)
        runs = brute_runs(words) if len(words) < 1500 else None
        own = rows[doc_id]
        assert own["n_words"] == len(words)
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert own["n_runs"] == len(runs)
        assert (own["start"], own["length"], own["period"], own["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert own["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert own["collapsed_sha256"] == hashlib.sha256(brute_collapsed(words, runs)).hexdigest()
    assert sum(r["n_runs"] > 0 for r in rows.values()) > 10


def test_runs_of_odd_and_empty_tables(spark):
    found = periodic_runs.periodic_runs(odd_documents(spark)).collect()
    by_id = {}
    for r in found:
        if r["doc_id"] is not None:
            by_id.setdefault(r["doc_id"], []).append(r)
    assert len(found) == odd_documents(spark).count()
    for i, text in enumerate(TEXTS):
        for r in by_id[i]:
            assert r["n_words"] == len(words_of(text))
            if r["n_words"] < 500:
                runs = brute_runs(words_of(text))
                assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"].encode() == brute_collapsed(words_of(text), runs)
    assert len(by_id[5]) == 2 and by_id[5][0] == by_id[5][1]
    empty = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_periodic_tails(empty_documents(spark))))
    assert empty.count() == 0
    nothing = periodic_runs.digest(periodic_runs.periodic_runs(documents(spark).where("doc_id = 0"))).first()
    assert nothing["n_runs"] == 0 and nothing["start"] is None and nothing["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    tails = {(r["doc_id"], r["text"]) for r in periodic_runs.with_periodic_tails(odd_documents(spark)).collect()}
    assert {(None, None), (None, TEXTS[4])} <= tails
    for i, text in enumerate(TEXTS):
        if zlib.crc32(str(i).encode()) % 10 == 0 and words_of(text):
            assert (i, b" ".join(edited(i, text)).decode()) in tails
        else:
            assert (i, text) in tails
