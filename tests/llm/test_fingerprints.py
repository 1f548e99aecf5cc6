"""Document fingerprints against a plain version of each step."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import LONG, PROSE, TEXTS, documents, empty_documents, odd_documents
from pyspark.sql import functions as F

from tallyforge.llm import improbable_digest as digest
from tallyforge.llm.registry import op12_document_fingerprints

SF_DIR = "/root/testdata/sf0.001"


def bin_of(window):
    """The entropy of a window, with the rounding of the table of sums."""
    sums = sum(round(c * math.log2(c) / (digest.WINDOW * math.log2(digest.WINDOW)) * ((digest.BINS - 1) << 10)) for c in Counter(window).values())
    return min(max((((digest.BINS - 1) << 10) - sums) >> 10, 0), digest.BINS - 1)


def brute_ranks(texts):
    seen = Counter(bin_of(t[i : i + digest.WINDOW]) for t in texts for i in range(len(t) - digest.WINDOW + 1))
    weak = digest.WEAK / math.log2(digest.WINDOW) * (digest.BINS - 1)
    ranks = np.empty(digest.BINS, np.uint16)
    ranks[sorted(range(digest.BINS), key=lambda b: (b < weak, seen[b], b))] = np.arange(digest.BINS)
    return ranks


def brute_features(text, ranks):
    n = len(text) - digest.WINDOW + 1
    if n < 1:
        return [text] if text else []
    order = [ranks[bin_of(text[i : i + digest.WINDOW])] for i in range(n)]
    popular = Counter()
    for first in range(-digest.NEAR + 1, n):
        popular[min(range(max(0, first), min(n, first + digest.NEAR)), key=lambda i: (order[i], i))] += 1
    return [text[i : i + digest.WINDOW] for i in sorted(popular) if popular[i] >= digest.POPULAR]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [bytes(rng.choices(b"abcdefghijklmnopq", k=rng.randint(1, 9))) for _ in range(300)]
    return [b"", b"x", b"short one", b"-" * 300, b"ab" * 90, PROSE.encode(), "naïve café 東京".encode() * 5] + [b" ".join(rng.choices(words, k=rng.randint(1, 700))) for _ in range(40)]


def test_features_equal_brute_force(texts):
    ranks = brute_ranks(texts)
    found = digest.digests(pa.array([t.decode() for t in texts]), ranks)
    for d, text in enumerate(texts):
        own = found.take(d, d + 1)
        features = list(dict.fromkeys(brute_features(text, ranks)))
        assert own.features.tolist() == [min(digest.PER_FILTER, len(features) - i) for i in range(0, len(features), digest.PER_FILTER)]
        assert (len(text) > 0) == (len(features) > 0)
        # a text made of nothing but its features' hashes sets the same bits
        alone = np.zeros_like(own.filters)
        for i, feature in enumerate(features):
            part = next(digest._slices(pa.array([feature], pa.binary())))
            h = int(digest._hashes(part, part.starts, np.array([len(feature)]))[0])
            for j in range(digest.HASHES):
                bit = (h >> (11 * j)) % digest.FILTER_BITS
                alone[i // digest.PER_FILTER].view(np.uint8)[bit // 8] |= 1 << (bit % 8)
        assert np.array_equal(alone, own.filters)


def test_blocks_do_not_show(texts, monkeypatch):
    ranks = brute_ranks(texts)
    whole = digest.digests(pa.array([t.decode() for t in texts] + [LONG]), ranks).texts()
    monkeypatch.setattr(digest, "_BLOCK", 97)
    monkeypatch.setattr(digest, "_SLICE", 500)
    assert digest.digests(pa.array([t.decode() for t in texts] + [LONG]), ranks).texts() == whole


def test_rarity_counts_all_texts(spark, texts):
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert digest.rarity(docs).tolist() == brute_ranks(texts).tolist()


def plain_likeness(a, b):
    """Likeness of two fingerprints, filter by filter."""
    size = 1 + digest.FILTER_BITS // 8
    if a == b:
        return 1.0
    fa, fb = ([(x[i], int.from_bytes(x[i + 1 : i + size], "little")) for i in range(0, len(x), size)] for x in map(base64.b64decode, (a, b)))

    def one_way(left, right):
        total = 0.0
        for n, x in left:
            best = 0.0
            for _, y in right:
                ones, others = x.bit_count(), y.bit_count()
                chance = ones * others / digest.FILTER_BITS
                noise = 4 * math.sqrt(chance * (1 - max(ones, others) / digest.FILTER_BITS))
                common = (x & y).bit_count()
                if common > chance + noise:
                    best = max(best, (common - chance) / (min(ones, others) - chance))
            total += best * n
        return total / max(1, sum(n for n, _ in left))

    n_a, n_b = sum(n for n, _ in fa), sum(n for n, _ in fb)
    ab, ba = one_way(fa, fb), one_way(fb, fa)
    return ab if n_a < n_b else ba if n_b < n_a else (ab + ba) / 2


def expected(rows):
    """What the operator has to say of the neighbours of (doc_id, text), in order."""
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 4
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    return out


def test_query_meets_neighbours_and_edits(spark):
    rows = sorted(op12_document_fingerprints(spark, SF_DIR).collect(), key=lambda r: r["doc_id"])
    texts = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows] == expected(texts)
    prints = {}
    for r, (_, text) in zip(rows, texts, strict=True):
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    for r, following in zip(rows, rows[1:] + rows[:1], strict=True):
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]), abs=1e-9)
        assert r["near_next"] == pytest.approx(plain_likeness(r["fingerprint"], following["fingerprint"]), abs=1e-9)
    long = [r for r in rows if r["n_chars"] >= 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.7
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.97


def test_likeness_of_columns_and_of_parts(spark, texts):
    long = [t.decode() for t in texts if len(t) > 1500]
    ranks = brute_ranks(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long + [t[len(t) // 2 :] for t in long] + [long[0]] * 2 + [None])], "doc_id long, text string")
    found = digest.fingerprints(docs, ranks)
    pairs = found.alias("a").crossJoin(found.alias("b")).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), digest.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("near"))
    near, n = {(r["a"], r["b"]): r["near"] for r in pairs.collect()}, len(long)
    assert all(near[i, i] == 1 for i in range(2 * n)) and near[0, 2 * n] == near[2 * n, 2 * n + 1] == 1
    assert all(near[a, b] == near[b, a] for a, b in near)
    assert min(near[i, n + i] for i in range(n)) > 0.6 > 0.25 > max(near[i, n + j] for i in range(n) for j in range(n) if i != j)
    assert near[2 * n + 2, 2 * n + 2] == 1 and near[0, 2 * n + 2] == 0


def test_fingerprints_of_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    rows = digest.against_edits(docs, digest.rarity(docs)).collect()
    assert len(rows) == docs.count()
    assert sorted(r["n_chars"] for r in rows) == sorted(len(r["text"] or "") for r in docs.collect())
    named = [r for r in rows if r["doc_id"] is not None]
    assert {r["doc_id"] for r in named} == set(range(len(TEXTS)))
    plain = documents(spark).where("doc_id <> 5")
    ordered = sorted((r["doc_id"], r["text"] or "") for r in plain.collect())
    again = sorted(digest.against_edits(plain, digest.rarity(docs)).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in again] == expected(ordered)
    one = digest.against_edits(documents(spark).where("doc_id = 3"), digest.rarity(docs)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert digest.against_edits(empty_documents(spark), digest.rarity(empty_documents(spark))).count() == 0
