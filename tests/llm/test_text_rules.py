"""Licence scan, quality rules and the quality classifier."""

import re

import numpy as np
import pyarrow as pa
import pytest
from edge import TEXTS, documents, empty_documents, odd_documents
from pyspark.sql import functions as F

from tallyforge.llm import _shared, _words, importance_sampling, license_scan, quality_rules
from tallyforge.llm.license_rules import UNDER, rules

SF_DIR = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in license_scan.license_scan(documents(spark)).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
        assert 0 <= r["score"] <= 1


def test_license_scan_on_driver_documents(spark):
    docs = _shared.table(spark, "/root/testdata/sf0.001", "documents")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in license_scan.license_scan(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(texts[r["doc_id"]])


def test_suppression_is_interval_containment():
    found = license_scan.detect("licensed under the apache license version 2 0 and more")
    spans = [(p, a, a + n) for _, p, a, n in found]
    for i, (p, a, b) in enumerate(spans):
        for j, (q, c, d) in enumerate(spans):
            assert i == j or not (c <= a and b <= d and q > p)


def test_gate_loses_no_rule():
    assert len(list(rules())) >= 200
    assert all(license_scan.gate_words(keyword, pattern) for _, _, keyword, pattern in rules())


def made_from(pattern):
    """Texts that the pattern may match: each alternative, each optional part with and without."""

    def texts(items):
        outs = [""]
        for op, value in items:
            match str(op):
                case "LITERAL":
                    each = [chr(value)]
                case "IN":
                    each = [chr(v) if str(o) == "LITERAL" else chr(v[0]) if str(o) == "RANGE" else "1" for o, v in value]
                case "ANY":
                    each = ["q"]
                case "MAX_REPEAT":
                    each = ([""] if value[0] == 0 else []) + [t * max(1, value[0]) for t in texts(value[2])]
                case "SUBPATTERN":
                    each = texts(value[3])
                case "BRANCH":
                    each = [t for branch in value[1] for t in texts(branch)]
            outs = [a + b for a in outs for b in each]
        return outs

    return texts(re._parser.parse(pattern.replace(UNDER, "licensed under ")))


def test_gate_equals_running_all_rules(spark):
    compiled, texts = [(label, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")) for label, _, _, pattern in rules()], []
    for (label, _, keyword, pattern), (_, own) in zip(rules(), compiled, strict=True):
        made = [t for t in (" ".join(t.split()) for t in made_from(pattern)) if own.search(t)]
        assert made, pattern
        for t in made:
            assert keyword in t, (pattern, t)
            assert set(license_scan.gate_words(keyword, pattern)) & set(t.split()), (pattern, t)
        texts.append((made[0], label))
    some = ["mulan psl 2", "responsible ai license", "icu license", "common development and distribution licence", "all rights are reserved", "see the licence file", "gplv3", "apache licensev2"]
    texts += [(t, None) for t in some]
    rows = {r["doc_id"]: r for r in license_scan.license_scan(documents(spark, [t for t, _ in texts])).collect()}
    for i, (text, label) in enumerate(texts):
        got = {x["label"] for x in rows[i]["detections"]}
        assert got and got == {x[0] for x in license_scan.detect(text)}
        assert got <= {x for x, own in compiled if own.search(text)}
    labels = [rows[len(texts) - len(some) + i]["labels"] for i in range(len(some))]
    assert labels == ["mulan-2.0", "openrail", "icu", "cddl", "reserved", "unspecified", "gpl-3.0", "apache-2.0"]


def test_suppression_equals_brute_force():
    """All rules without gate or keyword; each detection against all others."""
    rng = np.random.default_rng(4)
    compiled = [(order, label, priority, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")) for order, (label, priority, _, pattern) in enumerate(rules())]
    bits = ["licensed under the apache license version 2 0", "mit license", "all rights reserved", "copyright 2019 2020 by", "gnu general public license v3", "cc by sa 4 0", "some word", "bsd 3 clause license", "spdx license identifier mit 0"]
    for _ in range(15):
        text = " ".join(bits[i] for i in rng.integers(0, len(bits), 40))
        found = [(m.start(), m.end(), p, o, label) for o, label, p, own in compiled for m in own.finditer(text)]
        key = lambda x: (-x[2], x[0] - x[1], x[3], x[0])
        kept = sorted(x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and key(y) < key(x) for y in found))
        want = [(label, p, text[:a].count(" "), text[a:b].count(" ") + 1) for a, b, p, _, label in kept]
        assert license_scan.detect(text) == want


def test_a_long_list_of_licences_takes_linear_time():
    text = "mit license and apache license 2 0 or " * 20_000
    assert len(license_scan.detect(text)) == 40_000


def test_license_scan_of_odd_and_empty_tables(spark):
    assert license_scan.license_scan(odd_documents(spark)).count() == len(TEXTS) + 3
    assert license_scan.license_scan(empty_documents(spark)).count() == 0


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    repeated = set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            repeated.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts_equal_brute_force(spark):
    for r in quality_rules.quality_rules(documents(spark), None).collect():
        assert tuple(r[c] for c in COUNTS) == brute_quality(TEXTS[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"])


@pytest.fixture(scope="module")
def halves(spark):
    """Documents and labels; the models are fitted on half of the labels."""
    docs, labels = _shared.table(spark, SF_DIR, "documents"), _shared.table(spark, SF_DIR, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs, labels.where(~held), {r["doc_id"]: r for r in labels.where(held).collect()}


def area(good, bad):
    return (np.asarray(good)[:, None] > np.asarray(bad)[None, :]).mean()


def test_quality_model_on_held_out_labels(halves):
    docs, seen, held = halves
    rows = [r for r in quality_rules.quality_rules(docs, quality_rules.fit(docs, seen)).collect() if r["doc_id"] in held]
    assert all(tuple(r[c] for c in COUNTS) is not None and (not r["base_failed"] or not r["kept"]) for r in rows)
    good = [r["probability"] for r in rows if held[r["doc_id"]]["quality"] == 1]
    bad = [r["probability"] for r in rows if held[r["doc_id"]]["quality"] == 0]
    assert area(good, bad) > 0.9
    assert np.mean([r["kept"] for r in rows if held[r["doc_id"]]["quality"] == 1]) > 0.95


def test_quality_without_labels_is_the_base(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit(docs, labels) is None
    assert quality_rules.quality_rules(docs, None).count() == len(TEXTS) + 3
    kept = quality_rules.keep_good(docs, None)
    assert kept.columns == docs.columns
    assert all(not brute_quality(r["text"])[-1] for r in kept.collect())
    assert quality_rules.keep_good(empty_documents(spark), None).count() == 0


def test_importance_weights_on_held_out_labels(halves):
    docs, seen, held = halves
    out, _, _ = importance_sampling.importance_sample(docs, seen)
    rows = [r for r in out.collect() if r["doc_id"] in held]
    clean = [r["kept"] for r in rows if held[r["doc_id"]]["quality"] == 1 and not held[r["doc_id"]]["toxic"]]
    assert np.mean(clean) > 0.95
    good = [r["log_weight"] for r in rows if held[r["doc_id"]]["quality"] == 1]
    bad = [r["log_weight"] for r in rows if held[r["doc_id"]]["quality"] == 0]
    assert area(good, bad) > 0.7


def test_toxic_documents_leave_the_sample(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = _shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out, _, _ = importance_sampling.importance_sample(docs, labels.where(~held))
    own = out.join(labels.where(held).where("quality = 1"), "doc_id").groupBy("toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"))
    kept = {r["toxic"]: (r["kept"], r["n"]) for r in own.collect()}
    print("kept of held-out documents, by toxic:", kept)
    assert kept[0][0] > 0.98
    assert kept[1][0] < 0.15
    ids = importance_sampling.keep_sampled(docs, labels.where(~held)).select("doc_id")
    assert sorted(r[0] for r in ids.collect()) == sorted(r[0] for r in out.where("kept").select("doc_id").collect())


def test_top_k_is_exact(spark):
    values = [(int(x),) for x in np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 500)] + [(7,)] * 20 + [(-7,)] * 20
    df = spark.createDataFrame(values, "v long")
    ordered = sorted((v for (v,) in values), reverse=True)
    for k in (1, 17, 250, 300, len(values)):
        key, among = importance_sampling.kth_largest(df, "v", k)
        assert key == ordered[k - 1]
        assert among == k - sum(v > key for v in ordered)
    assert importance_sampling.kth_largest(df, "v", 0) is None
    assert importance_sampling.kth_largest(df, "v", len(values) + 1) is None


@pytest.mark.parametrize("k", [0, 1, 9, 400])
def test_sample_has_k_documents(spark, k):
    docs = documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (8, 1, 0), (18, 0, 0)], "doc_id long, quality int, toxic int")
    out, _, _ = importance_sampling.importance_sample(docs, labels, k=k)
    rows = out.collect()
    assert sum(r["kept"] for r in rows) == min(k, len(rows))
    worst = min([r["gumbel_key"] for r in rows if r["kept"]], default=None)
    assert worst is None or all(r["gumbel_key"] <= worst for r in rows if not r["kept"])


def test_importance_of_odd_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = importance_sampling.keep_sampled(odd_documents(spark), none)
    assert kept.count() == len(TEXTS) + 3
    assert kept.columns == odd_documents(spark).columns
    assert importance_sampling.keep_sampled(empty_documents(spark), none).count() == 0


def test_weights_equal_brute_force(spark):
    """Log ratios of hashed unigram and bigram shares, by counting each word of each document."""
    texts = ["good words here", "bad words there!", "good good, words", None, "", "other words there"]
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (1, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    model = importance_sampling.fit(documents(spark, texts), labels)
    raw, good = np.zeros(importance_sampling.BUCKETS), np.zeros(importance_sampling.BUCKETS)
    own = {}
    for i, text in enumerate(texts):
        part = next(_words.slices(pa.array([text], pa.string()), _words.PUNCT))
        own[i] = [b for buckets, _ in importance_sampling._buckets(part) for b in buckets.tolist()]
        for b in own[i]:
            raw[b] += 1
            good[b] += i in (0, 2)
    share = (raw + 1) / (raw + 1).sum()
    ratio = np.log((good + len(raw) * share) / (good.sum() + len(raw)) / share)
    assert np.allclose(model.ratio, ratio)
    assert np.allclose(model.weights(pa.array(texts, pa.string())), [sum(ratio[b] for b in own[i]) for i in range(len(texts))])
    assert len(own[0]) == 5 and len(own[3]) == 0


def test_a_labelled_id_on_many_rows_is_one_row_of_the_fit(spark):
    docs = documents(spark, TEXTS[3:14], first=3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 14)], "doc_id long, quality int")
    one, many = quality_rules.fit(docs, labels), quality_rules.fit(docs.unionByName(docs).unionByName(docs.where("doc_id < 9")), labels)
    assert np.array_equal(one.weights, many.weights) and (one.bias, one.slope, one.shift) == (many.bias, many.slope, many.shift)


def bucket_of(*tokens):
    """Bucket of a token or a pair of tokens, each hashed on its own."""
    hashed = np.concatenate([_words.words(np.frombuffer(t, np.uint8), np.array([0, len(t)]), _words.PUNCT).hashes() for t in tokens])
    return int((hashed if len(tokens) == 1 else _words.windows(hashed, np.array([0, len(tokens)]), len(tokens))[0])[0] >> np.uint64(52))


def test_quality_verdicts_equal_brute_force(spark):
    """Probability and verdict of any weights, n-gram by n-gram."""
    rng = np.random.default_rng(9)
    model = quality_rules.Model(rng.normal(size=quality_rules.FAMILIES * quality_rules.BUCKETS), -0.2, 1.7, 0.4)
    texts = [t for t in TEXTS if t is None or len(t) < 3000] + ["some words that stand here once and are more than ten of them, no doubt"]
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0d0-9A-Za-z\x80-\xff]+", data)
        families = [[bucket_of(t) for t in tokens], [bucket_of(a, b) for a, b in zip(tokens, tokens[1:], strict=False)], [(int.from_bytes(data[k : k + 4], "little") * 2654435761 % 2**32) >> 20 for k in range(len(data) - 3)]]
        raw = model.bias + sum(quality_rules.SCALE / len(own) * sum(model.weights[f * quality_rules.BUCKETS + b] for b in own) for f, own in enumerate(families) if own)
        p = 1 / (1 + np.exp(-(1.7 * raw + 0.4)))
        assert rows[i]["probability"] == pytest.approx(p, abs=1e-9)
        assert rows[i]["kept"] == (not rows[i]["base_failed"] and p >= quality_rules.THRESHOLD)
    assert {r["kept"] for r in rows.values()} == {True, False}


def test_toxic_marks_equal_brute_force():
    """Distinct words and pairs, and starts by how often words have them."""
    texts = ["badword badly badges, bad badword badminton", "one two", "", "réeuxpa réeuxon réeux " * 3]
    part = next(_words.slices(pa.array(texts), _words.PUNCT))
    levels = importance_sampling._marks(part)
    for d, text in enumerate(texts):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0d0-9A-Za-z\x80-\xff]+", text.encode())
        assert (levels[0][0] == d).sum() == len(set(tokens)) + len(set(zip(tokens, tokens[1:], strict=False)))
        starts = [t[:n] for n in importance_sampling.STARTS for t in tokens if len(t) > n]
        for level, times in enumerate(importance_sampling.TIMES, 1):
            upper = (*importance_sampling.TIMES, 10**9)[level]
            assert (levels[level][0] == d).sum() == sum(times <= starts.count(s) < upper for s in set(starts))


def test_the_fit_holds_its_matrix_once():
    """Beside the sparse matrix the fit needs memory for a block, however many rows there are."""
    import tracemalloc

    rng = np.random.default_rng(5)
    n, each = 2000, 800
    x = quality_rules._Sparse(np.arange(n + 1) * each, rng.integers(0, quality_rules.FAMILIES * quality_rules.BUCKETS, n * each).astype(np.int32), rng.random(n * each).astype(np.float32))
    good = (np.arange(n) % 2).astype(np.float64)
    used = np.arange(n) % 5 > 0
    tracemalloc.start()
    w, b = quality_rules._fit_logistic(x, good, used, 1e-5, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20  # the matrix has 1.6 million numbers, 12.8 MB of eight bytes for each thing kept of them
    rows = np.repeat(np.arange(n), each)
    assert np.allclose(x.scores(w, b), np.bincount(rows, weights=x.value.astype(float) * w[x.at], minlength=n) + b)
