"""Near-duplicates, decontamination and the components under them."""

import random
import re

import pytest
from edge import TEXTS, documents, empty_documents, odd_documents
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, minhash_dedup
from tallyforge.llm.components import connected_components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, threshold=80):
    """doc_id: (n_shingles, component_id)."""
    sets = {i: shingles(t, size) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed, n_families=12, members=9):
    """Texts that drift away from a first one, so that chains link what isn't alike itself."""
    rng, texts = random.Random(seed), []
    for f in range(n_families):
        words = [f"f{f}v{rng.randrange(400)}" for _ in range(rng.randrange(40, 160))]
        for _ in range(members):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"f{f}c{rng.randrange(10_000)}"
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_near_duplicates_equal_brute_force(spark, seed, size):
    texts = families(seed)
    got = minhash_dedup.near_duplicates(documents(spark, texts), size=size).collect()
    want = brute(enumerate(texts), size)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_edge_cases(spark):
    got = minhash_dedup.near_duplicates(documents(spark), size=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(enumerate(TEXTS), 4)


def test_near_duplicates_of_odd_and_empty_tables(spark):
    assert minhash_dedup.near_duplicates(odd_documents(spark)).count() == len(TEXTS) + 3
    assert minhash_dedup.near_duplicates(empty_documents(spark)).count() == 0
    kept = minhash_dedup.keep_one(odd_documents(spark))
    assert kept.columns == documents(spark).columns
    assert 6 not in [r["doc_id"] for r in kept.collect()]


def test_sets_go_by_their_text_whatever_the_id(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, one), (None, f"{one} end"), (7, two), (7, three), (8, f"{two} end"), (9, f"{three} end")]
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    links = {r["doc_id"]: r["component_id"] for r in out.where("doc_id > 7").collect()}
    assert links == {8: 7, 9: 7}
    docs = spark.createDataFrame(rows[:2], "doc_id long, text string")
    signed = [r["fp"] for r in minhash_dedup.signatures(docs, 5).collect()]
    assert signed == [r["id"] for r in minhash_dedup.shingle_sets(docs, 5).collect()]


def test_links_stand_whatever_the_ids(spark):
    """One id on two texts, and null ids: each near copy is linked with its own text."""
    rng, rows = random.Random(11), []
    for i in range(40):
        own = [f"p{i}w{rng.randrange(500)}" for _ in range(60)]
        rows += [(i // 2, " ".join(own)), (1000 + i, " ".join([*own, "tail"]))]
        if i % 10 == 0:
            rows.append((None, " ".join([*own, "other", "tail"])))
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out if (r["doc_id"] or 0) >= 1000} == {1000 + i: i // 2 for i in range(40)}
    assert sorted(r["component_id"] for r in out if r["doc_id"] is None) == [0, 5, 10, 15]


def test_one_of_a_group_stays_where_an_id_stands_on_two_texts(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(3, one), (7, f"{one} tail"), (7, two), (9, f"{two} tail")]
    kept = minhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, one), (7, two)]


def test_a_large_group_of_copies_is_one_vertex(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(TEXTS[5])).otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"))
    out = minhash_dedup.near_duplicates(docs).groupBy("component_id").count().where("count > 1").collect()
    assert [(r["component_id"], r["count"]) for r in out] == [(0, 1000)]


@pytest.mark.parametrize("most", [0, 12])
def test_copies_beyond_what_is_held_are_joined_all_the_same(spark, monkeypatch, most):
    """No set is broadcast, or only those that more than a twelfth of the rows share."""
    texts = families(5, 4, 5)
    rows = list(enumerate([*texts, *texts[:6], *[texts[0]] * 9, None, "", *[texts[1]] * 2]))
    monkeypatch.setattr(minhash_dedup, "MOST_HELD", most)
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute(rows, 5)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def items(seed, n=25):
    rng = random.Random(seed)
    return [(i, " ".join(f"item{rng.randrange(900)}" for _ in range(rng.randrange(6, 60)))) for i in range(n)]


def weighted(window, item, size=5):
    """Sum of minima over sum of maxima of shingle counts, a shingle weighing its bytes."""

    def counts(words):
        out = {}
        for i in range(max(1, len(words) - size + 1)):
            s = tuple(words[i : i + size])
            out[s] = out.get(s, 0) + 1
        return out

    a, b = counts(window), counts(item)
    weigh = lambda s: sum(len(w) for w in s)
    low = sum(min(a.get(s, 0), b.get(s, 0)) * weigh(s) for s in a)
    return low / (sum(n * weigh(s) for s, n in a.items()) + sum(n * weigh(s) for s, n in b.items()) - low)


def test_decontamination_against_brute_force(spark):
    bench, rng = items(3, 10), random.Random(4)
    texts = []
    for i in range(40):
        filler = [f"plain{rng.randrange(5000)}" for _ in range(rng.randrange(10, 100))]
        if i % 2:
            own = bench[rng.randrange(len(bench))][1].split()
            for _ in range(rng.randrange(0, 3)):  # none, or a word or two changed
                own[rng.randrange(len(own))] = f"changed{i}"
            at = rng.randrange(len(filler))
            filler[at:at] = own
        texts.append(" ".join(filler))
    want = {}
    for i, text in enumerate(texts):
        words = text.split()
        want[i] = {k for k, t in bench if any(weighted(words[s : s + len(t.split())], t.split()) >= 0.8 for s in range(len(words) - len(t.split()) + 1))}
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontamination.decontaminate(documents(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert all(got[i] <= want[i] for i in got)  # verified exactly
    found, due = sum(map(len, got.values())), sum(map(len, want.values()))
    assert due >= 10
    assert found == due


def test_whole_items_are_always_found(spark):
    bench = items(9) + [(90, "three short words"), (91, None), (92, "")]
    texts = [f"Before it, {t.upper()}! and after" for _, t in bench if t]
    got = decontamination.decontaminate(documents(spark, texts), spark.createDataFrame(bench, "item_id long, text string"), max_block_bytes=600)
    assert all(r["contaminated"] and not r["kept"] for r in got.collect())


def test_multi_index_finds_all_within_radius():
    index, rng = decontamination.Index(items(5, 40), 5), random.Random(6)
    for i, (_, n, print_, _, _) in enumerate(index.items):
        for _ in range(20):
            flipped = print_
            for bit in rng.sample(range(64), rng.randrange(decontamination.RADIUS + 1)):
                flipped ^= 1 << bit
            assert i in index.near(n, flipped)


def test_blocks_hold_what_they_may(spark):
    bench = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([10, 30, 500, 20, 20])], "item_id long, text string")
    blocks = [[i for i, _ in b.items] for b in decontamination.item_blocks(bench, 300, 5)]
    assert blocks == [[0, 1], [2], [3, 4]]


def test_ties_name_the_smallest_item_first(spark):
    text = "one two three four five six seven"
    bench = spark.createDataFrame([(9, text), (4, text), (4, text)], "item_id long, text string")
    r = decontamination.decontaminate(documents(spark, [f"{text} and {text}"]), bench).collect()[0]
    assert (r["item_ids"], r["first_words"]) == ([4, 9], [0, 0])


@pytest.mark.parametrize("n", [6, 8, 10, 12, 14])
def test_recall_of_short_items_with_a_changed_word(spark, n):
    """An end word of a short item is changed: what of the pairs that are still alike is found."""
    rng = random.Random(n)
    bench = [(i, " ".join(f"s{rng.randrange(5000)}{'x' * rng.randrange(8)}" for _ in range(n))) for i in range(300)]
    texts = [" ".join([*(f"plain{rng.randrange(5000)}" for _ in range(20)), *t.split()[:-1], "it"]) for _, t in bench]
    due = {i for (i, t), x in zip(bench, texts, strict=True) if any(weighted(x.split()[s : s + n], t.split()) >= 0.8 for s in range(21))}
    got = {r["doc_id"] for r in decontamination.decontaminate(documents(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).where("contaminated").collect()}
    print(f"items of {n} words with a changed word: {len(due)} due, {len(got & due)} found")
    assert got == due


def test_decontamination_of_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, TEXTS[5])], "item_id long, text string")
    rows = decontamination.decontaminate(odd_documents(spark), bench).collect()
    assert len(rows) == len(TEXTS) + 3
    assert {r["doc_id"] for r in rows if r["contaminated"]} == {5, 6, 7, 8, 9}
    kept = decontamination.keep_clean(odd_documents(spark), bench)
    assert kept.columns == documents(spark).columns
    assert kept.count() == len(TEXTS) + 3 - 6
    assert decontamination.keep_clean(odd_documents(spark), bench.where("false")).count() == len(TEXTS) + 3
    assert decontamination.decontaminate(empty_documents(spark), bench).count() == 0
