"""Packing, token files, sharding, WARC, page text and the pipeline."""

import base64
import functools
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edge import TEXTS, documents, empty_documents, odd_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyforge.llm import _shared, _tokens, html_extraction, packing, quality_rules, sharding, token_output, warc

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ids_of():
    library = Tokenizer.from_file(_tokens.default_path())
    return functools.cache(lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 1])


def lossless(pieces, texts, ids_of):
    """The pieces of each document, in order, are its ids."""
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids, at = np.array(ids_of(text), "<u4"), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] >= 1
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_tokens_equal_the_library(ids_of):
    texts = [*(t or "" for t in TEXTS), "I'll we'RE they've o'clock ''s don't 'tis", "ÀÉ×÷ß ŉ ﬁ é", "<|startoftext|>a", "x" * 3000]
    found = [ids[of[d] : of[d + 1]].tolist() for _, ids, of in _tokens.encoded(pa.array(texts), _tokens.default_path()) for d in range(len(of) - 1)]
    assert found == [ids_of(t)[:-1] for t in texts]


def test_packing_is_lossless_and_gapless(spark, ids_of):
    pieces = packing.pack(documents(spark)).collect()
    lossless(pieces, dict(enumerate(TEXTS)), ids_of)
    by_sequence = defaultdict(list)
    for p in pieces:
        assert p["doc_tokens"] == len(ids_of(TEXTS[p["doc_id"]]))
        by_sequence[p["sequence_id"]].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048


def test_packer_keeps_every_limit():
    rng = np.random.default_rng(3)
    examples = [(i, 0, int(n), int(rng.integers(0, n + 1))) for i, n in enumerate(rng.integers(1, 900, 800))]
    packer = packing.Packer((1000, 6, 500), cut=False)
    need = {e[0]: e for e in examples}
    for i in range(0, len(examples), 200):
        packer.add(examples[i : i + 200])
    packer.finish()
    placed = packer.take()
    assert sorted(p[0] for s in placed for p in s) == sorted(need)
    for s in placed:
        alone = len(s) == 1
        assert sum(p[2] for p in s) <= 1000 and len(s) <= 6
        assert alone or sum(need[p[0]][3] for p in s) <= 500


def test_packer_takes_the_dot_product_at_any_count():
    packer = packing.Packer((100, 10, 100), cut=True, most_open=2)
    packer.add([(0, 0, 60, 0), (1, 0, 55, 55)])
    assert len(packer.open) == packer.most_open
    packer.add([(2, 0, 20, 20)])  # its loss goes where there is room for loss, not to the fullest by tokens or by loss
    packer.add([(3, 0, 10, 0)])
    packer.finish()
    assert {tuple(sorted(p[0] for p in s)) for s in packer.closed} == {(0, 2), (1, 3)}


class Watched(packing.Packer):
    """Holds every placement in an open sequence against the dot products of all that have room."""

    chosen = fresh = cut_short = 0

    def _best(self, tokens, loss):
        best = super()._best(tokens, loss)
        need = np.array([tokens, 1, loss], float) / self.limits
        able = {i: float(need @ (room / self.limits)) for i, room in enumerate(self.rooms) if (room >= need * self.limits - 1e-9).all()}
        assert (best is None) == (not able)
        if able:
            assert able[best] >= max(able.values()) - 1e-12
            self.chosen += 1
        return best

    def _new(self):
        self.fresh += 1
        return super()._new()

    def _divide(self, piece):
        done = super()._divide(piece)
        self.cut_short += done
        return done

    def _put(self, at, piece):
        self.puts = getattr(self, "puts", 0) + 1
        super()._put(at, piece)


def test_every_placement_is_by_the_dot_product():
    rng = np.random.default_rng(5)
    examples = [(i, 0, int(n), int(n) - int(rng.integers(0, min(n, 60)))) for i, n in enumerate(rng.integers(1, 3000, 6000))]
    packer = Watched((2048, 64, 2048), cut=True)
    for i in range(0, len(examples), 1500):
        packer.add(examples[i : i + 1500])
        assert len(packer.open) <= packer.most_open
    # A piece goes where the dot product says, into a new sequence, or is cut where none has room for it.
    assert packer.puts == packer.chosen + packer.fresh + packer.cut_short
    print(f"placed by dot product {packer.chosen}, in new sequences {packer.fresh}, cut {packer.cut_short}")


def test_a_prompt_bears_no_loss(spark, ids_of):
    for p in packing.pack(documents(spark), prompt_tokens=5).where("start = 0").collect():
        assert p["loss_tokens"] == max(1 if p["length"] == p["doc_tokens"] else 0, p["length"] - min(5, p["doc_tokens"] - 1))


def test_packing_holds_the_limit_of_loss_tokens(spark, ids_of):
    docs = documents(spark).withColumn("answer", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") * 40))
    for pieces in (packing.pack(docs, loss=300, loss_tokens="answer").collect(), packing.pack(docs, loss=300, loss_tokens=F.col("answer")).collect()):
        lossless(pieces, dict(enumerate(TEXTS)), ids_of)
        by_sequence, bearing = defaultdict(list), {i: min(i * 40, len(ids_of(t))) if i % 3 else len(ids_of(t)) for i, t in enumerate(TEXTS)}
        for p in pieces:
            by_sequence[p["sequence_id"]].append(p)
            begin = p["doc_tokens"] - bearing[p["doc_id"]]
            assert p["loss_tokens"] == max(0, p["start"] + p["length"] - max(begin, p["start"]))
        assert all(sum(p["loss_tokens"] for p in s) <= 300 and sum(p["length"] for p in s) <= 2048 for s in by_sequence.values())


def test_packing_pads_little(spark):
    docs = _shared.table(spark, "/root/testdata/sf0.01", "documents").coalesce(1)
    pieces = packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.count("*").alias("s"), F.sum("n").alias("n")).collect()[0]
    assert pieces["n"] / (2048 * pieces["s"]) > 0.97


def test_packing_of_odd_and_empty_tables(spark):
    assert packing.pack(odd_documents(spark)).where("start = 0").count() == len(TEXTS) + 3
    assert packing.pack(empty_documents(spark)).count() == 0


def test_token_files_round_trip(spark, ids_of):
    manifest = token_output.write_packed(documents(spark), _shared.new_folder(spark, "tokens"), buffer_tokens=20_000)
    lossless(token_output.read_packed(spark, manifest).collect(), dict(enumerate(TEXTS)), ids_of)
    for m in manifest.collect():
        matrix, cu, begin, resets, segments = token_output.read_shard(m["shard"], m["row_tokens"], m["id_bytes"])
        assert matrix.shape == (m["n_rows"], 2048) and len(begin) == m["n_rows"] + 1
        assert len(resets) == segments.num_rows == m["n_segments"]
        for r in range(m["n_rows"]):
            own = cu[begin[r] : begin[r + 1]]
            assert own[0] == 0 and own[-1] <= 2048 and (np.diff(own) > 0).all()
            assert not matrix[r, own[-1] :].any()


def test_open_rows_hold_a_buffer_of_ids():
    rows, written = token_output.Rows(2048, 32, 100_000), 0
    for i in range(100):
        rows.add([(100 * i + k, 0, 1025) for k in range(100)])
        assert rows.held == sum(len(x) * (2048 - room) for room, x in rows.open.items()) <= 100_000
        written += len(rows.take())
    assert written + len(rows.take(True)) == 10_000


def test_token_shards_have_the_same_names_in_each_run(spark):
    runs = [token_output.read_packed(spark, token_output.write_packed(documents(spark), _shared.new_folder(spark, "tokens"))) for _ in range(2)]
    assert runs[0].exceptAll(runs[1]).isEmpty() and runs[1].exceptAll(runs[0]).isEmpty()


def test_capacity_tree_is_best_fit():
    tree, held = token_output.CapacityTree(64), []
    rng = np.random.default_rng(8)
    for _ in range(500):
        if held and rng.random() < 0.5:
            tree.add(held.pop(int(rng.integers(len(held)))), -1)
        else:
            held.append(int(rng.integers(1, 65)))
            tree.add(held[-1])
        n = int(rng.integers(1, 65))
        assert tree.least(n) == min((x for x in held if x >= n), default=None)


def test_token_files_of_odd_and_empty_tables(spark):
    manifest = token_output.write_packed(odd_documents(spark), _shared.new_folder(spark, "tokens"), wide=True)
    assert token_output.read_packed(spark, manifest).where("start = 0").count() == len(TEXTS) + 3
    assert token_output.write_packed(empty_documents(spark), _shared.new_folder(spark, "tokens")).count() == 0


def check_shards(rows, shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    sizes = [len(by_shard.get(s, ())) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by_shard) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())


def test_sharding_is_balanced_whatever_the_keys(spark):
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    rows = sharding.shard(hot, shards=7).collect()
    assert len(rows) == 5000 and len({r["doc_id"] for r in rows}) == 5000
    check_shards(rows, 7)
    for r in rows[:200]:
        text = "hot" if r["doc_id"] % 3 == 0 else f"t{r['doc_id'] % 700}"
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text.encode()))


def test_sharding_equals_brute_force(spark):
    """Row by row: each to its place's owner, what overflows clockwise to the next with room."""
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 90).cast("string")).alias("text"))
    n_shards, slots = 6, 64
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, shards=n_shards, slots=slots, virtual=4, parts=3).collect()}
    place, part = F.pmod(F.xxhash64("text"), F.lit(slots)), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))
    rows = sorted((r[0], r[1], r[2]) for r in docs.select(place, part, "doc_id").collect())
    owner, bounds = sharding.ring(n_shards, slots, 4), [700 // 6 + (s < 700 % 6) for s in range(n_shards)]
    held, over, want = [0] * n_shards, [], {}

    def put(doc_id, shard):
        want[doc_id] = (shard, held[shard])
        held[shard] += 1

    for at, _, doc_id in rows:
        if held[owner[at]] < bounds[owner[at]]:
            put(doc_id, owner[at])
        else:
            over.append((at, doc_id))
    for at, doc_id in over:
        while held[owner[at]] >= bounds[owner[at]]:
            at = (at + 1) % slots
        put(doc_id, owner[at])
    assert got == want


def test_one_more_shard_moves_little(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    one, two = ({r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=n).collect()} for n in (10, 11))
    # The new shard's share, and as much again for the bounds, which shrink by it.
    assert sum(one[i] != two[i] for i in one) < 2 * len(one) / 11 + 0.05 * len(one)


def test_sharding_of_odd_and_empty_tables(spark):
    rows = sharding.shard(odd_documents(spark), shards=4).collect()
    assert len(rows) == len(TEXTS) + 3
    check_shards(rows, 4)
    assert sharding.shard(empty_documents(spark)).count() == 0


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://b/\r\n", "<p>x</p>"), (5, "u", "é" * 50_000), (6, "u", "\x1f\x8b\x08 not a member"), (7, "u", "<p>x</p>")]


@pytest.mark.parametrize("split", [64, 1000, 8 << 20])
def test_warc_round_trip_at_any_split(spark, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    manifest = warc.write_warc(pages, _shared.new_folder(spark, "warc"), file_bytes=300)
    got = {r["page_id"]: r for r in warc.read_warc(spark, manifest, split_bytes=split).collect()}
    assert len(got) == len(PAGES)
    last = {}
    for page_id, _, html in PAGES:
        last[html or ""] = page_id
    for page_id, _, html in PAGES:
        r, payload = got[page_id], (html or "").encode()
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if last[html or ""] == page_id:
            assert r["record_type"] == "response" and bytes(r["content"]) == payload
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == last[html or ""]


def test_warc_of_odd_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, None, None), (None, "u", "x"), (1, "u", "x"), (1, "u", "x")], "page_id long, url string, html string")
    out = warc.summary(warc.read_warc(spark, warc.write_warc(pages, _shared.new_folder(spark, "warc")))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in out) == [(0, "response"), (0, "revisit"), (1, "response"), (1, "response")]
    none = warc.write_warc(pages.where("false"), _shared.new_folder(spark, "warc"))
    assert warc.read_warc(spark, none).count() == 0


def test_page_text_without_boilerplate():
    html = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Home</a></nav>
    <article><h1>A &amp; B</h1><p>First   <b>bold</b>\n text</p><div class="ad">Buy</div><form><input><label>Mail</label></form><p>Second</p></article>
    <aside>Side</aside><div id="comments"><p>Nice!</p></div><footer>Foot</footer><script>var p = "<p>no</p>";</script></body></html>"""
    assert html_extraction.main_text(html) == "A & B\nFirst bold text\nSecond"
    assert html_extraction.main_text("") == ""
    assert html_extraction.main_text("<p>cut <b") == "cut"


def test_host_template_is_deduced(spark):
    rows = [(i, f"http://h/{i}", f"<div><div>Our town paper</div><div>Story {i} is here</div><div>All the news since 1900</div></div>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(pages).collect()}
    assert got == {i: f"Story {i} is here" for i in range(12)}
    joined = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(pages, max_broadcast_tokens=0).collect()}
    assert joined == got


def test_host_template_acts_inside_articles(spark):
    share = "<p>Share this story</p>"  # twice on each page, in no element with a tell-tale name
    rows = [(i, f"http://h/{i}", f"<div><p>Our town paper</p></div><article>{share}<h1>Title {i}</h1><p>Story {i} is here</p>{share}<p>All the news since 1900</p></article><div><p>Printed in town</p></div>") for i in range(12)]
    rows.append((20, "http://h/20", "<div><p>Our town paper</p></div><section><p>No article here</p></section><div><p>Printed in town</p></div><p>Outside it</p>"))
    rows += [(30 + i, f"http://copies/{i}", "<article><h1>One</h1><p>And the same page again</p></article>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Title {i}\nStory {i} is here" for i in range(12)} | {20: "No article here"} | {30 + i: "One\nAnd the same page again" for i in range(12)}
    for most in (100_000, 0):
        assert {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(pages, max_broadcast_tokens=most).collect()} == want


def test_names_of_an_article_s_parts(spark):
    html = "<div class='share'><p>Outside</p></div><article><div class='legal'><p>By law</p></div><p>Sum <math><mi>x</mi></math></p><div class='ad'>Buy</div><noscript>Turn it on</noscript></article>"
    assert html_extraction.main_text(html) == "By law\nSum x"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>Long real text <span class='ad'>Ad</p><p>more</p></article>", "Long real text\nmore"),
        ("<article><p>Real <span class='ad'>BUY NOW</span> text</p></article>", "Real text"),
        ("<article><p>Text with <label>Name</label> <select><option>A<option>B</select> tail</p></article>", "Text with tail"),
        ("<article><p>One</p><button>Subscribe</button><p>Two</p>Three <button>Go</button> four</article>", "One\nTwo\nThree four"),
        ("<article><h2 class='section-header'>Part one</h2><h3 class='header'>Part two</h3><div class='menu-card'>Soup</div><div class='header'>Site</div><div class='ad-box'>Buy</div></article>", "Part one\nPart two\nSoup"),
        ("<div class='site-header'>Site</div><p>Text</p><div id='nav-menu'>Home</div>", "Text"),
        ("<p>a &amp;<b class='promo'>x</b>lt; b</p>", "a &lt; b"),
    ],
)
def test_each_piece_of_text_goes_by_its_element(html, text):
    assert html_extraction.main_text(html) == text


def test_near_copies_of_a_host_keep_their_article(spark):
    long = "".join(f"<p>The same paragraph {k} of a long story about the town and its river</p>" for k in range(6))
    rows = [(i, f"http://same/{i}", f"<nav>Entry {i}</nav><article><h1>Story</h1>{long}</article><footer>f</footer>") for i in range(10)]
    rows += [(100 + i, f"http://dated/{i}", f"<article><h1>Story</h1><p>Seen {i} times</p>{long}</article>") for i in range(10)]
    rows += [(200 + i, f"http://own/{i}", f"<article><h1>Title {i}</h1><p>A paragraph of page {i} on its own subject</p><p>Share this story</p><p>All the news since 1900</p></article>") for i in range(10)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    body = "\n".join(f"The same paragraph {k} of a long story about the town and its river" for k in range(6))
    for i in range(10):
        assert got[i] == f"Story\n{body}" and got[100 + i] == f"Story\nSeen {i} times\n{body}"
        assert got[200 + i] == f"Title {i}\nA paragraph of page {i} on its own subject"


def test_a_very_long_page():
    html = "<article>" + "<p>word &amp; word</p>" * 60_000 + "<ul><li>a<li>b" * 2000
    text = html_extraction.main_text(html)
    assert text.count("\n") == 64_000 - 1 and text.startswith("word & word\nword & word") and text.endswith("a\nb")


def brute_template(htmls, min_pages, min_share):
    """Tokens in valid classes, by whole occurrence vectors over distinct pages."""
    parsed = [html_extraction.parse(h or "") for h in sorted(set(htmls), key=str)]
    counts, first = defaultdict(dict), defaultdict(dict)
    for k, page in enumerate(parsed):
        for place, token in enumerate(t[:3] for t in page.tokens):
            counts[token][k] = counts[token].get(k, 0) + 1
            first[k].setdefault(token, place)
    most, classes = max(map(len, counts.values()), default=0), defaultdict(list)
    for token, on in counts.items():
        if len(on) >= min_pages and len(on) >= most * min_share:
            classes[tuple(sorted(on)) if len(set(on.values())) == 1 else tuple(sorted(on.items()))].append(token)
    valid = set()
    for vector, tokens in classes.items():
        for kind in "et":
            own = [t for t in tokens if t[0] == kind]
            orders = {tuple(sorted(own, key=first[k].get)) for k in [x[0] if isinstance(x, tuple) else x for x in vector]}
            if len(tokens) > 1 and len(orders) == 1:
                valid.update(own)
    return {html_extraction._token(*t) for t in valid}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_equal_brute_force(spark, seed):
    rng, rows = np.random.default_rng(seed), []
    for site in range(3):
        for i in range(int(rng.integers(3, 14))):
            blocks = [f"<p>Fixed {b}</p>" if rng.random() < 0.9 else "" for b in range(3)] + [f"<div class='c{int(rng.integers(2))}'>Story {i} {b}</div>" for b in range(int(rng.integers(1, 4)))]
            if rng.random() < 0.3:
                rng.shuffle(blocks)
            twice = "<p>Twice</p>" * int(rng.integers(1, 3))
            rows.append((len(rows), f"http://h{site}/{i}", f"<main>{twice}{''.join(blocks)}</main><p>End</p>"))
    rows += [(900, "http://h0/copy", rows[0][2]), (901, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = defaultdict(set)
    for r in html_extraction.templates(pages, min_pages=4).collect():
        got[r["host"]].add(r["token"])
    for site in ("h0", "h1", "h2"):
        assert got[site] == brute_template([h for _, u, h in rows if u and f"/{site}/" in u], 4, 0.5)
    assert set(got) <= {"h0", "h1", "h2"}


def test_page_text_of_odd_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "", ""), (2, "x", "<")], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("t"))
    assert html_extraction.extract_main_text(pages).count() == 4
    assert html_extraction.extract_main_text(pages.where("false")).count() == 0


def test_pipeline_rules_do_not_depend_on_the_stage_before(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (_shared.table(spark, sf_dir, x) for x in ("documents", "labels"))
    before = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti").select(docs.columns)  # no labelled bad document is left
    ids = [sorted(r[0] for r in x.select("doc_id").collect()) for x in (corpus_pipeline.apply_quality_rules(spark, before, sf_dir), quality_rules.keep_good(before, quality_rules.fit(docs, labels)), quality_rules.keep_good(before, None))]
    print("kept by the stage, by op2's model, by base rules alone:", *map(len, ids))
    assert ids[0] == ids[1] != ids[2]


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, ties, a very long text, clashing columns; then tables without rows."""
    docs, empty = odd_documents(spark), empty_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))] + [(None, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "naïve café £5 déjà-vu"), (None, "x"), (2, None)], "item_id long, text string")
    for name, tables in (("odd", (docs, labels, bench)), ("empty", (empty, labels.where("false"), bench.where("false"))), ("bare", (docs, labels.where("false"), bench.where("false")))):
        for table, df in zip(("documents", "labels", "benchmark"), tables, strict=True):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        own = _shared.table(spark, f"file://{tmp_path}/{name}", "documents")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            after = _shared.written(f(spark, own, f"file://{tmp_path}/{name}"), f"odd-{stage}")
            assert after.columns == docs.columns and after.exceptAll(own).isEmpty()
            own = after
        pieces = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}")
        assert pieces.where("start = 0").count() == own.count()
        assert (own.count() > 0) == (name != "empty")


def test_pipeline_stages_decide(spark, ids_of):
    docs = _shared.table(spark, SF_DIR, "documents")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "minhash_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = _shared.written(stage(spark, docs, SF_DIR), f"test-{name}")
        assert after.columns == columns
        before, left = ({tuple(r) for r in x.select("doc_id", "text").collect()} for x in (docs, after))
        assert left <= before and len(left) > 0.5 * len(before)
        docs = after
    kept = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    lossless(corpus_pipeline.run(spark, SF_DIR).collect(), kept, ids_of)
