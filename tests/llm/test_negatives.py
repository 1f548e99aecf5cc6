"""Hard negatives against scoring every pair."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hard_negatives as hn
from tallyforge.llm import registry

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string, block string, vector string"


def brute(rows, every=100, positives=5, negatives=5):
    """rows: (vec_id, components, label), copies of an anchor taken once."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in sorted({(i, tuple(v), y) for i, v, y in good if i % every == 0}):
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, w, z in good]
        best = sorted((s, j) for s, j, z in scored if z == y and j != i)[:positives]
        for p, j in best:
            fit = sorted((s, k) for s, k, z in scored if z != y and 80 * -p <= 100 * -s <= 100 * -p)[:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=100, parts=3):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % every == 0).collect())


def made(seed, n=600, labels=4, dims=20, kinds=6):
    """Vectors around a few centres, with ties and copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(kinds)] + 0.3 * rng.normal(size=dims)
        out.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(labels))))
    return out + [(n + i, out[i % 40][1], out[i % 40][2]) for i in range(80)]


@pytest.mark.parametrize("seed", range(3))
def test_mined_equals_brute_force(spark, seed):
    rows = made(seed)
    found = mined(spark, rows, every=20)
    assert found == brute(rows, every=20) and len(found) > 200


def test_blocks_do_not_show(spark, monkeypatch):
    rows = made(9)
    monkeypatch.setattr(hn, "BLOCK_BYTES", 9_000)
    monkeypatch.setattr(hn, "ANCHORS_A_BLOCK", 4)
    monkeypatch.setattr(hn, "_AT_ONCE", 3)
    assert mined(spark, rows, every=20) == brute(rows, every=20)


@pytest.mark.parametrize("coarse", [True, False])
def test_bounds_hold_and_refine(coarse):
    rng = np.random.default_rng(4)
    n, dims = 80, 32
    vectors = rng.integers(-300, 300, size=(2 * n, dims))
    if coarse:  # alike within segments, so that few pairs are left
        vectors = np.repeat(rng.integers(-300, 300, size=(2 * n, 2)), 16, axis=1) + rng.integers(-3, 3, size=(2 * n, dims))
    a, r = (hn.summarized(np.arange(n), np.zeros(n, np.int64), v) for v in (vectors[:n], vectors[n:]))
    exact = a.vectors @ r.vectors.T
    widths = []
    for mean_a, dev_a, mean_r, dev_r in zip(a.means, a.deviations, r.means, r.deviations, strict=True):
        middle, spread = mean_a @ mean_r.T, dev_a @ dev_r.T
        assert (exact <= middle + spread + 1e-3).all() and (exact >= middle - spread - 1e-3).all()
        widths.append(spread.mean())
    assert widths == sorted(widths, reverse=True)
    floor, ceiling = np.full(n, np.quantile(exact, 0.97)), np.full(n, np.quantile(exact, 0.995))
    i, j, scores = hn.possible(a, r, floor, ceiling, np.ones((n, n), bool))
    assert {(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)} == {(x, y) for x, y in np.argwhere((exact >= floor[0]) & (exact <= ceiling[0])).tolist()}
    assert (scores == exact[i, j]).all()


def test_rows_that_take_no_part_and_odd_values(spark):
    rng = random.Random(2)
    rows = made(5, n=120)
    rows += [(1000, None, 1), (1001, [0.5] * 20, None), (None, [0.5] * 20, 1), (1100, [None] + [0.1] * 19, 1), (1200, [float("nan")] + [0.1] * 19, 2), (1300, [float("inf")] * 20, 2), (1400, [float("-inf")] + [0.0] * 19, 1)]
    rows += [(1500, [], 0), (1600, [0.0] * 20, 0), (1601, [0.0] * 20, 1), (1700, [0.25] * 7, 1), (1800, [2000.0] * 20, 3), (1801, [-2000.0] * 20, 3), (1802, [1999.0] * 20, 0), (-200, [0.3] * 20, 2)]
    rows += [rows[0], rows[0], rows[7], (20, rows[20][1], 99)]
    rng.shuffle(rows)
    assert mined(spark, rows, every=20) == brute(rows, every=20)


def test_hot_vector_and_empty_table(spark):
    rows = made(6, n=200) + [(5000 + i, made(6)[0][1], i % 2) for i in range(400)]
    assert mined(spark, rows, every=50) == brute(rows, every=50)
    assert mined(spark, rows[:1]) == [] and mined(spark, [(7, [1.0], 1)]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.mine(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert [r["label"] for r in hn.with_moved_labels(spark.createDataFrame([(7, 9), (8, 9), (14, None), (None, 3)], "vec_id long, label int")).collect()] == [0, 9, None, 3]


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = registry.op13_hard_negatives(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()['op13_hard_negatives']})").fetchall())
