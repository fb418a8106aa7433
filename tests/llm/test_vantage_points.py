import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import vantage_points
from wattline.llm.vantage_points import KEPT, Tree, _plant, mine_hard_negatives, op12_vantage_points

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=3):
    held = set()
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.add((-(2**63) if i is None else i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in held:
        if not is_anchor(i):
            continue
        near = sorted({(-dot(v, w), j) for j, m, w in held if j != i and m == label})[:positives]
        for score, j in near:
            far = sorted({(-dot(v, w), n) for n, m, w in held if n != i and m != label and 50 * -score <= 100 * dot(v, w) <= 95 * -score})[:negatives]
            out += [(i, j, rank, n, -score, -s) for rank, (s, n) in enumerate(far, 1)]
    null = lambda x: None if x == -(2**63) else x
    return sorted(((null(a), null(b), r, null(n), p, s) for a, b, r, n, p, s in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(seed, n, dim=8, clusters=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, dim))
    return [(k, [float(x) for x in (centres[k % clusters] + 0.3 * rnd.normal(size=dim)).astype(np.float32)], int(rnd.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(vantage_points, "LEAF", 4)
    monkeypatch.setattr(vantage_points, "AT_ONCE", 7)
    rows = vectors(seed, 500)
    same = rows[3][1]
    rows += [(1000 + k, same, k % 2) for k in range(60)]  # a group of copies in two labels
    rows += [(5, rows[5][1], rows[5][2]), (5, rows[9][1], 2), (40, [0.0] * 8, 1), (2000, [], 1), (2010, [0.5] * 3, 1), (2020, [0.5] * 12, 2), (None, same, 1)]
    rows += [(2030, None, 1), (2040, same, None), (2050, [None] + same[1:], 1), (2060, [float("nan")] + same[1:], 1), (2070, [float("inf")] + same[1:], 1)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("query", F.lit(1)).withColumn("id", F.lit("x")).withColumn("score", F.lit(None)).repartition(3)
    got = found(mine_hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == brute(rows, lambda i: i != -(2**63) and i % 10 == 0)
    assert len({r[0] for r in got}) > 30


def test_anchors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vantage_points, "ANCHORS", 15)
    rows = vectors(3, 300)
    assert found(mine_hard_negatives(spark.createDataFrame(rows, COLUMNS), F.col("vec_id") % 9 == 0)) == brute(rows, lambda i: i % 9 == 0)


def test_a_tree_visits_few_leaves_where_rows_cluster(monkeypatch):
    monkeypatch.setattr(vantage_points, "LEAF", 16)
    rows = vectors(4, 4000, dim=4, clusters=40)
    points = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    tree = Tree(*(x.as_py() for x in next(zip(*_plant(np.arange(4000), np.zeros(4000, dtype=np.int64), points).columns, strict=True))))
    exact, seen = points.astype(float), []
    gathered = np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b: (seen.append(len(a)), gathered(a, b))[1])
    best = np.full((50, 1, 5), vantage_points.NOWHERE), np.zeros((50, 1, 5), dtype=np.int64)
    query = {"points": exact[:50], "ids": np.arange(50), "labels": np.zeros(50, dtype=np.int64), "same": True}
    query |= {"low": np.full((50, 1), vantage_points.NOWHERE + 1), "high": np.full((50, 1), 2**62)}
    tree.search(query, np.arange(50), *best)
    want = np.sort(np.where(np.arange(4000) == np.arange(50)[:, None], -(2.0**60), exact[:50] @ exact.T), axis=1)[:, :-6:-1]
    assert (best[0][:, 0] == want).all() and sum(seen) < 0.5 * 50 * len(tree.ids)


def test_bounds_hold_for_every_row():
    rnd = np.random.default_rng(5)
    points = rnd.integers(-300, 300, (1000, 10))
    tree = Tree(*(x.as_py() for x in next(zip(*_plant(np.arange(1000), rnd.integers(0, 3, 1000), points).columns, strict=True))))
    anchors = rnd.integers(-300, 300, (40, 10)).astype(float)
    most, least = tree.leaf_bounds(anchors, (anchors * anchors).sum(axis=1))
    scores = np.einsum("lpd,ad->alp", tree.points, anchors)
    assert (scores <= most[:, :, None]).all() and (scores >= least[:, :, None]).all()
    assert sorted(tree.ids[tree.real].tolist()) == list(range(1000))


def test_copies_fill_no_tree():
    points = np.repeat(np.arange(6).reshape(2, 3), 500, axis=0)
    tree = Tree(*(x.as_py() for x in next(zip(*_plant(np.arange(1000)[::-1].copy(), np.zeros(1000, dtype=np.int64), points).columns, strict=True))))
    assert sorted(tree.ids[tree.real].tolist()) == [*range(KEPT), *range(500, 500 + KEPT)]


def test_empty_table_and_wide_components(spark):
    assert mine_hard_negatives(spark.createDataFrame([], COLUMNS), F.lit(True)).collect() == []
    rows = [(k, [300.0 * (k + 1), -7.0 * k, 2.0**20], k % 2) for k in range(20)]
    assert found(mine_hard_negatives(spark.createDataFrame(rows, COLUMNS), F.lit(True))) == brute(rows, lambda i: True)


def test_query_over_its_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    turned = [(i, v, (label + 1) % 10 if i % 7 == 0 and label is not None else label) for i, v, label in rows]
    got = found(op12_vantage_points(spark, sf_dir))
    assert got == brute(turned, lambda i: i % 50 == 0) and len(got) > 100
