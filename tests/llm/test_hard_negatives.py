"""Hard negatives against every score there is."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn
from tidemark.llm.hard_negatives import Tree, hard_negatives, str_order

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, tree string, row int, block long"


def brute(rows, positives=5, negatives=5):
    """Rows are (vec_id, vector, label) that take part."""
    made = [(i, [int(np.floor(256 * c)) for c in v], label) for i, v, label in rows]
    out = Counter()
    for i, v, label in made:
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in made if j != i), key=lambda s: s[:2])
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            good = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out.update((i, j, n, x, -p, -s) for n, (s, x, _) in enumerate(good, 1))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], SCHEMA).repartition(3)


def told(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def made_rows(n=700, d=6, spread=1.0):
    r = random.Random(8)
    centre = {k: [r.gauss(0, spread) for _ in range(d)] for k in range(4)}
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else r.randint(1, 3)
        rows.append((i, [c + r.gauss(0, 0.4) for c in centre[r.randint(0, 3)]], label))
    rows += [(1000 + i, [0.5] * d, i % 2) for i in range(60)] + [(2000, [0.5] * d, 1), (2100, [0.0] * d, 0), (2200, [-0.5] * d, 7), (2300, [-0.5] * d, 7)]
    return rows


@pytest.mark.parametrize("leaf, tree, block, shelf", [(64, 4096, 1024, 64), (4, 40, 3, 2)])
def test_against_every_score(spark, monkeypatch, leaf, tree, block, shelf):
    for name, value in (("LEAF_ROWS", leaf), ("TREE_ROWS", tree), ("BLOCK_ANCHORS", block), ("SHELF_TREES", shelf)):
        monkeypatch.setattr(hn, name, value)
    rows = made_rows()
    odd = [(100, None, 1), (200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (300, [float("nan")] * 6, 1), (400, [float("inf")] * 6, 1), (500, [0.1] * 6, None), (600, [], 2), (700, [1.0, 2.0], 2), (None, [9.0] * 6, 1), (800, [1e30] * 6, 1)]
    out = hard_negatives(table(spark, rows + odd), F.col("vec_id") % 100 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 50 and told(out) == want


def test_long_numbers(spark):
    """Components whose products doubles do not hold."""
    rows = [(i, [x * 4e5 for x in v], label) for i, v, label in made_rows(200)]
    assert told(hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)) == brute(rows)


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 1)] * 3 + [(5, [0.9, 0.1], 1)] * 2 + [(6, [0.85, 0.0], 2)] * 7
    out = told(hard_negatives(table(spark, rows), F.col("vec_id") == 0))
    # each anchor row, each of its positive rows, and as many equal negatives as asked for
    assert out == Counter({(0, 5, n, 6, 256 * 230, 256 * 217): 6 for n in range(1, 6)})


def test_empty(spark):
    assert hard_negatives(table(spark, []), F.col("vec_id") == 0).count() == 0
    one = [(i, [1.0, float(i)], 1) for i in range(20)]
    assert hard_negatives(table(spark, one), F.col("vec_id") == 0).count() == 0
    assert hard_negatives(table(spark, one), F.lit(None).cast("boolean")).count() == 0


def test_packing_and_pruning():
    rng = np.random.default_rng(5)
    x = rng.integers(-100, 100, (5000, 3)).astype(np.int32)
    order = str_order(x, [0, 1, 2], 64)
    assert sorted(order.tolist()) == list(range(5000))
    tree = Tree(x[order], order.astype(np.int64), order.astype(np.int64))
    for level, (low, high) in enumerate(tree.levels):
        size = 64 * 8**level
        assert all((tree.x[i * size:(i + 1) * size].min(0) == low[i]).all() and (tree.x[i * size:(i + 1) * size].max(0) == high[i]).all() for i in range(len(low)))
    leaves = np.prod(tree.levels[0][1] - tree.levels[0][0] + 1, axis=1).mean()
    assert leaves < 0.05 * 200**3  # packed boxes are small
    opened = []
    whole, needed = x.astype(np.int64), tree.needed
    tree.needed = lambda level, *a: opened.append(level) or needed(level, *a)
    for q in whole[:40]:
        got = [tree.ids[p].tolist() for p in tree.search(q, -1, 5, np.array([0, 5000, -10**6]), np.array([10**9, 6000, -5000]))]
        scores = whole @ q
        for ids, (low, high) in zip(got, [(0, 10**9), (5000, 6000), (-10**6, -5000)]):
            inside = [i for i in range(5000) if low <= scores[i] <= high]
            assert ids == sorted(inside, key=lambda i: (-scores[i], i))[:5]
    assert opened.count(0) < 40 * len(tree.levels[1][0])  # not every inner node was opened
