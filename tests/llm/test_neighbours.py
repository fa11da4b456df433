"""Neighbours against brute force, the graph's parts, and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import learned_ann
from tidemark.llm.learned_ann import balanced_parts, nearest, neighbour_graph

SCHEMA = "vec_id long, embedding array<float>, label int, part int, vector string"


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist() if v is not None else None, 0, 9, "x") for i, v in zip(ids, x)], SCHEMA)


def by_force(ids, x, k=10):
    x = np.array(x, np.float32).astype(float)
    out = {}
    for i, q in zip(ids, x):
        if i % 100 == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            d[np.array(ids) == i] = np.inf
            order = [j for j in np.lexsort((ids, d)) if np.isfinite(d[j])][:k]
            out[i] = [(ids[j], d[j]) for j in order]
    return out


def clusters(n, seed=1, d=24):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((30, d)) * 2
    return centres[r.integers(0, 30, n)] + r.standard_normal((n, d))


def test_recall_and_scores(spark):
    x = clusters(6000)
    ids = list(range(6000))
    out = nearest(table(spark, ids, x).repartition(4), F.col("vec_id") % 100 == 0).collect()
    want = by_force(ids, x)
    hits = 0
    for q, best in want.items():
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        exact = dict(best)
        hits += sum(r.vec_id in exact for r in got)
        assert all(abs(exact[r.vec_id] - r.score) < 1e-12 for r in got if r.vec_id in exact)
    assert hits >= 0.9 * 10 * len(want)


def test_small_tables_are_exact(spark, monkeypatch):
    for n in (1, 2, 5, 60):
        x = clusters(n, n)
        out = nearest(table(spark, range(n), x), F.col("vec_id") % 100 == 0).collect()
        want = by_force(list(range(n)), x)
        assert [(r.vec_id, round(r.score, 9)) for r in sorted(out, key=lambda r: r["rank"])] == [(i, round(s, 9)) for i, s in want[0]]


def test_one_vector_many_times(spark, monkeypatch):
    """Ties go to the smaller ids, whatever share of the rows is equal; blocks are bounded."""
    monkeypatch.setattr(learned_ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(learned_ann, "BLOCK_QUERIES", 2)
    x = [*np.ones((700, 4)), *clusters(300, 4, 4)]
    ids = list(range(1000))
    out = nearest(table(spark, ids, x), F.col("vec_id") % 100 == 0).collect()
    for q in range(0, 700, 100):
        assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] == [i for i in range(12) if i != q][:10]


def test_queries_of_small_parts_go_on(spark, monkeypatch):
    """Part 0 holds four ids, one of them thirty times and a query; part 1 the rest, parts 2 to 7 nothing."""
    x = [np.array([1.0, i / 100]) for i in range(4)] + [np.array([0.1, 5 + i]) for i in range(396)]
    rows = table(spark, [*range(400), *[0] * 29], [*x, *[x[0]] * 29])
    small = learned_ann.Router(np.zeros(2), 1.0, (np.array([[1.0], [0.0]]), np.zeros(1), np.eye(1, 8), np.array([-0.5] + [0.0] * 7)), 1)
    monkeypatch.setattr(learned_ann, "learn", lambda x, parts: small)
    out = nearest(rows, F.col("vec_id") % 100 == 0).collect()
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 0] == [*range(1, 11)]
    assert all(sum(r.query_id == q for r in out) == 10 for q in (0, 100, 200, 300))
    few = nearest(rows.filter("vec_id < 6"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]


def test_rows_that_take_no_part(spark):
    x = clusters(300, 7, 6)
    good = table(spark, range(300), x)
    bad = spark.createDataFrame([
        (400, None), (500, [0.0] * 6), (600, [1.0, None] + [1.0] * 4), (700, [float("nan")] * 6), (800, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (900, [1.0, 2.0]), (901, [])],
        "vec_id long, embedding array<float>").selectExpr("*", "0 as label", "1 as part", "'y' as vector")
    out = nearest(good.unionByName(bad), F.col("vec_id") % 100 == 0)
    assert {r.query_id for r in out.collect()} == {0, 100, 200}
    assert out.filter("vec_id >= 300").count() == 0 and out.count() == 30
    assert nearest(bad.filter("vec_id <= 800"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 5, 8])
def test_parts_are_balanced_and_cut_few_edges(parts):
    x = clusters(1200, 2)
    graph = neighbour_graph(x, 10)
    part = balanced_parts(graph, parts)
    sizes = np.bincount(part, minlength=parts)
    assert sizes.max() - sizes.min() <= 3 and len(sizes) == parts
    cut = (part[graph] != part[:, None]).mean()
    by_chance = (np.random.default_rng(0).permutation(part)[graph] != part[:, None]).mean()
    assert parts == 1 or cut < 0.45 * by_chance
