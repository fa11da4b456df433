"""Mixes and shards: targets, sums, gapless numbers, and reruns."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import kd_sharding, mixing
from tidemark.llm.common import numbered
from tidemark.llm.kd_sharding import kd_shards
from tidemark.llm.mixing import copies_by_size, histograms, mix, mixed_documents, solve_tilts, targets


def shared_out(sizes):
    """Shares by weight; what is above three times a source is shared again, until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            got.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            got[s] = 3.0 * sizes[s]
        left -= sum(got[s] for s in over)
        open_ -= set(over)
    return got


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 1000, None: 5}, {None: 7}, {"b": 0, "a": 50, "é": 3, "z": 4, "Z": 900}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").select(mixing.source_key(F.col("source")).alias("_source"), "source_size")
    out = {r._source: r.target for r in targets(df).collect()}
    want = {("1" if s is None else "0" + s): t for s, t in shared_out(sizes).items()}
    assert out.keys() == want.keys() and all(math.isclose(out[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


@pytest.mark.parametrize("sizes_a_part", [1, 2, 1024])
def test_tilts_solve_the_constraints(spark, monkeypatch, sizes_a_part):
    monkeypatch.setattr(mixing, "PART_SIZES", sizes_a_part)
    sizes = [("0a", s, n) for s, n in ((1, 5), (10, 40), (100, 7), (5000, 1))] + [("0b", 3, 10), ("0c", 7, 1), ("0c", 9, 2)]
    whole = {s: sum(x * n for a, x, n in sizes if a == s) for s in ("0a", "0b", "0c")}
    wanted = [("0a", whole["0a"], whole["0a"] * 0.4), ("0b", whole["0b"], whole["0b"] * 3.0), ("0c", whole["0c"], whole["0c"] * 1.7)]
    sources = histograms(spark.createDataFrame(sizes, "_source string, size long, n long"), spark.createDataFrame(wanted, "_source string, source_size long, target double"))
    out = {r._source: r for r in solve_tilts(sources).collect()}
    for s, _, t in wanted:
        made = sum(n * x * min(3, math.exp(out[s].tilt * x / out[s]._mean)) for a, x, n in sizes if a == s)
        assert math.isclose(made, t, rel_tol=1e-6)


def test_many_sizes_of_one_source(spark):
    """40,000 distinct sizes: no row holds a source, the copies meet the target, and the sums are those of brute force."""
    sizes = spark.range(1, 40_001).selectExpr("'0hot' as _source", "id as size", "1 + id % 3 as n")
    total = sum(i * (1 + i % 3) for i in range(1, 40_001))
    wanted = spark.createDataFrame([("0hot", total, total * 0.37)], "_source string, source_size long, target double")
    parts = histograms(sizes, wanted).cache()
    held = parts.selectExpr("_part", "size(_steps) as k", "_steps[0].size as most").orderBy("_part").collect()
    assert sum(r.k for r in held) == 40_000 and max(r.k for r in held) <= mixing.PART_SIZES
    assert [r.most for r in held] == sorted((r.most for r in held), reverse=True)
    tilts = solve_tilts(parts)
    t = tilts.first()
    assert math.isclose(sum(i * (1 + i % 3) * min(3, math.exp(t.tilt * i / t._mean)) for i in range(1, 40_001)), total * 0.37, rel_tol=1e-8)
    made = copies_by_size(parts, tilts).collect()
    assert len({r["size"] for r in made}) == 40_000 == len(made) and all(0 <= r.copies <= 3 * (1 + r["size"] % 3) for r in made)
    assert abs(sum(r["size"] * r.copies for r in made) - total * 0.37) <= 100


def test_parts_change_no_target(docs, monkeypatch):
    monkeypatch.setattr(mixing, "PART_SIZES", 3)
    out = mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("k"), F.max("size").alias("most")).collect()
    assert all(abs(r.k - r.target) <= r.most / 2 for r in out)


def test_mix(docs, rows):
    out = mix(docs)
    got = out.select("doc_id", "size", "source_size", "target", "taken").collect()
    words = [(r[0], r[3], len((r[1] or "").encode().split())) for r in rows]
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, n) for i, _, n in words)
    sizes = defaultdict(int)
    for _, s, n in words:
        sizes[s] += n
    want = shared_out(sizes)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(sizes[s], round(want[s], 6)) for s in sizes}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size, r.target] += r.taken
    # a document is taken whole, so half of a source's largest one may be left over
    largest = {(sizes[s], want[s]): max(n for _, x, n in words if x == s) for s in sizes}
    assert all(abs(t - k[1]) <= largest[min(largest, key=lambda x: abs(x[0] - k[0]))] / 2 for k, t in taken.items())
    again = mix(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_hot_source_of_equal_sizes(spark, monkeypatch):
    """Copies of one size are split among tasks, and yet get the whole number of copies."""
    monkeypatch.setattr(mixing, "PART_ROWS", 50)
    rows = [(i, f"x{i} y z", "hot") for i in range(1000)] + [(5000 + i, "same text here", "a") for i in range(400)] + [(7, "x7 y z", "hot")] * 100
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = {r.source_size: (r.t, r.k, r.m) for r in out.groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("copies").alias("m")).collect()}
    assert all(abs(t - k) <= 3 and m <= 3 for t, k, m in sums.values())
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text


def test_mixed_documents(docs, rows, no_docs):
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    copies = Counter()
    for r in mix(docs).join(mixing._row_keys(docs).select("_h", "_c", "text").distinct(), ["_h", "_c"]).collect():
        copies[r.doc_id, r.text] += r.copies
    assert got == +copies
    assert mixed_documents(no_docs).count() == 0 and mix(no_docs).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(docs, rows, shards):
    out = kd_shards(docs, shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in out) == Counter(
        (r[0], len(d := (r[1] or "").encode()) + 1, zlib.crc32(d), "bytes", None) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_near_equal_bytes(spark, no_docs, monkeypatch):
    monkeypatch.setattr(kd_sharding, "PART_ROWS", 100)
    rows = [(i, "x" * (i * 37 % 400), "en", "hot" if i % 3 else f"s{i % 11}") for i in range(6000)] + [(9000 + i, "copied " * 40, "de", "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = kd_shards(df, 8)
    sums = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) <= 1.03 * sum(sums) / 8
    small = kd_shards(df.filter("doc_id < 6000").unionByName(df.filter("doc_id >= 9000").limit(5)), 8)
    assert small.filter(f"text_crc32 = {zlib.crc32(b'copied ' * 40)}").select("shard").distinct().count() == 1
    assert kd_shards(no_docs, 8).count() == 0
    with pytest.raises(ValueError):
        kd_shards(df, 0)


def test_rows_without_source_and_lang(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    assert kd_shards(df, 4).select("shard").distinct().count() == 4


def test_numbers(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id", "cast(id % 7 as int) as part")
    out = numbered(df, ["k"], ["id"], "part", "n").collect()
    for k in range(3):
        assert sorted(r.n for r in out if r.k == k) == list(range(sum(r.k == k for r in out)))
