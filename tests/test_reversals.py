import numpy as np
import pytest

from tidemark.functions.series import CODE, lay_out
from tidemark.operators import forecasts
from tidemark.operators import reversals as rev
from tidemark.params import TrendParams


def brute(values, distance):
    """Strict extremes with plateaus at their middle, then the highest first."""
    out = []
    for kind, sign in (("peak", 1), ("trough", -1)):
        v, found, i = [sign * x for x in values], [], 1
        while i < len(v) - 1:
            j = i
            while j < len(v) - 1 and v[j + 1] == v[i]:
                j += 1
            if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i]:
                found.append((i + j) // 2)
            i = j + 1
        kept = []
        for i in sorted(found, key=lambda i: (v[i], i), reverse=True):
            if all(abs(i - k) >= distance for k in kept):
                kept.append(i)
        out += [(kind, i) for i in kept]
    return sorted(out)


def averages(closes, window):
    return [sum(closes[i - window + 1:i + 1]) / window for i in range(window - 1, len(closes))]


@pytest.mark.parametrize("window,seed", [(5, 1), (25, 2), (25, 3), (13, 4)])
def test_equals_brute_force(price_table, window, seed):
    rng = np.random.default_rng(seed)
    p = TrendParams(short_window=3, long_window=window)
    made = {f"{i:05d}": (100 + rng.integers(-3, 4, 400).cumsum() * float(window)).tolist()
            for i in range(6)}
    got = rev.reversals(price_table(**made), "long", p).collect()
    for code, closes in made.items():
        mine = sorted((r.type, r.idx - window + 1) for r in got if r[CODE] == code)
        assert mine == brute(averages(closes, window), window // 2), code


def test_long_rising_chain(price_table):
    """Every extreme is beaten by the next: no stretch may be cut wrongly."""
    p = TrendParams(short_window=2, long_window=24)
    closes = [1000 + i * 0.5 + (40.0 if i % 4 == 0 else 0.0) * (1 + i / 50) for i in range(300)]
    got = rev.reversals(price_table(_00001=closes), "long", p).collect()
    assert sorted((r.type, r.idx - 23) for r in got) == brute(averages(closes, 24), 12)


def test_plateau_and_ends(price_table):
    p = TrendParams(short_window=1, long_window=2)
    closes = [5, 1, 2, 3, 3, 1, 2, 4, 4, 4, 1, 9]
    got = rev.reversals(price_table(_00001=closes), "short", p).orderBy("idx").collect()
    assert [(r.type, r.idx) for r in got] == [
        ("trough", 1), ("peak", 3), ("trough", 5), ("peak", 8), ("trough", 10)]
    assert [r.actual_price for r in got] == [1, 3, 1, 4, 1]


def test_monotone_and_short_series_have_none(price_table):
    df = price_table(_00001=list(range(1, 81)), _00002=[100.0] * 80, _00003=[1, 5, 2, 6, 3, 7, 2, 8, 1])
    assert rev.all_reversals(df).count() == 0


def test_peaks_and_troughs_alternate(price_table):
    closes = [100 + 10 * np.sin(i * np.pi / 10) for i in range(120)]
    got = rev.reversals(price_table(_00001=closes), "short").orderBy("idx").collect()
    kinds = [r.type for r in got]
    assert len(kinds) >= 10 and all(a != b for a, b in zip(kinds, kinds[1:]))


def test_statistics_of_reversals(price_table):
    closes = [100 + 10 * np.sin(i * np.pi / 10) + i * 0.01 for i in range(200)]
    found = rev.reversals(price_table(_00001=closes), "short")
    rows = found.orderBy("idx").collect()
    s = rev.reversal_stats(found).first()
    steps = [abs(b.price - a.price) for a, b in zip(rows, rows[1:])]
    gaps = [(b.date - a.date).days for a, b in zip(rows, rows[1:])]
    assert s.reversal_count == len(rows) and s.last_price == rows[-1].price
    assert s.avg_magnitude == pytest.approx(np.mean(steps[-4:]))
    assert (s.gap_mean, s.gap_std) == pytest.approx((np.mean(gaps), np.std(gaps)))
    assert [r.idx for r in s.recent] == [r.idx for r in rows[-3:]]


@pytest.mark.parametrize("kind", ["short", "long"])
def test_sliced_series_have_the_same(monkeypatch, price_table, kind):
    """Short slabs, plateaus across their borders and a code without a single turn."""
    monkeypatch.setattr(rev, "SPAN", 200)
    rng = np.random.default_rng(9)
    closes = (100 + rng.integers(-2, 3, 2600).cumsum() * 25.0)
    closes[1000:1300] = closes[1000]
    table = price_table(_00001=closes.tolist(), _00002=closes[::-1][:1500].tolist(),
                        _00003=list(range(1, 1201)))
    cut = lay_out(table, 1100)
    show = lambda df: sorted(map(tuple, df.drop("slab").collect()))
    assert show(rev.reversals(cut, kind)) == show(rev.reversals(table, kind))
    near = lambda df: [tuple(r) for r in df.orderBy(CODE).collect()]
    a, b = (near(rev.reversal_stats(rev.reversals(x, kind))) for x in (cut, table))
    assert len(a) == 2 and [x[2] for x in a] == [x[2] for x in b]
    for x, y in zip(a, b):
        assert x[3:7] == pytest.approx(y[3:7]) and x[7] == y[7]


def test_forecasts_of_sliced_series(price_table):
    rng = np.random.default_rng(10)
    made = {f"_{i:05d}": (500 + rng.normal(0, 3, n).cumsum()).round(2).tolist()
            for i, n in enumerate((30, 1099, 1100, 1101, 2500))}
    table = price_table(**made)
    cut = lay_out(table, 1100)
    for method in ("basic", "analyzer"):
        a, b = (forecasts.predict_stock(x, method=method).orderBy(CODE).collect() for x in (cut, table))
        assert [r.data_quality for r in a] == [r.data_quality for r in b]
        for c in ("short_reversal_price", "long_reversal_price", "short_confidence", "long_confidence"):
            assert [r[c] for r in a] == pytest.approx([r[c] for r in b])
        assert [(r.short_trend, r.long_trend) for r in a] == [(r.short_trend, r.long_trend) for r in b]


def greedy(rows, distance):
    """Highest first, the later one first among equals; rows are (pos, height)."""
    taken, kept = set(), []
    for pos, _ in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
        if not any(x in taken for x in range(pos - distance + 1, pos + distance)):
            taken.add(pos)
            kept.append(pos)
    return sorted(kept)


def heights(n, seed=None):
    """A rising chain, or steps up and down with many equal heights."""
    rng = np.random.default_rng(seed)
    pos = np.cumsum(rng.integers(2, 6, n))
    h = np.arange(n, dtype=float) if seed is None else rng.integers(-2, 4, n).cumsum().astype(float)
    return [(int(p), float(x)) for p, x in zip(pos, h)]


def test_chains_over_many_slabs(spark, monkeypatch):
    """What hangs on its neighbour all along a series is decided a slab at a time."""
    monkeypatch.setattr(rev, "SPAN", 2048)
    series = {"00001": heights(6000), "00002": heights(3000, 1), "00003": heights(3000, 2), "00004": heights(1)}

    rows = [(code, "peak" if x else "trough", None, p, h if x else -h, 1.0, p // 2048) for code, of in series.items() for p, h in of for x in (True, False)]
    found = spark.createDataFrame(rows, "stock_code string, type string, date date, pos long, v double, close double, slab long")
    out = rev.keep_apart(found, 12)
    assert out.columns == found.columns
    got = out.collect()
    for code, of in series.items():
        for kind in ("peak", "trough"):
            assert sorted(r.pos for r in got if r[CODE] == code and r.type == kind) == greedy(of, 12), (code, kind)


def test_a_slab_sees_no_more_than_its_borders():
    """Rows of other slabs stay open, so a slab never says more than it knows."""
    import pyarrow as pa
    rows = [(5, 1.0, True, False), (12, 2.0, True, False), (20, 3.0, False, False), (40, 1.0, True, False), (47, 9.0, False, True)]
    table = pa.table({"pos": [r[0] for r in rows], "h": [r[1] for r in rows], "own": [r[2] for r in rows], "kept": [r[3] for r in rows]})
    out = rev._decide(10)(table).to_pydict()
    # 12 hangs on 20, and 5 on 12; 40 is near a kept one
    assert list(zip(out["pos"], out["state"])) == [(5, rev.OPEN), (12, rev.OPEN)]


def test_slabs_are_laid_out_once_for_the_analyzer(spark, price_table):
    """The profile and both kinds of reversals read the slabs from one stored table, in buckets by slab."""
    rng = np.random.default_rng(11)
    table = price_table(_00001=(500 + rng.normal(0, 3, 2500).cumsum()).round(2).tolist())
    made = forecasts.predict_stock(lay_out(table, 1100, rows=2500), method="analyzer", ensembles=False)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan and "/slabs-" in plan and "/extremes-" in plan
    kept = forecasts.kept_slabs(lay_out(table, 1100, rows=2500))
    assert kept.schema["slab"].metadata["behind"] == 1024
    assert "Exchange hashpartitioning" not in kept.groupBy(CODE, "slab").count()._jdf.queryExecution().executedPlan().toString()
