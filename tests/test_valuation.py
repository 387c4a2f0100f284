"""The composed valuation series against a plain loop, and the spike rule on literal cases."""

import math
import random
from bisect import bisect_left, bisect_right
from datetime import date, timedelta

import pytest

from tidemark.operators import quarters as qt
from tidemark.operators import timeseries, valuation

RATIOS = valuation.RATIOS


def rounded(x):
    return math.floor(max(-1e6, min(1e6, x)) * 1e4 + 0.5) / 1e4


def loop(closes, ratios, latest):
    """One entity: [(day, close)], [(day, four ratios)], four ratios -> {day: (pe, forward, pb, peg)} before spikes go."""
    days, c = [d for d, _ in closes], [x for _, x in closes]
    anchors = {}
    for d, *row in [*sorted(ratios), (days[-1], *latest)]:
        if days[0] <= d <= days[-1]:
            at = anchors.setdefault(bisect_left(days, d), [None] * 4)
            for k, x in enumerate(row):
                if at[k] is None and x and math.isfinite(x):
                    at[k] = x

    def project(k, default=None):
        known = [(i, a[k]) for i, a in sorted(anchors.items()) if a[k] is not None]
        if not known and default:
            known = [(0, default)]
        out = [None] * len(c)
        for (i, left), (j, right) in zip(known, [*known[1:], (len(c), None)], strict=False):
            for n in range(i, j):
                if right is not None and left * right > 0:
                    out[n] = rounded(left * c[n] / c[i] * (right / left * c[i] / c[j]) ** ((n - i) / (j - i)))
                else:
                    out[n] = rounded(c[n] / (c[i] / left))
        return out

    pe, forward, pb = project(0, 20.0), project(1), project(2, 3.0)
    out, carried = {}, None
    for n, d in enumerate(days):
        carried = anchors.get(n, [None] * 4)[3] or carried
        if pe[n] is None or pb[n] is None:
            continue
        peg = carried
        year = date(d.year - 1, d.month, d.day) if (d.month, d.day) != (2, 29) else date(d.year - 1, 3, 1)
        m = bisect_right(days, year) - 1
        growths = [pe[n] / forward[n] - 1 if forward[n] else None, (c[n] / pe[n]) / (c[m] / pe[m]) - 1 if m >= 0 and pe[m] and pe[n] else None]
        for g in growths:
            if peg is None and g is not None and abs(g) > 1e-8:
                peg = rounded(pe[n] / (g * 100))
        out[d] = (pe[n], forward[n], pb[n], peg)
    return out


def test_valuation_series(spark):
    rng, series = random.Random(5), {}
    for e in ("both", "trailing", "bare", "late"):
        day, close, closes = date(2019, 1, 1), 100.0, []
        for _ in range(420):
            day += timedelta(rng.choice([1, 1, 1, 3]))
            close *= math.exp(rng.gauss(0, 0.02))
            closes.append((day, round(close, 2)))
        first = 25 if e == "late" else -10
        rows = [
            (date(2019, 1, 1) + timedelta(k), *[rng.uniform(5, 30) * (-1 if rng.random() < 0.2 else 1), rng.uniform(9, 12) if e == "both" and k > 200 else None, rng.choice([None, 0.0, 2.5]), 1.7 if k > 600 else None])
            for k in range(first, 1000, 45)
        ]
        if e == "late":
            rows = [(d, pe, f, 2.0, p) for d, pe, f, _, p in rows]
        # Two rows that move to the same close.
        gap = next(a + timedelta(1) for (a, _), (b, _) in zip(closes, closes[1:], strict=False) if (b - a).days == 3)
        rows += [(gap, None, None, 4.0, None), (gap + timedelta(1), 8.0, None, 5.0, None)]
        series[e] = (closes, [] if e == "bare" else rows, [None, 0.0, float("nan"), None] if e != "both" else [11.0, 10.0, None, 1.1])
    schema = "entity string, d date, " + ", ".join(f"{m} double" for m in RATIOS)
    closes = spark.createDataFrame([(e, d, c) for e, (p, _, _) in series.items() for d, c in p], "entity string, d date, close double")
    ratios = spark.createDataFrame([(e, *r) for e, (_, rows, _) in series.items() for r in rows], schema)
    latest = spark.createDataFrame([(e, *x) for e, (_, _, x) in series.items()], schema.replace(" d date,", ""))
    got = {}
    for r in valuation.valuation_series(closes, ratios, latest).collect():
        got.setdefault(r.entity, {})[r.d] = r
    for e, args in series.items():
        want = loop(*args)
        assert sorted(got[e]) == sorted(want)
        for d, (pe, forward, pb, peg) in want.items():
            r = got[e][d]
            assert (r.pe_ttm, r.pb) == pytest.approx((pe, pb), abs=2e-4)
            assert peg == pytest.approx(r.peg, rel=0.05, abs=2e-4) if peg is not None else r.peg is None
            assert r.pe_forward is None or r.pe_forward == pytest.approx(forward, abs=2e-4)
        assert {r.used_fallback for r in got[e].values()} == {e == "bare"}
    spikes = sum(r.pe_forward is None and loop(*series["both"])[d][1] is not None for d, r in got["both"].items())
    assert spikes <= 3 and all(r.forward_start is None and r.pe_forward is None for e in ("trailing", "bare") for r in got[e].values())
    assert min(got["late"]) > series["late"][0][0][0]


def test_spike_rule(spark):
    start = date(2024, 1, 1)
    cases = {
        "hard": ([(0, 10.0), (20, 20.0), (40, 10.5)], [10, None, 10.5]),
        "pulse": ([(0, 10.0), (3, 13.5), (6, 10.0)], [10, None, 10]),
        "slow pulse": ([(0, 10.0), (6, 13.5), (12, 10.0)], [10, 13.5, 10]),
        "wide gap": ([(0, 10.0), (41, 30.0), (50, 10.0)], [10, 30, 10]),
        "small": ([(0, 3.0), (1, 9.0), (2, 3.0)], [3, 9, 3]),
        "losses": ([(0, -10.0), (1, -30.0), (2, -10.0), (3, 0.0)], [-10, None, -10, None]),
        "two in a row": ([(0, 10.0), (1, 30.0), (2, 18.0), (3, 10.0), (4, 10.0)], [10, 30, 18, 10, 10]),
        "next to a dropped one": ([(0, 10.0), (1, 30.0), (2, 10.0), (3, 30.0), (4, 10.0)], [10, None, 10, None, 10]),
    }
    df = spark.createDataFrame([(e, start + timedelta(d), v) for e, (p, _) in cases.items() for d, v in p], "entity string, d date, v double")
    out = timeseries.drop_spikes(df, "entity", "d", "v").orderBy("d").collect()
    for e, (_, want) in cases.items():
        assert [r.v for r in out if r.entity == e] == want, e


def test_cutover_of_latest(spark):
    schema = "entity string, d date, " + ", ".join(f"{m} double" for m in RATIOS)
    day = date(2024, 1, 2)
    none = spark.createDataFrame([], schema)
    snapshots = spark.createDataFrame([("A", day, 9.0, None, 0.0, None)], schema)
    _, cuts = valuation.cutovers(none, none, snapshots)
    latest = spark.createDataFrame([("A", 1.0, 2.0, 3.0, 4.0), ("B", 1.0, 2.0, 3.0, 0.0)], schema.replace(" d date,", ""))
    out = {r.entity: tuple(r)[1:] for r in valuation.latest_at_cutover(latest, cuts).collect()}
    assert out == {"A": (None, 2.0, 3.0, 4.0), "B": (1.0, 2.0, 3.0, None)}
    base = spark.createDataFrame([("A", day, 5.0, 6.0, 7.0, None), ("A", day - timedelta(1), 4.0, None, None, None), ("B", day, 0.0, None, None, None)], schema)
    merged = {(r.entity, r.d): tuple(r)[2:] for r in valuation.merge_at_cutover(base, none, none, snapshots).collect()}
    assert merged == {("A", day): (9.0, 6.0, 7.0, None), ("A", day - timedelta(1)): (4.0, None, None, None)}


def test_basis_of_quarterly_earnings(spark):
    """Twenty-eight quarters of 1.0, so 4.0 a year; the points imply 4.0 times a factor."""
    first = date(2015, 3, 31)
    days = [first + timedelta(91 * k) for k in range(28)]
    cases = {
        "thirds": lambda k: 0.34,
        "plain": lambda k: 3.37 + 0 * k,
        "one": lambda k: 1.2,
        "wild": lambda k: 8.0 if k % 2 else 0.125,
        "late": lambda k: 1.0 if k < 12 else 4.0,
        "huge": lambda k: 30.0,
    }
    rows = [(e, d, 1.0, "actual", d + timedelta(3)) for e in cases for d in days] + [("few", d, 1.0, "actual", d) for d in days[:10]] + [("expected", d, 1.0, "expected", d) for d in days]
    points = [(e, d + timedelta(5), 40.0, 40.0 / (4.0 * f(k))) for e, f in cases.items() for k, d in enumerate(days)] + [(e, d, 40.0, 5.0) for e in ("few", "expected") for d in days]
    q = spark.createDataFrame(rows, "entity string, d date, eps double, kind string, available date")
    out = {}
    for r in qt.align_to_basis(q, spark.createDataFrame(points, "entity string, d date, close double, pe_ttm double")).orderBy("d").collect():
        out.setdefault(r.entity, []).append(r.eps)
    assert set(out["thirds"]) == {0.333333} and set(out["plain"]) == {3.0 if abs(3.37 / 3 - 1) <= 0.12 else 3.37}
    for e in ("one", "wild", "huge", "few", "expected"):
        assert set(out[e]) == {1.0}, e
    # The last sixteen sums begin with quarter 12; its own row lies three days before they were out.
    assert out["late"] == [1.0] * 13 + [4.0] * 15
