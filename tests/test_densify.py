"""Gaps filled like recent daily returns, against a loop written from the reference."""

import math
from datetime import date, timedelta

import pytest

from tidemark.operators import timeseries


def filled(points):
    clamp = lambda x, a: max(-a, min(a, x))
    returns = [b / a - 1 for (d, a), (e, b) in zip(points, points[1:], strict=False) if (e - d).days <= 4 and a > 0 and b > 0 and -0.95 < b / a - 1 < 2.5]
    template, out, k = returns[-252:], {}, 0
    for (d, a), (e, b) in zip(points, points[1:], strict=False):
        days = [x for x in (d + timedelta(i) for i in range(1, (e - d).days)) if x.weekday() < 5]
        if not template or (e - d).days <= 4 or not days:
            continue
        seed, k, n, now = k * 17 % len(template), k + 1, len(days) + 1, a
        logs = [math.log1p(clamp(template[(seed + i) % len(template)], 0.35)) for i in range(n)]
        target = math.log(max(b / a, 1e-9))
        drift = (target - sum(logs)) / n
        for i, x in enumerate(days):
            now *= math.exp(clamp(logs[i] + drift, 1.5) if abs(drift) < 1.6 else target / n)
            out[x] = max(now, 1e-8)
    return out


def test_gaps_move_like_recent_returns(spark):
    start = date(2024, 1, 1)
    series = {
        "A": [(start + timedelta(d), v) for d, v in [(0, 10.0), (1, 11.0), (2, 10.5), (3, 20.0), (14, 12.0), (15, 12.6), (24, 13.0), (40, 9.0), (41, 9.9)]],
        "none": [(start, 1.0), (start + timedelta(9), 2.0)],
        "steep": [(start, 1.0), (start + timedelta(1), 1.1), (start + timedelta(7), 1e9), (start + timedelta(8), 1e9)],
        "long": [(start + timedelta(d), 50 + 9 * math.sin(d * d)) for d in range(300)] + [(start + timedelta(330), 70.0), (start + timedelta(360), 40.0)],
    }
    df = spark.createDataFrame([(e, d, v) for e, p in series.items() for d, v in p], "entity string, d date, v double")
    out = timeseries.fill_like_recent(df, "entity", "d", "v").collect()
    for e, points in series.items():
        assert {r.d: r.v for r in out if r.entity == e and r.filled} == pytest.approx(filled(points))
        assert sorted((r.d, r.v) for r in out if r.entity == e and not r.filled) == points
    assert not filled(series["none"]) and len(filled(series["A"])) > 20
