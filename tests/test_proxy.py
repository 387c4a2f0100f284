"""The three made-up ratios against a plain loop over each series."""

import datetime as dt
import math
import random

from tidemark.operators import proxy


def loop(closes, rates, pe, fw, pb, alpha_pe=0.11):
    """closes and rates as lists of (date, value)."""
    clip = lambda x, low, high: max(low, min(high, x))
    rates = sorted(rates)
    now = rates[0][1] if rates else 0.035
    e63 = e252 = e756 = closes[0][1] or 1
    fast = slow = now
    up = down = 0.0
    a, b, c = pe, fw, pb
    rows, k = [], 0
    for i, (d, x) in enumerate(closes):
        while k < len(rates) and rates[k][0] <= d:
            now, k = rates[k][1], k + 1
        x, old = max(x, 0.01), max(closes[max(i - 1, 0)][1], 0.01)
        r = x / old - 1
        e63 += 2 / 64 * (x - e63)
        e252 += 2 / 253 * (x - e252)
        e756 += 2 / 757 * (x - e756)
        fast += 2 / 64 * (now - fast)
        slow += 2 / 757 * (now - slow)
        up += 2 / 64 * (abs(r) - up)
        down += 2 / 253 * (abs(r) - down)
        s, lo, us = math.log(x / max(e252, 0.01)), math.log(max(e252, 0.01) / max(e756, 0.01)), math.log(x / max(e63, 0.01))
        g, m, v = now - slow, now - fast, up - down
        signal = clip(us * 1.25 + s * 0.72 + lo * 0.46 - g * 4.8 - m * 1.4 - v * 6.2, -0.92, 0.92)
        book = clip(signal * 0.62 + lo * 0.28 - g * 1.8 - v * 2.2, -0.9, 0.9)
        spread = clip(0.085 + lo * 0.22 + s * 0.12 - g * 0.42 - m * 0.2, -0.08, 0.24)
        t = pe * math.exp(signal)
        a = clip(a * (1 + clip(r * 1.2, -0.1, 0.1)), 0.1, 500)
        b = clip(b * (1 + clip(r * 1.05, -0.09, 0.09)), 0.1, 500)
        c = clip(c * (1 + clip(r * 0.9, -0.08, 0.08)), 0.05, 120)
        a += alpha_pe * (t - a)
        b += 0.13 * (t * (1 - spread) - b)
        c += 0.08 * (pb * math.exp(book) - c)
        rows.append((d, a, b, c, clip(now, 0.001, 0.12)))
    near = lambda x, n: math.floor(x * 10**n + 0.5) / 10**n
    ka, kb, kc = pe / max(a, 0.0001), fw / max(b, 0.0001), pb / max(c, 0.0001)
    return {d: (near(clip(x * ka, 2.4, 240), 4), near(clip(y * kb, 2, 120), 4), near(clip(z * kc, 0.2, 28), 4), near(q, 5)) for d, x, y, z, q in rows}


def test_every_series(spark):
    rng = random.Random(4)
    start = dt.date(2010, 1, 1)
    series = {}
    for e, n in (("long", 1500), ("short", 3), ("one", 1), ("wild", 800), ("zero", 40)):
        x, rows = 100.0, []
        for i in range(n):
            x = max(0.0 if e == "zero" else 0.001, x * (1 + rng.gauss(0, 0.3 if e == "wild" else 0.01)))
            rows.append((start + dt.timedelta(days=i + 5 * (e == "short")), 0.0 if e == "zero" and i < 3 else x))
        series[e] = rows
    rates = [(start + dt.timedelta(days=40 * k + 20), 0.02 + 0.03 * rng.random()) for k in range(40)]
    anchors = {e: (20.0 + i, 18.0 + i, 2.0 + i, 0.3 if e == "wild" else None) for i, e in enumerate(series)}
    closes = spark.createDataFrame([(e, d, x, *anchors[e][:3], anchors[e][3]) for e, rows in series.items() for d, x in rows], "entity string, d date, close double, anchor_pe_ttm double, anchor_pe_forward double, anchor_pb double, alpha_pe_ttm double")
    for given in (rates, []):
        df = proxy.rate_on(closes, spark.createDataFrame(given, "d date, rate double"))
        got = {(r.entity, r.d): (r.pe_ttm, r.pe_forward, r.pb, r.us10y_yield) for r in proxy.proxy_ratios(df).collect()}
        for e, rows in series.items():
            want = loop(rows, given, *anchors[e][:3], anchors[e][3] or 0.11)
            assert {d: got[e, d] for d, _ in rows} == want, e
    assert proxy.proxy_ratios(df.limit(0)).collect() == []
