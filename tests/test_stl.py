"""The decomposition against a plain one, written point by point, and what outliers and gaps do."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from plumeline.operators import stl

START = dt.datetime(2024, 1, 1)


def plain_loess(y, w, q, x):
    n = len(y)
    near = sorted(range(n), key=lambda i: (abs(i - x), i))[: min(q, n)]
    h = max(abs(i - x) for i in near) + max(0, (q - n) // 2)
    weights = {}
    for i in near:
        r = abs(i - x)
        weights[i] = (1.0 if r <= 0.001 * h else 0.0 if r > 0.999 * h else (1 - (r / h) ** 3) ** 3) * w[i]
    total = sum(weights.values())
    weights = {i: v / total for i, v in weights.items()}
    a = sum(v * i for i, v in weights.items())
    c = sum(v * (i - a) ** 2 for i, v in weights.items())
    if math.sqrt(c) > 0.001 * (n - 1):
        weights = {i: v * (1 + (x - a) / c * (i - a)) for i, v in weights.items()}
    return sum(v * y[i] for i, v in weights.items())


def plain_stl(y, period, seasonal, trend, low, inner, outer):
    n = len(y)
    t, s, rob = [0.0] * n, [0.0] * n, [1.0] * n
    mean = lambda z, k: [sum(z[i : i + k]) / k for i in range(len(z) - k + 1)]
    for turn in range(outer + 1):
        for _ in range(inner):
            c = [0.0] * (n + 2 * period)
            for p in range(period):
                own = [y[i] - t[i] for i in range(p, n, period)]
                for k in range(-1, len(own) + 1):
                    c[p + (k + 1) * period] = plain_loess(own, rob[p::period], seasonal, k)
            low_pass = mean(mean(mean(c, period), period), 3)
            low_pass = [plain_loess(low_pass, [1.0] * n, low, i) for i in range(n)]
            s = [c[period + i] - low_pass[i] for i in range(n)]
            t = [plain_loess([a - b for a, b in zip(y, s)], rob, trend, i) for i in range(n)]
        if turn < outer:
            away = [abs(a - b - c_) for a, b, c_ in zip(y, t, s)]
            h = 6 * float(np.median(away))
            rob = [1.0 if u <= 0.001 * h else 0.0 if u > 0.999 * h else (1 - (u / h) ** 2) ** 2 for u in away]
    return t, s, rob


@pytest.mark.parametrize("n,period,seasonal,trend", [(150, 12, 7, 23), (75, 7, 9, 15), (130, 10, 9, 31)])
def test_equals_the_plain_version(n, period, seasonal, trend):
    rng = random.Random(n)
    y = [0.05 * i + 3 * math.sin(2 * math.pi * i / period) + rng.gauss(0, 0.3) for i in range(n)]
    y[n // 2] += 4
    want = plain_stl(y, period, seasonal, trend, stl.odd(period), 2, 3)
    got = stl.decompose(np.array(y), np.ones(n, bool), period, seasonal, trend, stl.odd(period), 2, 3)
    for a, b in zip(got, want):
        assert a == pytest.approx(np.array(b), abs=1e-8)
    assert got[2][n // 2] < 0.5


def series(n=24 * 14, outlier=None, gaps=(), metric="pm25"):
    rng = random.Random(1)
    rows = []
    for h in range(n):
        noise = rng.gauss(0, 0.2)
        if h not in gaps:
            rows.append((START + dt.timedelta(hours=h, minutes=7), metric, 20 + 0.02 * h + 5 * math.sin(2 * math.pi * h / 24) + noise + (200.0 if h == outlier else 0.0)))
    return rows


def run(spark, rows, **more):
    return {(r.metric, r.hour): r for r in stl.robust_residuals(spark.createDataFrame(rows, "timestamp timestamp, metric string, value double"), **more).collect()}


def test_an_outlier_moves_nothing_but_itself(spark):
    at = ("pm25", START + dt.timedelta(hours=150))
    clean, hit, weak = run(spark, series()), run(spark, series(outlier=150)), run(spark, series(outlier=150), outer=0)
    moved = lambda other: max(abs(other[k].season - r.season) for k, r in clean.items())
    assert moved(hit) < 1.5 < 50 < moved(weak)
    assert hit[at].flagged and hit[at].weight == 0 and hit[at].residual == pytest.approx(200, abs=2)
    assert sum(r.flagged for r in hit.values()) < 30
    assert all(r.value == pytest.approx(r.trend + r.season + r.residual) for r in hit.values())


def test_gaps_count_for_nothing(spark):
    gaps = set(range(60, 100)) | {5, 200}
    whole, some = run(spark, series()), run(spark, series(gaps=gaps))
    assert len(some) == len(whole) - len(gaps)
    assert max(abs(whole[k].season - r.season) for k, r in some.items()) < 0.6


def test_short_empty_and_null(spark):
    assert len(run(spark, series(n=5) + series(n=60, metric="no2") + [(None, "pm25", 1.0), (START, "pm25", None), (START, None, 3.0)])) == 66
    assert run(spark, [(START, "pm25", 4.0)])[("pm25", START)].residual == pytest.approx(0)
    assert run(spark, []) == {}
    assert len({r.flagged for r in run(spark, [(START + dt.timedelta(hours=h), "pm25", 4.0) for h in range(80)]).values()}) == 1
