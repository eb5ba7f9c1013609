"""Learning signals against plain loops."""

import datetime as dt

import numpy as np
import pytest

from barloom.functions import recurrences as R
from barloom.operators import learn as L

DAY = dt.datetime(2023, 1, 1)


def bars(spark, n, low, high, seed=3):
    rnd = np.random.default_rng(seed)
    close = np.clip(np.cumsum(rnd.normal(0, (high - low) / 8, n)) * 0.3 + (low + high) / 2, low, high)
    wide = rnd.uniform(0.001, 0.2, (2, n)) * (high - low)
    rows = [("m", DAY + dt.timedelta(hours=i), float(c), float(c + a), float(c - b), float(c), float(v)) for i, (c, a, b, v) in enumerate(zip(close, *wide, rnd.uniform(1, 9, n)))]
    return spark.createDataFrame(rows, "market string, ts timestamp, open double, high double, low double, close double, volume double"), np.array([r[2:] for r in rows])


@pytest.mark.parametrize("options", [{}, {"volatility": False}, {"slope": -0.1, "adx": 12, "ema": 30, "sma": 20}])
def test_lorentzian_filters(spark, options):
    df, x = bars(spark, 260, 50, 150)
    high, low, close = x[:, 1], x[:, 2], x[:, 3]
    rows = L.lorentzian(L.lorentzian_features(df), ["f1", "f2", "f3", "f4", "f5"], back=80, warm=False).orderBy("ts").collect()
    raw = np.array([r.signal for r in rows])
    weight = (1 + np.arange(1, 9) ** 2 / 400.0) ** -8.0
    kernel = np.array([0.0 if i < 8 else (weight * close[i - 8 : i][::-1]).sum() / weight.sum() for i in range(260)])
    ok = np.concatenate([[False], kernel[1:] > kernel[:-1]]) & (np.arange(260) >= 80)
    if options.get("volatility", True):
        ok &= R.atr(high, low, close, 14) > R.atr(high, low, close, 28)
    if "slope" in options:
        ok &= np.concatenate([np.zeros(5, bool), close[5:] - close[:-5] > -0.1]) & (R.directional(high, low, close, 14)[2] >= 12) & (
            close > R.ema(close, 30)
        )
        ok &= np.array([i >= 19 and close[i] > close[i - 19 : i + 1].mean() for i in range(260)])
    want = np.where(ok, raw, 0)
    got = [r.signal for r in L.lorentzian_signal(df, back=80, **options).orderBy("ts").collect()]
    assert got == want.tolist() and raw[:80].any() and (raw != want).any()
    assert "slope" in options or want.any()


def plain_fit(x, y, iterations, rate):
    scaled = lambda a: a if np.isclose(a.max(), a.min()) else (a - a.min()) / (a.max() - a.min())
    x, y, w, loss = scaled(x), scaled(y), 0.0, 0.0
    for _ in range(iterations):
        h = 1 / (1 + np.exp(-w * x))
        p = np.clip(h, 1e-10, 1 - 1e-10)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        w -= rate * ((h - y) * x).mean()
    return loss, 1 / (1 + np.exp(-w * x[-1]))


@pytest.mark.parametrize("price,gated", [(True, False), (False, False), (True, True)])
def test_logistic_signal(spark, price, gated):
    df, x = bars(spark, 120, 0.4, 1.0, 5)
    high, low, close, volume = x[:, 1], x[:, 2], x[:, 3], x[:, 4]
    atr, tr, rsi = R.atr(high, low, close, 10), R.true_range(high, low, close), R.rsi(volume, 14)
    target, want, last, n = np.log(np.abs(close**2 - 1) + 0.5), [0, 0, 0], 0, 3
    for i in range(3, 120):
        loss, pred = plain_fit(close[i - 3 : i], target[i - 3 : i], 50, 0.05)
        value = close[i] if price else pred
        new = -1 if value < loss else 1 if value > loss else last
        if gated and i >= 10 and (tr[i] <= atr[i] or rsi[i] <= 49):
            new = 0
        n = n + 1 if new == last else 0
        if n >= 5 and new:
            new, n = 0, 0
        last = new
        want.append(new)
    got = [
        r.signal
        for r in L.logistic_signal(df, rate=0.05, iterations=50, price=price, volatility=gated, volume=gated).orderBy("ts").collect()
    ]
    assert got == want and len(set(want)) > 1
