"""Measures of sliding weeks against a plain loop."""

import random
from datetime import datetime, timedelta

import numpy as np

from tidemark.operators import forecast as P

TRADES = "id long, item_code string, transaction_type string, created_at timestamp, unit_price double, quantity double"
BOOKS = "item_code string, observed_at timestamp, best_bid double, best_ask double, spread_pct double, imbalance_pct double"
START, WEEK = datetime(2024, 3, 1), timedelta(days=7)


def by_hand(trades, item, t):
    seen = sorted((at, i, p, q) for i, code, kind, at, p, q in trades if code == item and kind == "trading" and p is not None and t - WEEK <= at <= t)
    if not seen:
        return (0, *[None] * 9)
    p = np.array([x[2] for x in seen])
    sold = [(x[2], x[3]) for x in seen if x[3] is not None and x[3] > 0]
    total = sum(q for _, q in sold)
    vwap = sum(a * b for a, b in sold) / total if total else None
    return (len(p), sum(x[3] or 0 for x in seen), p[0], p[-1], vwap, *np.percentile(p, [10, 25, 50, 90]), p[-5:].mean())


def test_features_equal_a_plain_loop(spark):
    draw = random.Random(5)
    trades = []
    for i in range(600):
        # Few prices and few times, so that both tie; a hot item; gaps of more than a week; null quantities and prices.
        item = draw.choice(["hot", "hot", "hot", "cold"])
        at = START + timedelta(hours=draw.choice([draw.randrange(24 * 9), draw.randrange(24 * 60), 240]))
        trades.append((i, item, draw.choice(["trading"] * 9 + ["itemMarket"]), at, draw.choice([None, *[float(x) for x in range(1, 15)]]), draw.choice([None, 0.0, 1.0, 2.5])))
    # Snapshots at trades' own times, exactly a week after them, and where nothing has been traded.
    times = {t[3] + d for t in trades[::12] for d in (timedelta(0), WEEK, WEEK + timedelta(microseconds=1))} | {START - WEEK, START + timedelta(days=200)}
    books = [(item, t, 2.0, 3.0, 1.0, 0.0) for item in ("hot", "cold", "never") for t in times]
    for cells, days in ((64, 7), (3, 1)):
        got = P.features(spark.createDataFrame(trades, TRADES), spark.createDataFrame(books, BOOKS), days, cells).collect()
        assert len(got) == len(books)
        for r in got:
            want = by_hand(trades, r.item_code, r.observed_at)
            have = [r[c] for c in ("trades", "volume", "open", "close", "vwap", "p10", "p25", "median", "p90", "last5")]
            assert [x is None for x in have] == [x is None for x in want], (r, want)
            assert all(x is None or abs(x - y) < 1e-9 for x, y in zip(have, want, strict=True)), (r, want)


def test_features_stay_in_the_jvm(spark):
    seen = P.features(spark.createDataFrame([], TRADES), spark.createDataFrame([], BOOKS))
    assert seen.count() == 0
    assert "Python" not in seen._jdf.queryExecution().executedPlan().toString()
