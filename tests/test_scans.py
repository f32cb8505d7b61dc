"""Islands and holders of one key spread over parts, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage as V
from tidemark.operators import resolve as R


def islands(intervals: list[tuple]) -> list[tuple]:
    found = []
    for key, start, end in sorted(intervals, key=lambda i: (str(i[0]), i[1], i[2])):
        if found and found[-1][0] == key and start <= found[-1][2]:
            found[-1][2] = max(found[-1][2], end)
        else:
            found.append([key, start, end])
    return sorted(map(tuple, found), key=str)


@pytest.mark.parametrize(("seed", "span"), [(1, 1), (2, 10), (3, 1_000), (4, 7)])
def test_islands_equal_a_loop(spark, seed, span):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "b", None]), s, s + rng.choice([0, 1, 2, 5, 90])) for s in (rng.randrange(0, 3_000) for _ in range(300))]
    got = V.merged(spark.createDataFrame(rows, "k string, start long, end long"), ["k"], span=span)
    assert sorted(map(tuple, got.collect()), key=str) == islands(rows)


def test_one_stream_of_many_intervals_is_spread(spark):
    rows = spark.range(200_000).selectExpr("'s' as stream", "timestamp_seconds(id * 60) as start", "timestamp_seconds(id * 60 + if(id % 3 = 0, 30, 60)) as end")
    got = V.merged(rows, ["stream"])
    assert got.count() == 66_668
    assert got.agg(F.sum(F.unix_timestamp("end") - F.unix_timestamp("start"))).first()[0] == 200_000 * 60 - 66_667 * 30


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_in_known_coverage(spark, seed):
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(20_000), 40))
    known = [("s", a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    edges = sorted(rng.sample(range(20_000), 60), reverse=True)
    pages = [(f"s{n}", 0, newest, oldest, True) for n, (newest, oldest) in enumerate(zip(edges, edges[1:], strict=False))]
    many = [(f"s{n}", a, b) for n in range(len(pages)) for _, a, b in known]
    ts = lambda c: F.timestamp_seconds(F.col(c) * 600).alias(c)
    p = spark.createDataFrame(pages, "stream string, page int, newest long, oldest long, has_next boolean").select("stream", "page", ts("newest"), ts("oldest"), "has_next")
    k = spark.createDataFrame(many, "stream string, start long, end long").select("stream", ts("start"), ts("end"))
    got = {r.stream for r in R.scan_coverage(p, k, F.timestamp_seconds(F.lit(-1)), 99).where("completion_reason = 'normalized-overlap'").collect()}
    assert got == {s for s, _, newest, oldest, _ in pages if any(a <= oldest and newest < b for _, a, b in known)}
