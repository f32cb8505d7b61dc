"""Lexical search, divergence of sources and sharding, against plain versions on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import divergence, joins, lexical, sharding

DOCS = "doc_id long, text string, lang string, source string, score string, item string, shard string"
ITEMS = "item_id long, text string, rank string"


def odd_documents(seed: int, rows: int) -> list[tuple]:
    """Rows with nulls in every column, ties, copies, repeated rows, a hot source and a long text; the last columns clash with results."""
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "ñandú", "Äpfel", "x1", "1x", "İs", "é", "\U0001f600", "foo_bar", "a-b"] + [f"w{i}" for i in range(40)]
    weights = [30, 20, 20] + [3] * (len(vocabulary) - 3)
    docs = []
    for n in range(rows):
        text = rng.choice([None, "", " .,\x00\t"]) if rng.random() < 0.08 else " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 2, 5, 20, 60])))
        docs.append((rng.choice([None, n, n, n, n]), text, rng.choice([None, "en", "en", "fr"]), rng.choice([None, "s0", "s0", "s0", "s1", "s2", "alone"]), "9", None, "7"))
    docs += docs[:7] * 3 + [(rows, "the w1 " * 30_000, "en", "s1", None, None, None), (rows + 1, "only", "xx", "single", None, None, None)]
    return docs


def plain_words(text: str | None, digits: bool) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) >= 128 or "a" <= c <= "z" or digits and "0" <= c <= "9" else " " for c in lowered).split(" ")


def plain_search(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    counts = [Counter(w for w in plain_words(d[1], True) if w) for d in docs]
    lengths = [sum(c.values()) for c in counts]
    total, documents = sum(lengths), sum(n > 0 for n in lengths)
    df = Counter(t for c in counts for t in c)
    terms: dict = defaultdict(set)
    for item, text, *_ in items:
        terms[item] |= {w for w in plain_words(text, True) if w}
    found = []
    for item, own in terms.items():
        scores = []
        for doc, c, n in zip(docs, counts, lengths, strict=True):
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * documents // total))) for t in own if t in c)
            if score > 0:
                scores.append((-score, doc[0] is None, doc[0] or 0))
        found += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return found


@pytest.mark.parametrize(("seed", "item_bytes", "documents"), [(1, 4 << 20, 32_768), (2, 40, 16), (3, 4 << 20, 64)])
def test_search_is_exact(spark, monkeypatch, seed, item_bytes, documents):
    docs = odd_documents(seed, 240)
    items = [(1, "the of W1 w2 w3 ñandú", None), (2, None, "1"), (3, "", None), (4, "w4 w4 Äpfel THE nowhere", None), (None, "w5 x1", None), (6, "the", None), (6, "w7, w8", None), (7, "\U0001f600 é", None), (1, "the of W1 w2 w3 ñandú", None)]
    monkeypatch.setattr(lexical, "DOCUMENTS", documents)
    got = lexical.ranked(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), 7, item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_search(docs, items, 7), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_skipping_drops_no_answer(seed):
    rng = np.random.default_rng(seed)
    size, k = 3_000, 5
    lists = []
    for n in (0, 3, 40, 200, 900, 2_500, 3_000):
        lists.append((np.sort(rng.choice(size, n, replace=False)), rng.integers(0, 50 if n > 500 else 2_000, n)))
    ids, null = rng.permutation(size) // 2, rng.random(size) < 0.01
    best = lexical.Best(k)
    lexical.search(lists, size, ids, null, best, step=128)
    sums = np.zeros(size, np.int64)
    for places, scores in lists:
        sums[places] += scores
    order = np.lexsort((ids, null, -sums))[:k]
    assert best.scores.tolist() == sums[order].tolist()
    assert best.ids.tolist() == ids[order].tolist()


def test_search_of_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.ranked(no_docs, spark.createDataFrame([(1, "a", None)], ITEMS)).count() == 0
    assert lexical.ranked(spark.createDataFrame(odd_documents(1, 5), DOCS), no_items).count() == 0


def plain_divergence(docs: list[tuple], documents: int, ranks: int) -> list[tuple]:
    docs = [tuple(x or "" for x in (d[2], d[3], d[1])) for d in docs]
    found = []
    for lang in {d[0] for d in docs}:
        counts: dict = defaultdict(Counter)
        df: Counter = Counter()
        for own, source, text in docs:
            if own == lang:
                c = Counter(w for w in plain_words(text, False) if w)
                counts[source].update(c)
                df.update(c.keys())
        kept = [t for t, n in df.items() if n >= documents]
        whole = sum((c for c in counts.values()), Counter())
        share = {s: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} for s, c in [*counts.items(), (None, whole)]}
        distance = lambda p, q: (p - q) ** 2 // q
        for s, c in counts.items():
            pairs = [(-sum(distance(share[s][t], share[r][t]) for t in kept), r) for r in counts if r != s]
            terms = [(-distance(share[s][t], share[None][t]), t) for t in kept if c[t] and share[s][t] > share[None][t]]
            order = lambda x: (x[0], x[1].encode())
            found += [(lang, s, "pair", item, -v, n) for n, (v, item) in enumerate(sorted(pairs, key=order), 1)]
            found += [(lang, s, "term", item, -v, n) for n, (v, item) in enumerate(sorted(terms, key=order)[:ranks], 1)]
    return found


@pytest.mark.parametrize(("seed", "block", "held", "cells", "small"), [(1, 256, 300_000, 64, 100_000), (2, 2, 10, 1, 0), (3, 1, 50, 2, 100_000)])
def test_divergence_is_exact(spark, monkeypatch, seed, block, held, cells, small):
    docs = odd_documents(seed, 200)
    for name, value in (("BLOCK", block), ("HELD", held), ("CELLS", cells)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", small)
    got = divergence.divergence(spark.createDataFrame(docs, DOCS).repartition(3), 3, 9)
    assert sorted(map(tuple, got.collect())) == sorted(plain_divergence(docs, 3, 9))


def test_divergence_without_terms(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
    docs = [(1, None, "en", "a", None, None, None), (2, "rare", "en", "b", None, None, None)]
    got = divergence.divergence(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def plain_home(key: str, weights: list[float]) -> int:
    def draw(shard: int) -> float:
        return -math.log((int(hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weights[shard]

    return min(range(len(weights)), key=lambda s: (draw(s), s))


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 2.0, 0.5], [1.0]])
def test_shards(spark, weights):
    docs = odd_documents(4, 300) + [(5, "copy", None, None, None, None, None)] * 50
    got = sharding.manifest(spark.createDataFrame(docs, DOCS).repartition(3), weights, 1.5).collect()
    raw = [(d[0], (d[1] or "").encode()) for d in docs]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in raw)
    slots = defaultdict(list)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.law == "key"
        assert r.shard == plain_home(key, weights)
        assert r.grown_shard == plain_home(key, [*weights, 1.5])
        assert r.grown_shard in (r.shard, len(weights))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights_and_dealing_does_not_matter(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text", "1 as size", "2 as slot")
    got = sharding.manifest(docs, [1.0, 2.0, 1.0])
    sizes = {r.shard: r["count"] for r in got.groupBy("shard").count().collect()}
    assert all(abs(sizes[s] - 5_000 * w) < 300 for s, w in enumerate([1, 2, 1]))
    moved = got.where("grown_shard <> shard").count()
    assert abs(moved - 4_000) < 300
    again = sharding.manifest(docs.repartition(5), [1.0, 2.0, 1.0])
    assert got.exceptAll(again).count() == 0
    with pytest.raises(ValueError, match="weight"):
        sharding.manifest(docs, [1.0, 0.0])


def test_equal_rows_beyond_a_run_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    docs = spark.range(100).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    got = sharding.manifest(docs).collect()
    assert sorted(r.slot for r in got) == list(range(100))
    assert {(r.size, r.text_crc32) for r in got} == {(8, 0)}
    assert sharding.manifest(docs.where("false")).count() == 0


def test_ranges_stay_bounded():
    assert [sharding.ranges_of(n) for n in (1, 24, 32, 33, 512, 513, 8_192, 8_193, 200_000)] == [3, 3, 3, 2, 2, 1, 1, 0, 0]
