"""The joins and the search against brute force, with every odd row."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import components, jaccard, neardup_vectors, topk


def union(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    want = union(edges, {x for e in edges for x in e})
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got or want[k] == k for k in want)


def text_set(text, width=4):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def copies(rng):
    texts = [None, "", "  \n", "one", "ONE", "one two", "É a b c", "é a b c", "a b c d e"]
    for _ in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, 9)):
            new = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                new[rng.randrange(len(new))] = f"m{rng.randint(0, 999)}"
            texts.append(" ".join(new))
    shared = " ".join(f"p{i}" for i in range(60))
    return texts + [f"{shared} {' '.join(f'q{rng.randint(0, 9999)}' for _ in range(rng.randint(0, 14)))}" for _ in range(25)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    texts = copies(random.Random(seed))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, n int")
    sets = [text_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = union(pairs, range(len(sets)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    kept = jaccard.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i) and kept.columns == df.columns


def test_near_copies_of_the_pipeline(spark):
    rng = random.Random(7)
    texts = copies(rng)
    for n in (40, 100, 160):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(n)]
        texts += [" ".join(words + [f"m{rng.randint(0, 9999)}" for _ in range(n * more // 100)]) for more in (0, 22, 35)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [text_set(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union(pairs, range(len(sets)))
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == {i for i in want if want[i] == i} and len(texts) - 8 not in got


def test_jaccard_of_repeated_and_empty_tables(spark):
    kind = "doc_id long, text string"
    assert jaccard.jaccard_components(spark.createDataFrame([], kind)).count() == 0
    got = jaccard.jaccard_components(spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (3, None)], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def shuffled(spark):
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_jaccard_deals_out_no_step_twice(spark):
    rng = random.Random(11)
    texts = []
    for k in range(40):
        words = [f"w{k}_{i}" for i in range(400)]
        texts += [" ".join(words[:at] + ["m"] + words[at + 1 :]) for at in rng.sample(range(400), 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prefixes = sum(jaccard.prefix_size(len(text_set(t)), 85) for t in texts)
    before = shuffled(spark)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: i - i % 2 for i in range(80)}
    # A shingle of two texts is decided with its centre, so it is not dealt again. Before: 236 bytes for each row of a prefix.
    assert shuffled(spark) - before < 195 * prefixes


def test_jaccard_links_past_a_shared_centre(spark):
    # Every text has the shingles of a centre that links with none of them; b and c link with each other only.
    centre = [f"s{i}" for i in range(40)]
    b = [f"b{i}" for i in range(60)]
    texts = [" ".join(centre), " ".join(centre[:20] + b), " ".join(centre[:20] + b + ["x"]), " ".join(centre[20:] + [f"d{i}" for i in range(70)])]
    df = spark.createDataFrame([*enumerate(texts), (1, texts[3] + " y"), (9, texts[3] + " z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()} == {(0, 0), (1, 1), (2, 1), (3, 1), (9, 1)}


def vectors(rng):
    base = rng.normal(size=(12, 48))
    rows = [(i, (base[rng.integers(12)] + rng.normal(size=48) * rng.choice([0, 0.1, 0.15, 0.25])).tolist()) for i in range(300)]
    rows += [(1000 + i, (base[3] * (1 if i % 2 else 2)).tolist()) for i in range(10)]
    return rows + [(5000, None), (5001, [0.0] * 48), (5002, [float("nan")] * 48), (5003, [None] * 48), (5004, [1.0, 2.0]), (5005, [2.0, 4.0]), (5006, []), (5007, [float("inf")] * 48)]


@pytest.mark.parametrize("chunk", [32_768, 40])
def test_near_vectors(spark, chunk):
    rows = vectors(np.random.default_rng(chunk))
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = [(i, j) for i in good for j in good if j < i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.95]
    want, links = union(pairs, [i for i, _ in rows]), {i: 0 for i, _ in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(df, chunk=chunk).collect()}
    assert got == {i: (links[i], want[i], want[i] == i) for i in want}


def test_near_vectors_of_repeated_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert neardup_vectors.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = neardup_vectors.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_near_vectors_are_shuffled_once_and_stored_once(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6_000, 64))
    x[1_000:1_600] = x[:1] + rng.normal(size=(600, 64)) * np.linspace(0.05, 0.5, 600)[:, None]
    x[2_000:2_400:2] = x[4_000:4_200] + rng.normal(size=(200, 64)) * 0.32
    x[2_401:2_500] = x[7]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").persist()
    df.count()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = union(zip(*(k.tolist() for k in np.nonzero(near)), strict=True), range(len(x)))
    before = shuffled(spark)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup_vectors.near_duplicates(df, chunk=1_500).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in want}
    # The rows are dealt to five groups or so; their comparison shuffles no vectors. Before: more than 10 times their bytes.
    assert shuffled(spark) - before < 2.5 * x.nbytes
    df.unpersist()


@pytest.mark.parametrize("cell", [2_048, 16])
def test_top_k(spark, cell):
    rng = np.random.default_rng(cell)
    rows = [(int(i), (rng.normal(size=12) * rng.choice([1, 1, 3])).tolist()) for i in range(400)] + [(1000 + i, [0.25] * 12) for i in range(30)]
    rows += [(5000, None), (5050, [float("nan")] * 12), (5100, [None] * 12), (5150, [1.0] * 3), (5200, [2.0] * 3), (5250, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    whole = {i: np.floor(np.array(v) * 256).astype(np.int64) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in whole:
        if q % 50 == 0:
            hits = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    assert sorted(map(tuple, topk.top_k(df, cell=cell, pivots=6).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
