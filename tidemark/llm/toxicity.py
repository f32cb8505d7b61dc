"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

Features are lexicon densities, nearness of lexicon words to second-person words, and rates
of capitals, punctuation and obfuscation. The lexicon is a short fixed list plus words and
word stems learned from the labelled sample; trees are grown on features by a lexicon from
the sample's other half, where learned entries are not flattered by the texts they came from. All fitting is
done in numpy on that bounded sample; scoring runs over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lineage import small_batches
from tidemark.llm.training import fold, sample_labelled
from tidemark.llm.wordcache import Recent, tidy

#: Most labelled documents that are fitted on, and most learned lexicon entries.
SAMPLE, ENTRIES = 12_000, 4_000
#: Least toxic texts that must hold an entry, and least share of its texts that are toxic.
SUPPORT, PRECISION = 3, 0.8
STEMS = (4, 5, 6, 7, 8)
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 80, 3, 0.15, 32, 3, 0.5
NEAR = 4
#: Insults that any sample should know, and second-person words.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown fool imbecile filth garbage".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"\w+")
MASKED = re.compile(r"[^\W\d_]+[@$!*0-9]+[^\W\d_]+")
SPACED = re.compile(r"\b\w(?:[ .\-_*]\w){3,}\b")
RUNS = re.compile(r"(\w)\1{3,}")
#: Classes of bytes: 1 capital, 2 digit, 3 other punctuation, 4 question or exclamation mark, 5 white space.
CLASSES = np.zeros(256, np.uint8)
CLASSES[65:91], CLASSES[48:58] = 1, 2
CLASSES[[ord(c) for c in "\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"]] = 3
CLASSES[[ord("!"), ord("?")]] = 4
CLASSES[[32, 9, 10, 11, 12, 13]] = 5
N_FEATURES = 17
CACHE_WORDS = 100_000


def entries_of(text: str) -> set[str]:
    """The words of a text and their stems; a stem ends in a tilde."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "~" for w in words for k in STEMS if len(w) > k}


class Lexicon:
    """Weights of words and stems, with the weight of each word seen so far."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.seen = Recent(self.weight, CACHE_WORDS)

    def weight(self, word: str) -> float:
        w = self.weights.get(word, 0.0)
        for k in STEMS:
            if len(word) > k:
                w = max(w, self.weights.get(word[:k] + "~", 0.0))
        return w

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        n = max(1, len(words))
        found = self.seen.all(words)
        learned = [(i, x) for i, x in enumerate(found) if x] if any(found) else []
        insults = [i for i, w in enumerate(words) if w in INSULTS]
        you = [i for i, w in enumerate(words) if w in YOU]
        hits, near = sorted({*insults, *(i for i, _ in learned)}), 0
        if hits and you:
            marks, at = np.asarray(you), np.asarray(hits)
            right = np.searchsorted(marks, at)
            gap = np.minimum(np.abs(marks[np.minimum(right, len(marks) - 1)] - at), np.abs(at - marks[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        masked = MASKED.findall(text)
        plain = [m.lower().translate(LEET).replace("*", "") for m in masked]
        unmasked = sum(1 for m in plain if m in INSULTS or self.weight(m))
        spaced = [re.sub(r"[^\w]|_", "", m).lower() for m in SPACED.findall(text)]
        unmasked += sum(1 for m in spaced if m in INSULTS or self.weight(m))
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        kinds = np.bincount(CLASSES[raw], minlength=6) if len(raw) else np.zeros(6, np.int64)
        chars = max(1, len(raw))
        return [
            len(insults) / n,
            math.log1p(len(insults)),
            len(learned) / n,
            math.log1p(len(learned)),
            max((x for _, x in learned), default=0.0),
            sum(x for _, x in learned) / n,
            sum(x for _, x in learned),
            near / max(1, len(hits)),
            len(you) / n,
            kinds[1] / chars,
            kinds[3] / chars,
            kinds[4] / chars,
            kinds[2] / chars,
            (len(masked) + len(spaced)) / n,
            math.log1p(unmasked),
            sum(1 for _ in RUNS.finditer(text)) / n,
            math.log1p(len(words)),
        ]


# -- boosted trees --------------------------------------------------------
def grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> list[tuple[int, int, float]]:
    """A complete tree of DEPTH levels as (feature, bin, leaf value) in heap order."""
    n_nodes, d = 2 ** (DEPTH + 1) - 1, binned.shape[1]
    tree, node = [(-1, 0, 0.0)] * n_nodes, np.zeros(len(grad), np.int64)
    for k in range(n_nodes):
        rows = np.flatnonzero(node == k)
        g, h = grad[rows].sum(), hess[rows].sum()
        tree[k] = (-1, 0, -g / (h + RIDGE))
        if k >= 2**DEPTH - 1 or len(rows) < 2 * LEAST_LEAF:
            continue
        best = 1e-6
        for f in range(d):
            b = binned[rows, f]
            gs = np.cumsum(np.bincount(b, grad[rows], BINS))[:-1]
            hs = np.cumsum(np.bincount(b, hess[rows], BINS))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
            gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
            gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = -1
            at = int(gain.argmax())
            if gain[at] > best:
                best, tree[k] = gain[at], (f, at, 0.0)
        if tree[k][0] >= 0:
            f, at, _ = tree[k]
            node[rows] = np.where(binned[rows, f] <= at, 2 * k + 1, 2 * k + 2)
    return tree


class Boosted:
    """Trees grown by Newton steps on the logistic loss, over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) if len(np.unique(c)) > BINS else np.unique(c)[:-1] for c in x.T]
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.start, self.trees = math.log(p / (1 - p)), []
        binned, raw = self.binned(x), np.full(len(y), self.start)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-raw))
            tree = grow(binned, q - y, q * (1 - q))
            self.trees.append(tree)
            raw = raw + RATE * self.leaves(tree, binned)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, x.shape[1]), np.int64)

    @staticmethod
    def leaves(tree: list[tuple[int, int, float]], binned: np.ndarray) -> np.ndarray:
        f, at, value = (np.array(c) for c in zip(*tree, strict=True))
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(DEPTH):
            inner = f[node] >= 0
            node = np.where(inner, 2 * node + np.where(binned[rows, np.maximum(f[node], 0)] <= at[node], 1, 2), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self.binned(x)
        return self.start + RATE * sum((self.leaves(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit of y on raw by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order], y[order].astype(float), strict=True):
        pools.append([v, 1.0, r, r])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            v2, w2, _, hi = pools.pop()
            v1, w1, lo, _ = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi]
    return np.array([(p[2] + p[3]) / 2 for p in pools]), np.array([(p[0] * p[1] + 0.5) / (p[1] + 1) if p[1] < 2 else p[0] for p in pools])


class Calibrated:
    """Trees, and a rising map of their sums fitted on sums of trees that had not seen the rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: int = 3):
        part = np.arange(len(y)) % folds
        out = np.zeros(len(y))
        for k in range(folds):
            out[part == k] = Boosted(x[part != k], y[part != k]).raw(x[part == k])
        self.model, (self.at, self.value) = Boosted(x, y), isotonic(out, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.model.raw(x)
        # A hundredth of the uncalibrated probability parts ties within a pool.
        return np.clip(0.99 * np.interp(raw, self.at, self.value) + 0.01 / (1 + np.exp(-np.clip(raw, -50, 50))), 0, 1)


class Prior:
    """Where a sample has one label only: that label's smoothed share, and fixed insults count as toxic."""

    def __init__(self, y: np.ndarray):
        self.share = (y.sum() + 0.05) / (len(y) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[:, 0] > 0.002, max(self.share, 0.6), self.share) if len(x) else np.zeros(0)


def learn_lexicon(sample: DataFrame, limit: int = ENTRIES) -> dict[str, float]:
    """Words and stems of toxic texts by log-odds."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(entries_of(text or ""))
        names = [*{*toxic, *clean}]
        yield pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.string()), "toxic": pa.array([toxic[x] for x in names], pa.int64()), "clean": pa.array([clean[x] for x in names], pa.int64())})

    totals = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    counts = sample.select("text", "label").mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(totals[0] + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(totals[1] + 1.0))
    best = counts.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean")))).withColumn("odds", odds)
    return {r.entry: r.odds for r in best.orderBy(F.desc("odds"), "entry").limit(limit).collect() if r.odds > 1}


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id"):
    """The lexicon's weights and the calibrated model, from labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = sample_labelled(docs, labels, "toxic", fold(F.col("id"), folds) != held, sample, text_col, id_col)
    half = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2))
    weights = learn_lexicon(rows)
    crossed = [with_features(rows.where(half == k), learn_lexicon(rows.where(half == 1 - k)), ["id", "label"]) for k in (0, 1)]
    # The sample is bounded, so it is put in order here rather than by another pass over its texts.
    grown = sorted(crossed[0].union(crossed[1]).withColumn("order", F.xxhash64("id")).collect(), key=lambda r: (r.order, r.id))
    x = np.array([r.features for r in grown], np.float64).reshape(-1, N_FEATURES)
    y = np.array([r.label for r in grown], np.float64)
    return weights, Calibrated(x, y) if 0 < y.sum() < len(y) else Prior(y)


def with_features(rows: DataFrame, weights: dict[str, float], carry: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            made = [lexicon.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), *batch.columns[1:]], ["features", *carry])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select("text", *carry).mapInArrow(run, f"features array<double>, {kinds}")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, held_out, score and predicted.

    Null texts score as empty ones. Repeated rows give repeated rows. Only id and text are
    read, and the id decides held_out alone. Without documents of both labels to learn
    from, fixed insults decide.
    """
    weights, model = fit(docs, labels, folds, held, sample, text_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast((weights, model))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, model = shared.value
        lexicon = Lexicon(weights)
        for batch in batches:
            x = np.array([lexicon.features(t or "") for t in batch.column(1).to_pylist()], np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return made.select(F.col("id").alias(id_col), (fold(F.col("id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows whose score is below 0.5, with all their columns, whatever their names.

    Null and empty texts score as empty ones; a very long text is scored whole. Repeated rows
    stay or go together, and an empty table stays empty.
    """
    weights, model = fit(docs, labels, folds, held, SAMPLE, text_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast((weights, model))
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, model = shared.value
        lexicon = Lexicon(weights)
        for batch in batches:
            x = np.array([lexicon.features(t or "") for t in batch.column(at).to_pylist()], np.float64).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.score(x) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
