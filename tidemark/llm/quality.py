"""Quality classifier: supervised subword embeddings.

Every word has a vector, the mean of the learned vectors of its hashed form and of its
hashed character n-grams. A document's vector is the mean over its words, to which words
that repeat the one before, or any earlier one, add a learned vector each. A softmax layer
turns it into a score. Vectors and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled documents.

As the layer is linear, a word adds one number to a document's score. That number is kept
by word, so scoring a document means summing numbers.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lineage import small_batches
from tidemark.llm.training import fold, sample_labelled
from tidemark.llm.wordcache import Recent, tidy

#: Most labelled documents that are fitted on.
SAMPLE = 3_000
BUCKETS, SIZE, GRAMS = 1 << 15, 8, (2, 3, 4)
SAME, SEEN = BUCKETS, BUCKETS + 1
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.5, 1e-5
#: Steps of a vector against those of the layer: a bucket's share of a document is small.
SCALE = 40.0
CACHE_WORDS = 150_000


def buckets_of(word: str) -> list[int]:
    """The buckets of a word's whole form and of its n-grams, marked at its borders."""
    marked, crc = f"<{word}>".encode("utf-8", "replace"), zlib.crc32
    found = [crc(marked) % BUCKETS]
    for n in GRAMS:
        found += [crc(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return found


def repeats(words: list[str]) -> tuple[int, int]:
    return sum(map(eq, words, words[1:])), len(words) - len(set(words))


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a document and their shares in its vector."""
    words = text.split()
    n = max(1, len(words))
    ids, shares = [], []
    for word, times in Counter(words).items():
        found = buckets_of(word)
        ids += found
        shares += [times / n / len(found)] * len(found)
    same, seen = repeats(words)
    total = np.bincount([*ids, SAME, SEEN], [*shares, same / n, seen / n], BUCKETS + 2)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


class Embeddings:
    """Trained vectors and layer, folded into one number for each bucket."""

    def __init__(self, ids: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        e = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS + 2, SIZE)).astype(np.float32)
        w, b, steps = rng.normal(0, 0.3, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32), 0
        total = EPOCHS * -(-len(y) // BATCH)
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
                rate, steps = RATE * (1 - steps / total), steps + 1
                at, share = np.concatenate([ids[r] for r in rows]), np.concatenate([shares[r] for r in rows])
                owner = np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows])
                h = np.stack([np.bincount(owner, e[at, k] * share, len(rows)) for k in range(SIZE)], 1)
                z = h @ w + b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ w.T)[owner] * share[:, None]
                w -= rate * (h.T @ p + DECAY * w).astype(np.float32)
                b -= rate * 0.1 * p.sum(0).astype(np.float32)
                step = np.stack([np.bincount(at, back[:, k], BUCKETS + 2) for k in range(SIZE)], 1)
                e -= (rate * SCALE * step).astype(np.float32)
        line = w[:, 1] - w[:, 0]
        self.gain, self.bias = (e @ line).astype(np.float64), float(b[1] - b[0])

    def scorer(self) -> Callable[[str], float]:
        """A task's own function for texts, with the numbers of the words it has seen lately."""
        gain = self.gain.tolist()
        at, same_gain, seen_gain = gain.__getitem__, gain[SAME], gain[SEEN]

        def value(word: str) -> float:
            found = buckets_of(word)
            return sum(map(at, found)) / len(found)

        cache = Recent(value, CACHE_WORDS)

        def score(text: str) -> float:
            words = text.split()
            same, seen = repeats(words)
            z = self.bias + (sum(cache.all(words)) + same * same_gain + seen * seen_gain) / max(1, len(words))
            return 1 / (1 + math.exp(-min(50.0, max(-50.0, z))))

        return score


class Share:
    """The smoothed share of good documents, where a sample has one label only."""

    def __init__(self, y: np.ndarray):
        self.share = float((y.sum() + 1) / (len(y) + 1))

    def scorer(self) -> Callable[[str], float]:
        return lambda text: self.share


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id"):
    small_batches(docs.sparkSession)
    rows = sample_labelled(docs, labels, "quality", fold(F.col("id"), folds) != held, sample, text_col, id_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sparse(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32())), batch.column(2)], ["id", "ids", "shares", "label"])

    kind = rows.schema["id"].dataType.simpleString()
    # The sample is bounded, so it may be gathered; as Arrow it takes a few bytes an entry.
    table = rows.select("id", "text", "label").mapInArrow(run, f"id {kind}, ids array<int>, shares array<float>, label int").toArrow().sort_by("id")
    y = table["label"].to_numpy().astype(np.int64)
    if not 0 < y.sum() < len(y):
        return Share(y)
    return Embeddings([x.values.to_numpy() for x in table["ids"]], [x.values.to_numpy() for x in table["shares"]], y)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, held_out, score and predicted.

    Null and empty texts score by the layer's bias alone. Repeated rows give repeated
    rows. Only id and text are read, and the id decides held_out alone. Without documents
    of both labels the score is the share of good ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held, sample, text_col, id_col))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return made.select(F.col("id").alias(id_col), (fold(F.col("id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows whose score is at least 0.5, with all their columns, whatever their names.

    Null and empty texts score by the layer's bias alone; a very long text is scored whole.
    Repeated rows stay or go together, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held, SAMPLE, text_col, id_col))
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t or "") >= 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
