"""Ranked lexical search, half term at a time and half document at a time.

One pass over the texts keeps each document's length and its counts of the items' terms; the
corpus' numbers come from those rows. A task then turns them into posting lists, a block of
documents at a time, and searches each item: its short lists are summed term by term into
accumulators, which from then on are one more list, whose bound is its largest sum. That
list and the long ones are gone through together in order of documents. With k answers at
hand, lists whose bounds add up to less than the k-th score cannot bring in a document by
themselves: only documents of the other lists are taken up, those that cannot reach the
score any more are dropped on the way, and the rest of a long list is skipped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.lineage import small_batches, written

K = 50
#: Bytes of items' texts that are searched for in one go: they and their terms are broadcast.
ITEM_BYTES = 4 << 20
#: Documents and postings of a block at most, and documents of a step through its lists.
DOCUMENTS, POSTINGS, STEP = 32_768, 4_000_000, 4_096
#: A block's short lists hold together one posting for so many documents.
SHORT = 8
#: Parts that the answers of an item are reduced in first.
PARTS = 64
#: Digits, letters with A-Z lowered and all bytes beyond ASCII stay; the rest parts terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
LAST = np.iinfo(np.int64).max


def words(text: bytes) -> list[bytes]:
    """A text's terms in order, from its UTF-8 bytes."""
    return text.translate(TABLE).split()


class Query(NamedTuple):
    """An item's terms that can score, by number, and their weights."""

    item: int | None
    terms: np.ndarray
    weights: np.ndarray


class Best:
    """The k best answers so far: greatest scores, ties to the smaller id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def floor(self) -> int:
        """The score that a further answer needs at least."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def accumulators(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list of summed scores in order of documents, from lists that are summed term by term."""
    places, inverse = np.unique(np.concatenate([p for p, _ in lists]), return_inverse=True)
    sums, at = np.zeros(len(places), np.int64), 0
    for own, scores in lists:
        sums[inverse[at : at + len(own)]] += scores
        at += len(own)
    return places, sums


def search(lists: list[tuple[np.ndarray, np.ndarray]], size: int, ids: np.ndarray, null: np.ndarray, best: Best, step: int = STEP, short: int = SHORT) -> None:
    """Add a block's answers for one item to ``best``.

    ``lists`` has for each term the places of its documents in the block, ascending, and
    their scores; ``size`` is the number of documents.
    """
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: len(x[0]))
    held = np.searchsorted(np.cumsum([len(p) for p, _ in lists]), size // short, side="right")
    lists = ([accumulators(lists[:held])] if held else []) + lists[held:]
    lists.sort(key=lambda x: x[1].max())
    reach = np.cumsum([0, *(int(s.max()) for _, s in lists)])  # what the first lists can add at most
    at = [0] * len(lists)
    for low in range(0, size, step):
        floor = best.floor
        # The lists before it cannot reach the floor together; as it rises, they are never gone through again.
        first = int(np.searchsorted(reach[1:], floor))
        if first == len(lists):
            return
        sums = np.zeros(min(step, size - low), np.int64)
        for i in range(first, len(lists)):
            places, scores = lists[i]
            end = at[i] + int(np.searchsorted(places[at[i] :], low + step))
            sums[places[at[i] : end] - low] += scores[at[i] : end]
            at[i] = end
        found = np.flatnonzero(sums + (sums > 0) * reach[first] >= floor)
        sums = sums[found]
        for i in range(first - 1, -1, -1):
            if not len(found):
                break
            places, scores = lists[i]
            spot = np.minimum(np.searchsorted(places, found + low), len(places) - 1)
            sums += np.where(places[spot] == found + low, scores[spot], 0)
            stay = sums + reach[i] >= floor
            found, sums = found[stay], sums[stay]
        if len(found):
            best.add(sums, ids[found + low], null[found + low])


def norms(lengths: list[int], documents: int, total: int) -> np.ndarray:
    """What a document's length makes of it: 100 for the mean length. Products may outgrow 64 bits before the division."""
    return np.array([50 + 50 * n * documents // max(total, 1) for n in lengths], np.int64)


def parts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What each posting scores before its term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


def _items(rows: list) -> tuple[dict, dict[bytes, int]]:
    """Terms of each item by number, and their numbers."""
    numbers: dict[bytes, int] = {}
    items: dict = {}
    for row in rows:
        own = items.setdefault(row.item_id, set())
        own.update(numbers.setdefault(t, len(numbers)) for t in words((row.text or "").encode()))
    return items, numbers


def _indexed(docs: DataFrame, numbers: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): every document's length and its counts of the numbered terms."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                own = words(text or b"")
                lengths.append(len(own))
                hits = [(number[t], n) for t, n in Counter(own).items() if t in number]
                terms += [t for t, _ in hits]
                tfs += [n for _, n in hits]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    table = written(rows.mapInArrow(index, "doc_id long, n long, terms array<int>, tfs array<long>"))
    shared.destroy()
    return table


def _answers(index: DataFrame, queries: list[Query], documents: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each task for each item, by number."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def block(batches: list[pa.RecordBatch], best: list[Best]) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids = rows["doc_id"].combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(LAST).to_numpy()
        norm, terms = norms(rows["n"].to_pylist(), documents, total), rows["terms"].combine_chunks()
        places = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
        terms, tfs = terms.flatten().to_numpy(), rows["tfs"].combine_chunks().flatten().to_numpy()
        order = np.argsort(terms, kind="stable")
        terms, places = terms[order], places[order]
        scores = parts(tfs[order], norm[places])
        for query, own in zip(shared.value, best, strict=True):
            begin, end = np.searchsorted(terms, query.terms), np.searchsorted(terms, query.terms, side="right")
            search([(places[b:e], w * scores[b:e]) for b, e, w in zip(begin, end, query.weights, strict=True)], len(ids), ids, null, own)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in shared.value]
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= DOCUMENTS or sum(len(b.column(2).flatten()) for b in waiting) >= POSTINGS:
                block(waiting, best)
                waiting = []
        if waiting:
            block(waiting, best)
        for number, own in enumerate(best):
            if len(own.ids):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(number, pa.int32()), len(own.ids)), pa.array(own.ids, mask=own.null), pa.array(own.scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(answers, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of all that score highest for each item.

    Scores are above 0 and whole numbers; equal ones rank by ascending id, null ids last.
    Repeated rows are documents of their own and may all be answers. Texts without terms,
    null ones among them, are not counted; items of null or empty text have no answers. Rows that share an item's id are one item with the terms
    of all. Ids are whole numbers. Texts of any length are read whole, and only their counts
    of items' terms go on. Empty tables give no rows; further columns are not read.

    Items are searched for in blocks by a hash of their id of about ``item_bytes`` each, which
    bounds what is broadcast; one item alone may be longer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / item_bytes))
    answers = None
    for number in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        terms, numbers = _items(rows)
        index = _indexed(docs, numbers, id_col, text_col)
        documents, total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in frequency.items()}
        queries = []
        for item, own in terms.items():
            scoring = np.array(sorted(t for t in own if weights.get(t, 0) > 0), np.int32)
            queries.append(Query(item, scoring, np.array([weights[t] for t in scoring.tolist()], np.int64)))
        found = _answers(index, queries, documents, total, k)
        names = spark.createDataFrame([(n, q.item) for n, q in enumerate(queries)], "item int, item_id long")
        found = found.join(F.broadcast(names), "item").drop("item")
        answers = found if answers is None else answers.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = answers.withColumn("part", F.spark_partition_id() % PARTS)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = some.select("item_id", "doc_id", "score").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return best.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB SQL for the same answers, from all scores.
OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), whole AS (SELECT count(*) FILTER (len(words) > 0) AS documents, CAST(sum(len(words)) AS BIGINT) AS total FROM docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), counts AS (
  SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(words) AS n, unnest(words) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY term, documents
), scored AS (
  SELECT item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // total)))) AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term), whole GROUP BY ALL
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
  FROM scored WHERE score > 0
)
SELECT * FROM placed WHERE rank <= 50
"""
