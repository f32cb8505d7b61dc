"""Exact top-k by inner product over a pivot-distance index.

Whole-number vectors get one more coordinate that makes all of them equally long, so a
larger inner product with a query means a smaller distance to it. Each vector is keyed by
its nearest pivot and its distance to it; rings of equal width around a pivot, cut by a
hash where they are large, are packed into cells with their least and greatest distance.

A query first searches its own cell, which gives a score that its k-th answer cannot fall
below and with it a radius. By the triangle inequality an answer's distance to a pivot
differs from the query's by that radius at most, so around each pivot only the annulus of
those distances is visited. Queries are packed by cell too, and a block visits a cell if
one of its queries does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.lineage import kept, small_batches

K, SCALE, EVERY = 5, 256, 50
#: Pivots (a bounded sample of the vectors), rings over the greatest length, rows of a cell.
PIVOTS, RINGS, CELL = 32, 16, 2_048
#: Parts that the answers of a query are reduced in first.
PARTS = 16
#: Whole numbers up to this are exact in the sums below.
EXACT = float(1 << 53)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two arrays of whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def lengths(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    return np.einsum("ij,ij->i", x, x)


def distances(v: np.ndarray, height: np.ndarray, pivots: np.ndarray, tops: np.ndarray, longest: float) -> np.ndarray:
    """Distances of rows to pivots with the added coordinate (0 for queries)."""
    x, p = v.astype(np.float64), pivots.astype(np.float64)
    d = lengths(v)[:, None] + height[:, None] ** 2 + longest - 2 * (x @ p.T + height[:, None] * tops[None])
    return np.sqrt(np.maximum(d, 0))


def whole(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with whole-number components; vectors with null or non-finite ones are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS, rings: int = RINGS, cell: int = CELL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose id ``every`` divides.

    Candidates are all rows but the query's own; fewer than k give fewer answers, ties go
    to the smaller id. Null vectors and such with null or non-finite components take no
    part. Vectors of different lengths never meet. Rows that share id and vector count
    once. Only id and vector are read.
    """
    small_batches(vectors.sparkSession)
    rows = kept(whole(vectors, scale, id_col, vector_col))
    dims = [r[0] for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    parts = [_search(rows.where(F.size("v") == d), d, k, every, pivots, rings, cell) for d in dims]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    # Each task leaves k answers of a query; those of some tasks meet first, so no query's answers of all tasks meet at once.
    order = [F.desc("score"), F.asc("vec_id")]
    some = hits.withColumn("part", F.spark_partition_id() % PARTS).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order)))
    some = some.where(F.col("rank") <= k).select("query_id", "vec_id", "score")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, dim: int, k: int, every: int, pivots: int, rings: int, cell: int) -> DataFrame:
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = float(rows.agg(F.max(square)).first()[0])
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    heart = np.unique(np.array([r.v for r in chosen], np.int64).reshape(-1, dim), axis=0)
    tops = np.sqrt(np.maximum(0, longest - lengths(heart)))
    width = max(np.sqrt(longest) / rings, 1e-9)
    shared = spark.sparkContext.broadcast((heart, tops))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heart, tops = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1), dim)
            d = distances(v, np.sqrt(np.maximum(0, longest - lengths(v))), heart, tops, longest)
            near = d.argmin(1)
            at = d[np.arange(len(d)), near]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(np.floor(at / width).astype(np.int32)), pa.array(at)], ["id", "v", "pivot", "ring", "far"])

    keyed = kept(rows.mapInArrow(key, "id long, v array<long>, pivot int, ring int, far double"))
    # One row for each pivot and ring; their number does not grow with the data.
    sizes = keyed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / cell).alias("cuts"))
    dealt = keyed.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn("cut", F.pmod(F.xxhash64("id"), "cuts"))

    def packed(table: pa.Table) -> pa.Table:
        ids, v, far = table["id"].to_numpy(), matrix(table["v"], dim), table["far"].to_numpy()
        mine = np.flatnonzero(ids % every == 0)
        floors = np.full(len(mine), np.iinfo(np.int64).min)
        if len(mine):
            scores = products(v[mine], v)
            for row, q in enumerate(mine):
                others = np.flatnonzero(ids != ids[q])
                if len(others) >= k:
                    floors[row] = np.partition(scores[row, others], len(others) - k)[len(others) - k]
        key = [table[c][0].as_py() for c in ("pivot", "ring", "cut")]
        return pa.table({
            "cell": pa.array(["/".join(map(str, key))]), "pivot": pa.array([key[0]], pa.int32()), "low": [float(far.min())], "high": [float(far.max())],
            "ids": [ids.tobytes()], "vs": [v.astype(np.int64).tobytes()], "q_ids": [ids[mine].tobytes()], "q_vs": [v[mine].astype(np.int64).tobytes()], "floors": [floors.tobytes()],
        })

    cells = kept(dealt.groupBy("pivot", "ring", "cut").applyInArrow(packed, "cell string, pivot int, low double, high double, ids binary, vs binary, q_ids binary, q_vs binary, floors binary"))

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heart, tops = shared.value
        for batch in batches:
            names, wanted, lows, highs = [], [], [], []
            for name, q, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                q, f = np.frombuffer(q, np.int64).reshape(-1, dim), np.frombuffer(f, np.int64)
                own = lengths(q)
                radius = np.where(f == np.iinfo(np.int64).min, np.inf, np.sqrt(np.maximum(0, own + longest - 2 * f.astype(np.float64))))
                d = distances(q, np.zeros(len(q)), heart, tops, longest)
                slack = 1e-6 * (1 + np.sqrt(longest) + np.sqrt(own))
                names += [name] * len(heart)
                wanted += range(len(heart))
                lows += (d - (radius + slack)[:, None]).min(0).tolist()
                highs += (d + (radius + slack)[:, None]).max(0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(wanted, pa.int32()), pa.array(lows, pa.float64()), pa.array(highs, pa.float64())], ["block", "pivot", "from_", "to_"])

    blocks = cells.where(F.length("q_ids") > 0)
    reach = blocks.select("cell", "q_vs", "floors").mapInArrow(annuli, "block string, pivot int, from_ double, to_ double")
    visits = reach.join(cells.select("cell", "pivot", "low", "high"), "pivot").where("high >= from_ and low <= to_").select("block", "cell")
    visits = visits.join(blocks.select(F.col("cell").alias("block"), "q_ids", "q_vs", "floors"), "block").join(cells.select("cell", "ids", "vs"), "cell")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for q_ids, q_vs, floors, ids, vs in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_vs", "floors", "ids", "vs")), strict=True):
                q_ids, floors, ids = (np.frombuffer(x, np.int64) for x in (q_ids, floors, ids))
                scores = products(np.frombuffer(q_vs, np.int64).reshape(-1, dim), np.frombuffer(vs, np.int64).reshape(-1, dim))
                hit = (scores >= floors[:, None]) & (q_ids[:, None] != ids[None])
                for row in np.flatnonzero(hit.any(1)):
                    at = np.flatnonzero(hit[row])
                    at = at[best(scores[row, at], ids[at], k)]
                    out[0].append(np.full(len(at), q_ids[row]))
                    out[1].append(ids[at])
                    out[2].append(scores[row, at])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    return visits.select("q_ids", "q_vs", "floors", "ids", "vs").mapInArrow(visit, "query_id long, vec_id long, score long")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB SQL for the same answers.
OP10_SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
