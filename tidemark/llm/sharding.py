"""Sharding by weighted rendezvous hashing of record keys.

Every shard draws a number for a key, from a hash of both, and the shard with the least
draw takes the key. Draws are exponential with the shard's weight as their rate, so shards
get keys in proportion to their weights. A shard's draws do not depend on the others: one
more shard takes only keys whose draws it undercuts, and no key moves between the rest.

Rows get a place in their shard without ever meeting there in one task: a shard is cut in
ranges of a hash, ranges are counted, and a row's place is the count of the ranges before
it and its rank within its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.lineage import kept

SHARDS = 24
#: Every record's own cost beside its text, in bytes.
RECORD_BYTES = 8
#: Equal rows that are placed as one.
RUN = 65_536
#: Ranges of all shards together at most: so many counts are summed up, whatever the rows.
RANGES = 1 << 17
#: Hex digits of a draw: 52 bits, all of them exact in a double.
DIGITS = 13


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """An exponential number for a key and a shard, from the first bits of an MD5 of both."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, shard.cast("string"))), 1, DIGITS), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 4 * DIGITS)) / weight


def assigned(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """(draw, shard) of the shard that takes a key; equal draws go to the smaller shard.

    Shards are numbered from ``first`` in the order of their weights, which must be above 0.
    A key is text; any other type is taken in its text form, null as the empty text.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("Every shard needs a weight above 0.")
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, i: F.struct(draw(key, i + first, w).alias("draw"), (i + first).cast("int").alias("shard")))
    return F.array_min(draws)


def ranges_of(shards: int) -> int:
    """Hex digits that cut each shard in ranges: 3 for up to 32 shards, fewer for more."""
    return max(0, min(3, (RANGES // shards).bit_length() - 1 >> 2))


def manifest(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a row for each record.

    ``shard`` is the record's shard among ``weights``, ``grown_shard`` the one if a last
    shard of weight ``added`` joined them: the same or that one. ``slot`` is the record's
    place in its shard, from 0 without gaps, in an order that only the rows' ids, sizes and
    checksums fix, never how rows are dealt. Sizes are UTF-8 bytes of the text and 8.

    Null ids share one key; null texts count as empty. Rows with the same id go to the same
    shard; equal rows get slots of their own. An empty table gives none. Only id and text
    are read, so further columns and their names do not matter, and texts of any length
    leave their task as a size and a checksum only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # Equal rows are combined before they are shuffled and placed in runs, however many they are.
    runs = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    runs = runs.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {RUN}"))).alias("run"))
    runs = runs.withColumn("n", F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN))
    best, more = assigned(F.col("doc_id"), weights), assigned(F.col("doc_id"), [added], len(weights))
    order = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32", "run"))
    runs = runs.select("*", best.alias("best"), order.alias("order"))
    runs = kept(runs.select("doc_id", "size", "text_crc32", "run", "n", "order", F.substring("order", 1, ranges_of(len(weights))).alias("range"), F.col("best.shard").alias("shard"), F.least("best", more)["shard"].alias("grown_shard")))
    counts = runs.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
    before = counts.select("shard", "range", (F.sum("rows").over(Window.partitionBy("shard").orderBy("range")) - F.col("rows")).alias("before"))
    own = Window.partitionBy("shard", "range").orderBy("order", "doc_id", "size", "text_crc32", "run")
    placed = runs.withColumn("first", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = placed.join(before, ["shard", "range"])
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("first") + F.col("copy")).alias("slot"), "grown_shard")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL for the same rows; the table of the checksum follows its polynomial.
OP13_SQL = """
WITH RECURSIVE steps AS (
  SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS round FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, round + 1 FROM steps WHERE round < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE round = 8),
bytes AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS b
  FROM documents
), sized AS (
  SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size,
         xor(list_reduce(b, lambda c, x: xor(c >> 8, crc.t[CAST(xor(c & 255, x) AS INTEGER) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc
), copies AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS key, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM sized
), drawn AS (
  SELECT key, s AS shard, -ln((CAST('0x' || substr(md5(key || '/' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS draw
  FROM (SELECT DISTINCT key FROM copies), range(25) t(s)
), homes AS (
  SELECT key, arg_min(shard, (draw, shard)) FILTER (shard < 24) AS shard, arg_min(shard, (draw, shard)) AS grown_shard FROM drawn GROUP BY key
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(key || '/' || size || '/' || text_crc32 || '/' || (copy // 65536)), doc_id, size, text_crc32, copy) - 1 AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM copies JOIN homes USING (key)
"""
