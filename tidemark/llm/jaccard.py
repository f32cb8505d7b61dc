"""Jaccard join of word shingles by rare-first prefix filtering.

1. One pass hashes every text's shingles. Equal sets become one node. The pass also counts
   shingles by hash bucket over all texts, which orders shingles from rare to frequent.
2. A second pass takes each node's prefix: its rarest shingles, as many as any partner
   must share one of. Nodes meet on prefix shingles that more than one node has.
3. Lengths, positions and the number of shared prefix shingles drop pairs that cannot link,
   then a suffix filter: each set is dealt by hash into parts, and the parts whose sizes are
   even in one set and odd in the other bound from below how many shingles differ. What is
   left is verified once on the whole sets.

All pairs of a group of near copies are never made. First each prefix shingle's nodes are
compared with one centre, the node whose prefix is shared most, which is the text that the
others were copied from. Then only nodes that are not yet connected are compared with
others of their shingle than the centre. Every pair that shares a prefix shingle has thus been verified or
is connected already, so no component is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.lineage import kept, small_batches, written
from tidemark.llm.wordcache import tidy

WORDS, PERCENT = 4, 85
#: Buckets of shingle counts, the slices they are summed in, and 64-bit words of a set's short parities.
BUCKETS, SLICES, PARITIES = 1 << 20, 64, 16
#: Rows of ids that may be broadcast: 16 MB. Beyond, the same join shuffles.
FEW = 2_000_000
#: Texts of one shingle and band of lengths that one task joins with others.
CHUNK = 2_000
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _PRIME
        out ^= out >> np.uint64(29)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def prefix_size(n: int, percent: int) -> int:
    """How many of n sorted shingles must hold one of any partner's: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def parities(s: np.ndarray, parts: int) -> np.ndarray:
    """A bit for each part of a set, whether its size is odd; halves of it XOR to the bits of half the parts."""
    counts = np.bincount((s >> np.uint64(32)).astype(np.int64) & (parts - 1), minlength=parts)
    return np.packbits((counts & 1).astype(np.uint8))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _profiles(texts: DataFrame, width: int) -> DataFrame:
    """(id, n, print, parities, wide) of each text, and the task's bucket counts in rows without id.

    The wide parities have a bit for each shingle at least, the short ones are for joins.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        names = ["id", "n", "print", "parities", "wide", "slice", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                s = shingles(text, width)
                np.add.at(counts, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                bits = parities(s, max(64 * PARITIES, 1 << max(0, len(s) - 1).bit_length()))
                for column, value in zip(made, (len(s), xxhash.xxh3_128_digest(s.tobytes()), folded(bits, 8 * PARITIES).view("<i8").tolist(), bits.tobytes()), strict=True):
                    column.append(value)
            rows = len(made[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(made, kinds[1:5], strict=True)), pa.nulls(rows, kinds[5]), pa.nulls(rows, kinds[6])], names)
        if counts.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, k) for k in kinds[:5]), pa.array(range(SLICES), kinds[5]), pa.array(parts, kinds[6])], names)

    return texts.mapInArrow(run, "id long, n long, print binary, parities array<long>, wide binary, slice int, counts binary")


def _frequencies(profiles: DataFrame) -> np.ndarray:
    """Shingles in each bucket over all texts: every task's counts, added in two rounds; the table's size is fixed."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // SLICES, np.int64)
        for part in table["counts"].to_pylist():
            part = zlib.decompress(part)
            total += np.frombuffer(part, np.int32 if len(part) == 4 * len(total) else np.int64)
        return pa.table({"slice": table["slice"].slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = profiles.where("slice is not null").select("slice", "counts").withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(64)))
    sums = rows.groupBy("slice", "part").applyInArrow(add, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    parts = {r.slice: np.frombuffer(zlib.decompress(r.counts), np.int64) for r in sums.collect()}
    none = np.zeros(BUCKETS // SLICES, np.int64)
    return np.concatenate([parts.get(i, none) for i in range(SLICES)])


def _semi(rows: DataFrame, ids: DataFrame, how: str, key: str = "id") -> DataFrame:
    """Rows whose id is (left_semi) or is not (left_anti) among ids, broadcast if they are few."""
    ids = kept(ids.distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= FEW else ids, key, how)


def _prefixes(texts: DataFrame, table: np.ndarray, width: int, percent: int) -> DataFrame:
    """(token, id, n, at) for the rarest shingles of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            tokens, owners, sizes, places = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                s = shingles(text, width)
                if not len(s):
                    continue
                size = prefix_size(len(s), percent)
                order = np.argsort(table[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")[:size]
                tokens.append(s[order].view(np.int64))
                owners.append(np.full(size, i))
                sizes.append(np.full(size, len(s), np.int32))
                places.append(np.arange(size, dtype=np.int32))
            if tokens:
                ids = batch.column(0).take(pa.array(np.concatenate(owners)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), ids, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["token", "id", "n", "at"])

    return texts.mapInArrow(run, "token long, id long, n int, at int")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filters for two rows that share a prefix shingle."""
    na, nb, pa_, pb = (F.col(f"{x}.{c}").cast("long") for c, x in (("n", a), ("n", b), ("at", a), ("at", b)))
    most = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _differ_little(a: str, b: str, percent: int) -> Column:
    """Suffix filter: the parts that differ in parity are no more than a linked pair's differing shingles."""
    differ = sum((F.bit_count(F.col(f"{a}.parities")[i].bitwiseXOR(F.col(f"{b}.parities")[i])) for i in range(PARITIES)), F.lit(0)).cast("long")
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{a}.n").cast("long") + F.col(f"{b}.n").cast("long"))


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, each verified once; nodes has (id, n, wide)."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}")), side)

    @tidy
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "wide_a", "wide_b")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                stays.append((100 + percent) * differ <= (100 - percent) * (na + nb))
            yield batch.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))

    pairs = kept(pairs.select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(bound, "a long, b long"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width).view(np.int64) for t in batch.column(1).to_pylist()]
            starts = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["id", "set"])

    sets = _semi(texts, ids, "left_semi").mapInArrow(encode, "id long, set array<long>")
    whole = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    # Sets meet inside the engine: only ids leave the join.
    links = (100 + percent) * F.size(F.array_intersect("set_a", "set_b")).cast("long") >= percent * (F.size("set_a").cast("long") + F.size("set_b").cast("long"))
    return kept(whole.where(links).select("a", "b").distinct())


def _meeting(apart: DataFrame, every: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Each two rows (columns of ``apart`` as struct a, of ``every`` as struct b) of one token whose lengths may link.

    Lengths fall in bands as wide as linked lengths can differ, so partners lie in the same or
    the next band. The rows of a token and band are dealt in chunks by a hash of the id, and
    each row of ``apart`` goes to all chunks: no shingle, however common, is left to one task.
    """
    width = float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1.0
    placed = every.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    large = kept(placed.groupBy("token", "band").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).where("chunks > 1"))
    large = F.broadcast(large) if large.count() <= FEW else large
    right = placed.join(large, ["token", "band"], "left").select("token", "band", F.coalesce(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"), F.lit(0)).alias("part"), F.struct(*every.columns).alias("b"))
    band = F.floor(F.log("n") / width).cast("int")
    left = apart.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).join(large, ["token", "band"], "left")
    left = left.select("token", "band", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("part"), F.struct(*apart.columns).alias("a"))
    return left.join(right, ["token", "band", "part"])


def jaccard_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_shingles and component_id.

    Documents link when 100 * shared >= percent * united distinct shingles; a component is
    named by its least id. Null, empty and blank texts have no shingles and link with
    nothing. Repeated rows give repeated rows. Rows that share an id are one document that
    links when any of its texts does. Rows without an id are left out.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    profiles = kept(_profiles(texts, width))
    table = _frequencies(profiles)
    rows = profiles.where("id is not null").select("id", "n", "print", "parities", "wide")
    nodes = kept(rows.where("n > 0").groupBy("print").agg(F.min_by(F.struct("id", "n", "parities", "wide"), "id").alias("x"), F.min("id").alias("node")))
    copies = kept(rows.where("n > 0").join(nodes.select("print", "node"), "print").where("id <> node").select("id", "node").distinct())
    nodes = nodes.select("x.*")
    # Texts of copies are left out, but an id that also names a text of its own stays.
    ones = texts.transform(lambda t: _semi(t, copies.select("id").join(nodes.select("id"), "id", "left_anti"), "left_anti"))

    tokens = written(_prefixes(ones, table, width, percent))
    several = tokens.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    # The share of a node's prefix that others have too: highest for what others were copied from.
    # A node's rows are no more than its text's prefix, so they may meet in one task.
    own = Window.partitionBy("id")
    score = F.count("*").over(own) / F.max(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).over(own)
    shared = written(tokens.join(several, "token").select("token", "id", "n", "at", "size", score.alias("score")))
    centres = shared.groupBy("token", "size").agg(F.max(F.struct("score", (-F.col("id")).alias("back"), "n", "at")).alias("c"))
    centres = written(centres.select("token", "size", (-F.col("c.back")).alias("id"), "c.n", "c.at"))
    first = shared.alias("a").join(centres.alias("b"), "token").where((F.col("a.id") != F.col("b.id")) & _may_link("a", "b", percent))
    first = written(first.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct())
    links = _verify(first, nodes, ones, width, percent)

    # Pairs with a centre are decided: verified, or ruled out by length and position. So a shingle of
    # two texts is done with, and of others the centre's row. A pair that is left shares no such shingle,
    # so the shingles it is met on are all that it shares.
    known = components(links)
    placed = shared.where("size > 2").join(known, "id", "left").select("token", "id", "n", "at", F.coalesce("component", "id").alias("component"))
    middle = centres.where("size > 2").select("token", F.col("id").alias("centre"), F.struct("id", "n", "at").alias("c")).join(known.withColumnRenamed("id", "centre"), "centre", "left").select("token", "c", F.coalesce("component", "centre").alias("middle"))
    placed = written(placed.join(middle, "token").where(F.struct("id", "n", "at") != F.col("c")).drop("c"))
    lists = placed.where("component <> middle").select("token").distinct()
    every = written(placed.join(lists, "token", "left_semi").join(nodes.select("id", "parities"), "id"))
    apart = every.where("component <> middle")
    second = _meeting(apart, every, percent).where(
        (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.middle")) | (F.col("a.id") < F.col("b.id"))) & _may_link("a", "b", percent) & _differ_little("a", "b", percent)
    )
    ordered = F.col("a.id") < F.col("b.id")
    second = second.select(
        F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), F.when(ordered, F.col("a.n")).otherwise(F.col("b.n")).cast("long").alias("n_a"), F.when(ordered, F.col("b.n")).otherwise(F.col("a.n")).cast("long").alias("n_b")
    )
    # A pair comes once for each prefix shingle it shares, so their number bounds what it can share:
    # beyond them, a common shingle lies outside the prefix that ends first.
    shares = second.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    rest = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    second = shares.where((100 + percent) * (F.col("shared") + F.greatest(rest("n_a"), rest("n_b"))) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    # What was verified against a centre of one shingle need not be again for another.
    second = second.join(first, ["a", "b"], "left_anti")
    links = links.union(_verify(second, nodes, ones, width, percent)).union(copies.select(F.col("id").alias("a"), F.col("node").alias("b")))
    found = components(links)
    return rows.select("id", "n").join(found, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of the least id of each component, with all their columns, whatever their names.

    Rows without an id stay, as do null, empty and blank texts, which link with nothing.
    Repeated rows are rows of one id and stay or go together; an empty table stays empty.
    """
    groups = jaccard_components(docs, width, percent, text_col, id_col)
    out = groups.where(F.col(id_col) != F.col("component_id")).select(id_col)
    return _semi(docs, out, "left_anti", id_col)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
