"""Near-duplicate vectors by groups that meet in turn, pruned by pivots.

Unit vectors link when their cosine reaches ``least``. Rows are put by their nearest of a
few pivots in groups of bounded size, written once. Groups are sent to all tasks one after
the other, and the rows of this group and of later ones are read past it in a stream: no
vector is shuffled for a comparison, so the disk holds the vectors twice, however many groups
there are, and a third time only if very many vectors have several rows. Cells of rows whose pivots are too far apart for any link are not read.

Within a task the group lies in tiles around pivots of its own. By the triangle inequality of
angles a row meets a tile only if its angle to the tile's pivot is within the rows' angles,
widened by the angle of ``least``. What is left is bounded by the cosine of a short projection
and the product of the rests' lengths; only pairs that this bound lets through are decided, in
double precision. A pair of one group is counted where its later row is read, so each pair
is counted once, and tasks give counts and a linked id, never pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.joins import join_counted
from tidemark.llm.lineage import kept, shared_folder, small_batches

LEAST = 0.95
#: Rows and bytes of a group, which the driver and each Python worker hold once.
CHUNK, CHUNK_BYTES = 196_608, 48 << 20
#: Pivots by which rows are put in groups; pivots of a group at most, and rows of the group for each.
CELLS, PIVOTS, PER_PIVOT = 256, 2_048, 96
#: Rows and bytes that are read past a group at once; rows of a tile, and its pairs that are looked at together.
ROWS, ROWS_BYTES, TILE, PAIRS = 16_384, 16 << 20, 64, 1 << 18
#: Products that are held at once; values of vectors whose pairs are decided one by one.
PRODUCTS, VALUES = 8 << 20, 1 << 20
#: Files that a group is written to by different tasks at most.
FILES = 8
FOUND = "id long, links long, least long"


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rough(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    x = (x / np.abs(x).max(1, keepdims=True)).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def slack(dim: int) -> float:
    """Room for rounding in a product of two rough unit vectors."""
    return 1e-5 + 2e-7 * dim


def projection(dim: int) -> np.ndarray:
    """Fixed orthonormal columns, three eighths as many as there are dimensions: on vectors without structure hardly a pair gets through."""
    return np.linalg.qr(np.random.default_rng(11).normal(size=(dim, max(1, 3 * dim // 8))))[0].astype(np.float32)


def shortened(units: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """The projection and the length of the rest: products of these are no less than those of the units."""
    part = units @ onto
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", part, part)) + np.float32(slack(units.shape[1])))
    return np.hstack([part, rest[:, None]])


def matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """The vectors of a binary column, not copied."""
    if not len(column):
        return np.empty((0, dim), kind)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], kind, len(column) * dim, at).reshape(-1, dim)


class Forest:
    """Least members of groups, by joining roots."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            up = p[p[at]]
            if (up == p[at]).all():
                return up
            p[at] = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b = ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def reach(angles: np.ndarray, least: float, dim: int) -> np.ndarray:
    """The least product with a pivot of what may link with rows at these angles to it at most; below -1 if all may."""
    wide = angles + np.arccos(np.clip(least, -1, 1))
    return np.where(wide < np.pi, np.cos(np.minimum(wide, np.pi)) - slack(dim), -2.0)


def tiled(ids: np.ndarray, weight: np.ndarray, key: np.ndarray, x: np.ndarray, least: float) -> dict:
    """A group in tiles, each around a pivot: its rows' order, its pivot, and the products with it of rows that may link with one of its rows."""
    n, dim = x.shape
    units = rough(x)
    pivots = units[np.sort(np.random.default_rng(n).permutation(n)[: max(1, min(PIVOTS, n // PER_PIVOT))])]
    cell, near = np.empty(n, np.int64), np.empty(n, np.float32)
    step = max(1, PRODUCTS // len(pivots))
    for a in range(0, n, step):
        product = units[a : a + step] @ pivots.T
        cell[a : a + step] = product.argmax(1)
        near[a : a + step] = product.max(1)
    del units, product
    order = np.lexsort((near, cell))
    cell, near = cell[order], near[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    starts = np.concatenate([np.arange(a, b, TILE) for a, b in zip(first, [*first[1:], n], strict=True)])
    ends = np.r_[starts[1:], n]
    far, close = (np.arccos(np.clip(v, -1, 1)) for v in (near[starts] - slack(dim), near[ends - 1] + slack(dim)))
    # Rows that lie nearer to the pivot than the tile's nearest row by more than the angle of a link can't link either.
    inner = close - np.arccos(np.clip(least, -1, 1))
    high = np.where(inner > 0, np.cos(np.maximum(inner, 0)) + slack(dim), 2.0)
    return {"ids": ids[order], "weight": weight[order], "key": key[order], "x": x[order], "pivots": pivots, "tiles": (starts, ends, cell[starts], reach(far, least, dim), high)}


def meet(own: dict, least: float, ids: np.ndarray, weight: np.ndarray, key: np.ndarray, y: np.ndarray, links: np.ndarray, forest: Forest) -> np.ndarray:
    """Adds the links that rows read past a group have with it; gives those rows' own.

    Weights of linked rows are added up. Row j meets only rows of the group with a lesser
    key. In ``forest`` it stands behind the group's rows.
    """
    n, dim, room = len(own["ids"]), y.shape[1], slack(y.shape[1])
    if "short" not in own:
        own["onto"] = projection(dim)
        own["short"] = np.vstack([shortened(rough(own["x"][a : a + ROWS]), own["onto"]) for a in range(0, n, ROWS)])
    units = rough(y)
    short, theirs = shortened(units, own["onto"]), np.zeros(len(y), np.int64)
    few, bound = max(1, VALUES // dim), np.float32(least - 2 * room)
    starts, ends, pivot, low, high = own["tiles"]
    step = max(1, PRODUCTS // len(y))

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), bool)
        for a in range(0, len(i), few):
            out[a : a + few] = np.einsum("ij,ij->i", unit(own["x"][i[a : a + few]]), unit(y[j[a : a + few]])) >= least
        return out

    for t, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if t == 0 or pivot[t] >= base + step:
            base = pivot[t]
            products = own["pivots"][base : base + step] @ units.T
        at = products[pivot[t] - base]
        visit = np.flatnonzero(at >= low[t] if high[t] > 1 + room else (at >= low[t]) & (at <= high[t]))
        for s in range(0, len(visit), PAIRS // TILE):
            j = visit[s : s + PAIRS // TILE]
            near = short.take(j, 0) @ own["short"][a:b].T
            if near.max() < bound:
                continue
            q, p = np.divmod(np.flatnonzero(near >= bound), b - a)
            if len(p) <= few:
                p, q = p + a, j[q]
                stays = own["key"][p] < key[q]
                p, q = p[stays], q[stays]
                stays = linked(p, q)
                p, q = p[stays], q[stays]
                if len(p):
                    np.add.at(links, p, weight[q])
                    np.add.at(theirs, q, own["weight"][p])
                    forest.join(p, q + n)
                continue
            product = rough(own["x"][a:b]) @ units[j].T
            hit = product >= least + room
            p, q = np.divmod(np.flatnonzero(np.abs(product - least) < 2 * room), len(j))
            hit[p, q] = linked(p + a, j[q])
            hit &= own["key"][a:b, None] < key[None, j]
            # Exact, as sums of weights stay below 2 ** 53.
            times = hit.astype(np.float64)
            links[a:b] += (times @ weight[j]).astype(np.int64)
            theirs[j] += (own["weight"][a:b] @ times).astype(np.int64)
            p, q = np.nonzero(hit & (forest.roots(np.arange(a, b))[:, None] != forest.roots(j + n)[None]))
            if len(p):
                forest.join(p + a, j[q] + n)
    return theirs


def near_duplicates(vectors: DataFrame, least: float = LEAST, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id and kept.

    Null and zero vectors, and those with null or non-finite components, link with
    nothing; nor do vectors of different lengths. Equal vectors (of equal 128 bits of hash) are
    one node with a weight. Rows that share id and vector are one vector; repeated rows give
    repeated rows. Only id and vector are read. Rows without an id are left out. Whether a pair
    at the very edge of ``least`` links is what double precision makes of its product.
    """
    small_batches(vectors.sparkSession)
    single = "array<float>" in vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("v")).where("id is not null")
    clean = rows.where("v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    clean = clean.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    dims = [r[0] for r in clean.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    if not dims:
        return vectors.select(F.col(id_col).cast("long").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"), F.lit(True).alias("kept")).where(F.col(id_col).isNotNull())
    # Vectors of more than one row, without the vectors themselves.
    keys = clean.select("id", "h", "g")
    many = kept(keys.groupBy("h", "g").agg(F.min("id").alias("node"), F.count_distinct("id").alias("weight"), F.count("*").alias("n")).where("n > 1"))
    copies = kept(join_counted(keys, many.where("weight > 1").select("h", "g", "node", "weight"), ["h", "g"], "id").select("id", "node", "weight").distinct())
    nodes = join_counted(clean, many, ["h", "g"], "id", "left").where("node is null or id = node").select("id", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), "v", "h", "g", (F.coalesce("n", F.lit(1)) > F.coalesce("weight", F.lit(1))).alias("again"))
    if not many.where("n > weight").isEmpty():
        nodes = nodes.where("not again").unionByName(nodes.where("again").dropDuplicates(["h", "g"]))
    found = None
    for d in dims:
        part = _links(clean.where(F.size("v") == d), nodes.where(F.size("v") == d).select("id", "weight", "v"), d, "<f4" if single else "<f8", least, chunk)
        found = part if found is None else found.unionByName(part)
    counts = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "node")
    edges = found.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).union(copies.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")))
    group = components(edges)
    # A copy links with the other copies of its node and with all that the node links with.
    own = counts.join(copies.select("node").distinct(), "node", "left_anti").select(F.col("node").alias("id"), "links")
    degree = copies.join(counts, "node", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")).union(own).groupBy("id").agg(F.sum("links").alias("n_links"))
    out = rows.select("id").join(degree, "id", "left").join(group, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest that is left."""
    product = pivots @ pivots.T
    left, order = np.ones(len(pivots), bool), [0]
    left[0] = False
    while left.any():
        order.append(int(np.where(left, product[order[-1]], -2).argmax()))
        left[order[-1]] = False
    return order


def _links(clean: DataFrame, nodes: DataFrame, dim: int, kind: str, least: float, chunk: int) -> DataFrame:
    """(id, links, least): partial counts with one id of the row's component; only rows with links."""
    spark, wide = nodes.sparkSession, np.dtype(kind).itemsize * dim
    chunk, rows = max(1, min(chunk, CHUNK_BYTES // wide)), max(1, min(ROWS, ROWS_BYTES // wide))
    folder = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(at)
    pivots = rough(np.array([r.v for r in clean.orderBy(F.xxhash64("id"), "id").limit(CELLS).collect()]))

    def cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = batch.column("v").flatten().to_numpy().reshape(-1, dim)
        product = rough(x) @ pivots.T
        return x, product.argmax(1).astype(np.int32), product.max(1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(cells(batch)[1], minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(total)], ["cell", "n"])

    # A cell of more rows than a group may have is dealt to several; small ones share a group with those beside them.
    sizes = {r.cell: r.n for r in clean.select("v").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    first, parts, group, room = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64), 0, chunk
    for c in _chain(pivots):
        n = sizes.get(c, 0)
        if n > room:
            group, room = group + (room < chunk), chunk
        first[c], parts[c] = group, max(1, -(-n // chunk))
        if n > chunk:
            group += int(parts[c])
        else:
            room -= n

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cell, near = cells(batch)
            mixed = batch.column("id").to_numpy() * np.int64(0x1E3779B97F4A7C15) >> 33
            flat = np.ascontiguousarray(x, kind)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(wide)
            v = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("weight"), v, pa.array(cell), pa.array(near), pa.array((first[cell] + mixed % parts[cell]).astype(np.int32))], ["id", "weight", "v", "cell", "near", "grp"])

    columns = "id long, weight long, v binary, cell int, near float, grp int"
    placed = nodes.mapInArrow(place, columns).repartition("grp", F.pmod(F.xxhash64("id"), F.lit(FILES)))
    placed.withColumn("key", F.monotonically_increasing_id()).write.partitionBy("grp").parquet(f"{folder}/rows")
    store = spark.read.schema("id long, weight long, v binary, cell int, near float, key long, grp int").parquet(f"{folder}/rows")
    # One row for each group and cell: how far its rows lie from the cell's pivot at most.
    extent = store.groupBy("grp", "cell").agg(F.min("near").alias("near")).collect()
    widest = np.full(len(pivots), -1.0)
    members: dict[int, list[int]] = {}
    for r in extent:
        widest[r.cell] = max(widest[r.cell], np.arccos(np.clip(r.near - slack(dim), -1, 1)))
        members.setdefault(r.grp, []).append(r.cell)
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) - slack(dim) ** 0.5
    may = apart <= widest[:, None] + widest[None] + np.arccos(np.clip(least, -1, 1))
    for g in sorted(members):
        there = sorted(c for c in np.flatnonzero(may[members[g]].any(0) & (widest >= 0)).tolist())
        past = store.where((F.col("grp") >= g) & F.col("cell").isin(there))
        _compare(store.where(F.col("grp") == g), past, g, dim, kind, least, rows, f"{folder}/links")
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows"), True)
    return spark.read.schema(FOUND).parquet(f"{folder}/links")


def _compare(mine: DataFrame, past: DataFrame, group: int, dim: int, kind: str, least: float, rows: int, to: str) -> None:
    """Writes what a group's rows have with its later ones and with those of other groups."""
    context = mine.sparkSession.sparkContext
    table = mine.select("id", "weight", "key", "v").toArrow().combine_chunks()
    ids, weight, key = (table[c].to_numpy() for c in ("id", "weight", "key"))
    tiles = tiled(ids, weight, key, matrix(table["v"].combine_chunks(), dim, kind), least)
    del table, ids, weight, key
    held = context.broadcast(tiles)
    del tiles

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            if some and sum(b.num_rows for b in some) + batch.num_rows > rows:
                yield pa.Table.from_batches(some).combine_chunks()
                some = []
            some.append(batch)
        if some:
            yield pa.Table.from_batches(some).combine_chunks()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        n = len(own["ids"])
        links, forest = np.zeros(n, np.int64), Forest(n + rows)

        def found(ids: np.ndarray, links: np.ndarray, start: int) -> pa.RecordBatch:
            at = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(own["ids"][forest.roots(at + start)])], ["id", "links", "least"])

        for table in gathered(batches):
            for a in range(0, table.num_rows, rows):
                part = table.slice(a, rows)
                ids, weight, key, of = (part[c].to_numpy() for c in ("id", "weight", "key", "grp"))
                y = matrix(part["v"].combine_chunks(), dim, kind)
                theirs = meet(own, least, ids, weight, np.where(of == group, key, np.iinfo(np.int64).max), y, links, forest)
                yield found(ids, theirs, n)
                forest.parent[n:] = np.arange(n, n + rows)
        yield found(own["ids"], links, 0)

    met = past.select("id", "weight", "v", "key", "grp").mapInArrow(compare, FOUND)
    met.groupBy("id", "least").agg(F.sum("links").alias("links")).select("id", "links", "least").write.mode("append").parquet(to)
    held.destroy()


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
