"""How far a language's sources differ in their words.

A text's bytes are lowered and cleared of separators by one translate table, split, and
counted; a task sums the counts by language, source and term. Shares of sources are then
compared by a chi-square distance in whole numbers, for pairs of sources and for a source's
terms against its language.

A pair's distance is a sum over all kept terms, but most terms are missing in most sources
and then have a share that is the source's alone. So the sum is taken as if the other source
had no term, from how many terms have which share, which needs no term at all; only terms
that both sources hold correct it, and those corrections are summed in matrices of blocks
of sources inside the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.joins import join_counted
from tidemark.llm.lineage import kept, small_batches

#: Documents of a language that a kept term occurs in at least; ranks of a source's terms.
DOCUMENTS, RANKS = 3, 200
#: What shares are counted in.
UNIT = 1_000_000_000
#: Counts that a task holds before it hands them on.
HELD = 300_000
#: Sources of a block, and matrices of pairs of blocks that a task holds.
BLOCK, CELLS = 256, 64
#: Letters stay, A-Z lowered, and so do all bytes beyond ASCII; the rest parts terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """A text's terms in order, from its UTF-8 bytes."""
    return text.translate(TABLE).split()


def _counted(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that sums counts and hands them on when it holds more than ``most``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "docs", "count"]
        occurrences: dict[tuple, dict[bytes, int]] = {}
        documents: dict[tuple, Counter] = {}
        rows: Counter = Counter()

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in rows.items():
                counts, docs = occurrences[lang, source], documents[lang, source]
                size = len(counts) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), pa.array([None, *counts], pa.binary()),
                    pa.array([n, *(docs[t] for t in counts)], pa.int64()), pa.array([0, *counts.values()], pa.int64()),
                ], names)
            occurrences.clear(), documents.clear(), rows.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = lang, source
                if key not in rows:
                    occurrences[key], documents[key] = {}, Counter()
                rows[key] += 1
                own, total = Counter(words(text)), occurrences[key]
                held -= len(total)
                for term, n in own.items():
                    total[term] = total.get(term, 0) + n
                held += len(total)
                documents[key].update(own.keys())
                if held > most:
                    yield from handed()
                    held = 0
        yield from handed()

    return counted


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, count): how often a term occurs in a group, and in how many documents.

    A row without a term stands for each group itself, with its documents, so a group without
    terms is there too. Nulls count as ''.
    """
    small_batches(docs.sparkSession)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")]
    rows = docs.select(cells[0].alias("lang"), cells[1].alias("source"), cells[2].cast("binary").alias("text"))
    counted = rows.mapInArrow(_counted(HELD), "lang string, source string, term binary, docs long, count long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))


def _share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)); decimals, as a corpus' counts times UNIT outgrow a long."""
    return F.expr(f"1 + cast({UNIT} as decimal(10, 0)) * (cast({count} as decimal(20, 0)) + 1) div cast(greatest({total} + terms, 1) as decimal(20, 0))")


def _distance(p: str, q: str) -> str:
    """Shares are at most UNIT + 1, so their differences' squares fit in a long."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _corrections(block: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function for sums over terms of what two sources that both hold a term differ from each holding it alone."""

    def corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, a, b), cell in sums.items():
                i, j = np.nonzero(cell)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(i)), pa.array(i + a * block), pa.array(j + b * block), pa.array(cell[i, j])], ["lang", "s", "r", "value"])
            sums.clear()

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            sides = []
            for column in (batch.column(3), batch.column(4)):
                ends = np.cumsum(column.value_lengths().to_numpy())
                sides.append((np.concatenate(([0], ends)), *(f.to_numpy() for f in column.flatten().flatten())))
            (at, place, own, none), (bt, b_place, b_own, b_none) = sides
            for row, (lang, a, b) in enumerate(keys):
                x, y = slice(at[row], at[row + 1]), slice(bt[row], bt[row + 1])
                p, q = np.concatenate((own[x], none[x]))[:, None], np.concatenate((b_own[y], b_none[y]))[None]
                f = (p - q) ** 2 // q
                m, n = at[row + 1] - at[row], bt[row + 1] - bt[row]
                if (lang, a, b) not in sums:
                    if len(sums) >= most:
                        yield from handed()
                    sums[lang, a, b] = np.zeros((block, block), np.int64)
                sums[lang, a, b][np.ix_(place[x] - a * block, b_place[y] - b * block)] += f[:m, :n] - f[:m, n:] - f[m:, :n] + f[m:, n:]
        yield from handed()

    return corrected


def _pairs(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, s, r, value) for all pairs of different sources of a language, by number."""
    # How many terms of a source have which share, those it lacks included.
    lacking = totals.select("lang", "place", "none", "sources", F.col("none").alias("p"), (F.col("terms") - F.col("own_terms")).alias("k"))
    spread = shares.groupBy("lang", "place", "none", "sources", "p").agg(F.count("*").alias("k")).unionByName(lacking)
    blocks = totals.groupBy("lang", "block").agg(F.collect_list(F.struct(F.col("place").alias("other"), F.col("none").alias("other_none"))).alias("others"))
    alone = spread.withColumn("block", F.explode(F.expr(f"sequence(0, cast((sources - 1) div {BLOCK} as int))")))
    alone = join_counted(alone, blocks, ["lang", "block"], "p").select("lang", "place", "p", "none", "k", F.inline("others")).where("place <> other")
    alone = alone.select("lang", F.expr(f"""inline(array(
        named_struct('s', place, 'r', other, 'value', k * {_distance('p', 'other_none')}),
        named_struct('s', other, 'r', place, 'value', k * ({_distance('other_none', 'p')} - {_distance('other_none', 'none')}))))"""))
    # A term has at most BLOCK sources in a row, and one row for each block of its sources.
    rows = shares.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("place", "p", "none")).alias("held"))
    both = rows.select("lang", "term", F.col("block").alias("a"), F.col("held").alias("a_held")).join(rows.select("lang", "term", F.col("block").alias("b"), F.col("held").alias("b_held")), ["lang", "term"])
    both = both.select("lang", "a", "b", "a_held", "b_held").mapInArrow(_corrections(BLOCK, CELLS), "lang string, s long, r long, value long").where("s <> r")
    return alone.unionByName(both).groupBy("lang", "s", "r").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets the sources of a language apart.

    Terms are runs of letters and of all characters beyond ASCII, A-Z lowered. A language
    keeps those in at least ``documents`` of its documents. Part `pair` has each other
    source of the language with the distance from its shares, part `term` the ``ranks``
    terms of the source that exceed the language's share by the greatest distances; equal
    values rank by item in UTF-8 order.

    Null language, source or text count as ''. Texts without terms count as documents
    of their group alone; a group without kept terms has pairs, but no terms; a source that
    is alone in its language has no pairs. Every row is a document, repeated ones too.
    Texts are read whole, one in memory at a time beside a batch. An empty table gives no
    rows. Only the three columns are read, so further ones do not matter.
    """
    counts = kept(term_counts(docs))
    of_term = Window.partitionBy("lang", "term")
    used = counts.where("term is not null").select(
        "lang", "source", "term", F.col("count").alias("n"), F.sum("docs").over(of_term).alias("in_docs"),
        F.sum("count").over(of_term).alias("lang_n"), (F.row_number().over(of_term.orderBy("source")) == 1).cast("long").alias("head"),
    )
    used = kept(used.where(F.col("in_docs") >= documents).drop("in_docs"))
    groups = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"), F.sum("head").alias("heads"))
    totals = counts.where("term is null").select("lang", "source").join(groups, ["lang", "source"], "left").na.fill(0)
    # A row for each source: small beside the documents, whatever the language.
    of_lang = Window.partitionBy("lang")
    totals = totals.select("lang", "source", "total", "own_terms", F.sum("heads").over(of_lang).alias("terms"), F.sum("total").over(of_lang).alias("lang_total"), F.count("*").over(of_lang).alias("sources"), (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("place"))
    totals = kept(totals.withColumn("none", _share("0", "total")).withColumn("block", F.expr(f"cast(place div {BLOCK} as int)")))
    shares = join_counted(used, totals, ["lang", "source"], "term").withColumn("p", _share("n", "total")).withColumn("q", _share("lang_n", "lang_total"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_distance("p", "q")).alias("value"))
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(of_group)).where(F.col("rank") <= ranks)
    names = totals.select("lang", "place", "source")
    pairs = join_counted(_pairs(shares, totals), names.withColumnRenamed("place", "s"), ["lang", "s"], "r")
    pairs = join_counted(pairs, names.select("lang", F.col("place").alias("r"), F.col("source").alias("item")), ["lang", "r"], "s")
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(of_group))
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL for the same rows, over all terms of all groups.
OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), words AS (SELECT doc, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
dense AS (
  SELECT lang, source, term, lang_n, coalesce(n, 0) AS n,
         sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS terms
  FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (total + terms) AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 1)) // (sum(n) OVER (PARTITION BY lang) + terms) AS BIGINT) AS q
  FROM dense
), pairs AS (
  SELECT s.lang, s.source, r.source AS item, sum((s.p - r.p) * (s.p - r.p) // r.p) AS value
  FROM shares s JOIN shares r ON s.lang = r.lang AND s.term = r.term AND s.source <> r.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM all_pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
