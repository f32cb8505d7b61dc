"""Language of pages and documents by fusing evidence.

A text's likelihoods come from hashed character n-grams of its words, learned from a bounded
sample of documents of each known language. They are fused with the language that a page
declares, with the suffix of its address and with a prior of its host. How far a declared
language or a suffix can be believed, and the priors, are counts of expected languages by
grouped aggregation over all rows. A host's prior is smoothed towards its domain's, that
towards all rows'; each row's own share is taken out of the counts that judge it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.joins import join_counted
from tidemark.llm.lineage import kept, small_batches
from tidemark.llm.pages import main_text
from tidemark.llm.training import fold
from tidemark.llm.wordcache import tidy

#: Most documents learned from in each language, n-gram sizes and hash buckets.
SAMPLE, GRAMS, BUCKETS = 1_000, (1, 2, 3), 1 << 14
#: Rows of sampled ids, and numbers in the tables by key, that may be broadcast. Beyond, the same joins shuffle.
FEW, BROADCAST_NUMBERS = 2_000_000, 1_000_000
#: n-grams overlap, so a text counts for a part of their sum.
TEMPER = 0.2
#: Pseudo-counts of the smoothed tables, host towards domain, domain towards all.
DECLARED_PRIOR, SUFFIX_PRIOR, HOST_PRIOR, DOMAIN_PRIOR = 1.0, 5.0, 4.0, 8.0
#: Words kept by a task, and numbers of theirs: fewer words where there are more languages.
CACHE_WORDS, CACHE_NUMBERS = 200_000, 12_800_000
WORD = re.compile(r"[^\W\d_]+")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.IGNORECASE)
META = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]+)", re.IGNORECASE)
HOST = re.compile(r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def buckets_of(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[i : i + n].encode("utf-8", "replace"), n) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]


class Likelihoods:
    """Log-likelihoods of texts in each language, kept by word."""

    def __init__(self, table: np.ndarray):
        # Only differences between languages matter.
        self.table = table - table.mean(1, keepdims=True)
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows, self.n = np.zeros((1024, self.table.shape[1])), 0

    def row(self, word: str) -> int:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        found = buckets_of(word)
        self.rows[self.n] = self.table[found].sum(0)
        self.at[word] = self.n
        self.n += 1
        return self.n - 1

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if not words:
            return np.zeros(self.table.shape[1])
        if self.n > min(CACHE_WORDS, CACHE_NUMBERS // len(self.table[0])):
            self.reset()
        found = list(map(self.at.get, words))
        if None in found:
            found = [self.at.get(w, -1) for w in words]
            found = [i if i >= 0 else self.at[w] if w in self.at else self.row(w) for i, w in zip(found, words, strict=True)]
        return TEMPER * self.rows[np.asarray(found)].sum(0)


def language(label: Column) -> Column:
    """A label's language, lowered: all before the first - or _, so of "en-US" and "en_GB" "en"; null if that is nothing."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(label.cast("string"))), "^[^-_]*", 0), F.lit(""))


def learn(docs: DataFrame, lang_col: str, folds: int, held: int, sample: int, text_col: str, id_col: str) -> tuple[list[str], np.ndarray]:
    """Every language that occurs and each bucket's log-probability in it.

    Learned from ``sample`` texts of each language in order of a hash of the id, so a rare
    language has as many as there are.
    """
    rows = docs.select(F.col(id_col).alias("id"), language(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = rows.where(F.col("lang").isNotNull() & (fold(F.col("id"), folds) != held))
    names = [r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    # A ranked limit below the shuffle, as long as the sample is within Spark's bound for it.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = known.select("id", "lang").where(F.col("id").isNotNull()).distinct().withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank")
    rows = known.join(F.broadcast(ids) if len(names) * sample <= FEW else ids, ["id", "lang"])

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [b for w in WORD.findall((text or "").lower()) for b in buckets_of(w)]
                total[lang] = total.get(lang, 0) + np.bincount(np.asarray(found, np.int64), minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    # At most BUCKETS rows a language, whatever the sample.
    found = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts, place = np.full((BUCKETS, len(names)), 0.5), {name: i for i, name in enumerate(names)}
    for lang, bucket, n in zip(*(found[c].to_pylist() for c in ("lang", "bucket", "n")), strict=True):
        counts[bucket, place[lang]] += n
    return names, np.log(counts / counts.sum(0, keepdims=True))


def evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(kind, id, host, domain, suffix, declared, likelihoods) of rows (kind, id, url, content, host)."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Likelihoods(shared.value)
        for batch in batches:
            kinds, urls, contents, hosts = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            host, domain, suffix, declared, made = [], [], [], [], []
            for kind, url, content, given in zip(kinds, urls, contents, hosts, strict=True):
                content = content or ""
                found = HOST.match(url or "")
                name = found[1].lower().rstrip(".") if found else given
                parts = name.split(".") if found else []
                host.append(name)
                domain.append(".".join(parts[-2:]) if parts else name)
                suffix.append(parts[-1] if len(parts) > 1 and not parts[-1].isdigit() else None)
                said = (DECLARED.search(content) or META.search(content)) if kind == "page" else None
                declared.append(said[1].lower() if said else None)
                made.append(model.of(main_text(content) if kind == "page" else content))
            strings = [pa.array(x, pa.string()) for x in (host, domain, suffix, declared)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *strings, pa.array([m.tolist() for m in made], pa.list_(pa.float64()))], ["kind", "id", "host", "domain", "suffix", "declared", "likelihoods"])

    schema = "kind string, id long, host string, domain string, suffix string, declared string, likelihoods array<double>"
    return rows.select("kind", "id", "url", "content", "host").mapInArrow(run, schema)


def normal(logs: Column) -> Column:
    """Probabilities from an array of logarithms."""
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def summed(column: str, n: int) -> list[Column]:
    return [F.sum(F.col(column)[i]) for i in range(n)]


def table_by(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The expected number of rows of each language for every value of a key, one row each."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*summed("expected", n)).alias(f"{key}_counts"))


def fuse(rows: DataFrame, names: list[str]) -> DataFrame:
    """Add lang, probability and text_lang to the rows of ``evidence``.

    Joins are with one row for each key: broadcast if those have been counted as few, else
    salted, so neither a key that most rows share nor the rows without one meet in one task.
    """
    n = len(names)
    # Equal priors first: what the texts alone expect.
    rows = kept(rows.withColumn("expected", normal(F.col("likelihoods"))))
    total = rows.agg(*(F.coalesce(c, F.lit(0.0)) for c in summed("expected", n)), F.count_distinct("declared"), F.count_distinct("suffix")).first()
    overall, kinds = list(total[:n]), (total[n], total[n + 1])
    share = F.array(*(F.lit((x + 1) / (sum(overall) + n)) for x in overall))
    for key in ("domain", "host", "declared", "suffix"):
        rows = join_counted(rows, table_by(rows, key, n), [key], "id", "left", BROADCAST_NUMBERS // n)

    def without(counts: str) -> Column:
        """Counts of a key without the row's own share."""
        own = F.zip_with(F.col(counts), F.col("expected"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.coalesce(own, F.array(*[F.lit(0.0)] * n))

    def smooth(counts: Column, towards: Column, weight: float) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, towards, lambda c, t: (c + weight * t) / (size + weight))

    def given(key: str, weight: float, values: int) -> Column:
        """log P(value | language), flat where the row has no such value."""
        seen = F.array(*(F.lit(float(x)) for x in overall))
        odds = F.zip_with(without(f"{key}_counts"), seen, lambda c, t: F.log((c + weight / max(1, values)) / (t + weight)))
        return F.when(F.col(key).isNull(), F.array(*[F.lit(0.0)] * n)).otherwise(odds)

    rows = rows.withColumn("of_domain", smooth(without("domain_counts"), share, DOMAIN_PRIOR))
    rows = rows.withColumn("prior", smooth(without("host_counts"), F.col("of_domain"), HOST_PRIOR))
    rows = rows.withColumn("said", given("declared", DECLARED_PRIOR, kinds[0])).withColumn("ends", given("suffix", SUFFIX_PRIOR, kinds[1]))
    logs = F.transform(F.arrays_zip("likelihoods", "prior", "said", "ends"), lambda x: x["likelihoods"] + F.log(x["prior"]) + x["said"] + x["ends"])
    rows = rows.withColumn("fused", normal(logs))
    lang = F.array(*map(F.lit, names))
    return rows.select(
        "kind", "id", F.get(lang, F.array_position("fused", F.array_max("fused")).cast("int") - 1).alias("lang"), F.array_max("fused").alias("probability"),
        F.when(F.array_max("likelihoods") > F.array_min("likelihoods"), F.get(lang, F.array_position("likelihoods", F.array_max("likelihoods")).cast("int") - 1)).alias("text_lang"), "declared", "host",
    )


def identify_languages(docs: DataFrame, pages: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE) -> DataFrame:
    """One row per document and per page: its language, the probability and the evidence.

    Documents give (doc_id, text, source), the source standing for a host; their lang column
    is learned from outside the held-out fold and never read for a row's own answer. Pages
    give (page_id, url, html). Empty or null texts are decided by the other evidence, a
    row without any by the overall shares. Repeated rows give repeated rows; very long texts
    are read whole. Labels count by their language, without region or script. If no document
    has a language, lang is null and the probability 0. Empty tables give no rows; further
    columns are not read.
    """
    small_batches(docs.sparkSession)
    names, table = learn(docs, "lang", folds, held, sample, "text", "doc_id")
    if not names:
        none = F.lit(None).cast("string")
        rows = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id")).unionByName(pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id")))
        out = rows.withColumns({"lang": none, "probability": F.lit(0.0), "text_lang": none, "declared": none, "host": none})
    else:
        both = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.lit(None).cast("string").alias("url"), F.col("text").cast("string").alias("content"), F.col("source").cast("string").alias("host")).unionByName(
            pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("content"), F.lit(None).cast("string").alias("host"))
        )
        out = fuse(evidence(both, table), names)
    return out.select(F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), "lang", "probability", "text_lang", "declared", "host")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet"))
