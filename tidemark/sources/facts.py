"""Stored facts: records of many arrivals merged into Parquet by day, safe to repeat.

A store is a folder with data files by version and day, and manifests that say in which
version each day is. A merge writes new files for the days it touches and then one manifest,
whose single file appears in one rename: until then readers see the old state, after it the
new one, and files of a merge that broke off are never read. Batches are numbered by their
source, as a stream numbers its micro-batches; a batch that is already in is not merged again.
There is one writer at a time.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import resolve as R

FACTS = "id {id}, item_code string, fields map<string, struct<value: string, revised_at: long>>, v string, day date"
MANIFEST = "batch long, counts map<string, long>, days array<struct<day: date, v: string>>, version long"
TIME, KIND = "created_at", "transaction_type"
OUTCOMES = ("inserted", "enriched", "unchanged", "rejected")


def _files(spark: SparkSession, path: str):
    """(file system, path) of the cluster's store that a path lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, folder: str) -> tuple[int, int, dict[date | None, str], dict[str, int]]:
    """(version, batch, version of each day, counts of the batch) of the newest manifest; -1 for an empty store."""
    files, path = _files(spark, f"{folder}/manifest")
    if not files.exists(path):
        return -1, -1, {}, {}
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    newest = rows.agg(F.max("version")).first()[0]
    if newest is None:
        return -1, -1, {}, {}
    row = rows.where(F.col("version") == newest).first()
    return newest, row.batch, {d.day: d.v for d in row.days}, row.counts


def facts(spark: SparkSession, folder: str, start: date | None = None, end: date | None = None, id_type: str = "long") -> DataFrame:
    """(id, item_code, fields, day) as the newest manifest has them; only files of days in [start, end) are read."""
    days = manifest(spark, folder)[2]
    if start is not None or end is not None:
        days = {d: v for d, v in days.items() if d is not None and (start is None or d >= start) and (end is None or d < end)}
    return _of_days(spark, folder, days, id_type).drop("v")


def _of_days(spark: SparkSession, folder: str, days: dict[date | None, str], id_type: str) -> DataFrame:
    schema = FACTS.format(id=id_type)
    if not days:
        return spark.createDataFrame([], schema)
    paths = [f"{folder}/data/v={v}/day={d if d is not None else '__HIVE_DEFAULT_PARTITION__'}" for d, v in days.items()]
    return spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(*paths)


def _as_arrivals(held: DataFrame) -> DataFrame:
    """The log of what is stored: each field with its own revision, before anything that arrives."""
    return held.select("id", F.lit(-1).cast("long").alias("arrival"), F.explode_outer("fields").alias("field", "state")).select("id", "arrival", F.col("state.revised_at").alias("revised_at"), "field", F.col("state.value").alias("value"))


def merge(folder: str, batch: int, arrivals: DataFrame) -> dict[str, int]:
    """Merge arrivals (id, arrival, item_code, revised_at, fields) into the store; what became of them by outcome.

    Fields are resolved as in ``resolve.latest_fields`` with what is stored as the first
    arrival, and arrivals in conflict with their record's identity are rejected and kept in
    ``rejected`` of the store. A fact's day is that of its field ``created_at``, so a newer time
    moves it. Only days that hold one of the ids before or after are written anew; to find
    them the stored ids and nothing else are read. Run again, a batch gives its first counts.
    """
    spark = arrivals.sparkSession
    version, done, days, counts = manifest(spark, folder)
    if batch <= done:
        return counts if batch == done else {}
    id_type = arrivals.schema["id"].dataType.simpleString()
    attempt = f"{version + 1}-{uuid.uuid4().hex}"
    staged = f"{folder}/staged/v={attempt}"
    rows = arrivals.where("id is not null").select("id", F.col("arrival").cast("long").alias("arrival"), "item_code", F.col("revised_at").cast("long").alias("revised_at"), "fields")
    ids = rows.select("id").distinct()
    stored = _of_days(spark, folder, days, id_type)
    touched = {r.day for r in stored.select("id", "day").join(ids, "id", "left_semi").select("day").distinct().collect()}
    held = _of_days(spark, folder, {d: days[d] for d in touched}, id_type).join(ids, "id", "left_semi")

    kind = F.col("fields")[KIND]
    known = rows.select("id", "arrival", "item_code", kind.alias(KIND)).unionByName(held.select("id", F.lit(-1).cast("long").alias("arrival"), "item_code", kind["value"].alias(KIND)))
    known, aside = R.by_identity(known, ["item_code"], [KIND])
    rows.join(aside.select("id", "arrival"), ["id", "arrival"], "left_semi").write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch}")
    aside = spark.read.schema(rows.schema).parquet(f"{folder}/rejected/batch={batch}")
    log = R.field_log(rows.join(aside.select("id", "arrival"), ["id", "arrival"], "left_anti")).unionByName(_as_arrivals(held))
    seen = R.outcomes(log).where("arrival >= 0").groupBy("outcome").count().collect()
    counts = dict.fromkeys(OUTCOMES, 0) | {r.outcome: r["count"] for r in seen} | {"rejected": aside.count()}

    items = known.groupBy("id").agg(F.min_by("item_code", "arrival").alias("item_code"))
    resolved = R.latest_fields(log).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "revised_at")))).alias("fields"))
    nothing = F.expr("cast(map() as map<string, struct<value: string, revised_at: bigint>>)")
    resolved = items.join(resolved, "id", "left").withColumn("fields", F.coalesce("fields", nothing)).withColumn("day", F.to_date(F.expr(f"try_cast(fields['{TIME}'].value as timestamp)")))
    resolved.write.parquet(staged)
    resolved = spark.read.schema(resolved.schema).parquet(staged)
    touched |= {r.day for r in resolved.select("day").distinct().collect()}
    rest = _of_days(spark, folder, {d: days[d] for d in touched if d in days}, id_type).join(ids, "id", "left_anti")
    whole = rest.select("id", "item_code", "fields", "day").unionByName(resolved)
    # Large days are split over tasks, small ones of a task share it.
    whole.hint("rebalance", "day").write.partitionBy("day").parquet(f"{folder}/data/v={attempt}")
    filled = {r.day for r in spark.read.schema(FACTS.format(id=id_type)).parquet(f"{folder}/data/v={attempt}").select("day").distinct().collect()}
    days = {d: v for d, v in days.items() if d not in touched} | dict.fromkeys(filled, attempt)
    row = [(batch, counts, list(days.items()), version + 1)]
    spark.createDataFrame(row, MANIFEST).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version + 1}")
    files, path = _files(spark, staged)
    files.delete(path, True)
    return counts


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete data that the newest manifest does not name, once no reader uses older ones; how many versions went."""
    days = manifest(spark, folder)[2]
    files, path = _files(spark, f"{folder}/data")
    gone = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().removeprefix("v=") not in set(days.values())] if files.exists(path) else []
    for old in gone:
        files.delete(old, True)
    return len(gone)
