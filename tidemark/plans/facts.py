"""Queries on records that arrive again and again: resolved, merged and matched, in batches and live.

Arrivals are made by Spark from the events, four of each. The SQL follows each record from
arrival to arrival, one step after the other, while the engine aggregates, merges or streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import exact as E
from tidemark.operators import ledger as L
from tidemark.operators import resolve as R
from tidemark.plans.ledger import FIFO
from tidemark.plans.market import r6, rounded
from tidemark.session import scratch
from tidemark.sources import facts as S
from tidemark.sources import tables as T
from tidemark.streaming import stateful as V

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Each arrival's parts, in SQL that both engines run; {k} is its number, {cents} and {ts} are texts of the event.
FIELDS = {
    "created_at": ("{k} IN (0, 3)", "CASE WHEN {k} = 3 AND id % 10 = 0 THEN {later} ELSE {ts} END"),
    "money": ("(id + {k}) % 4 <> 0", "CASE WHEN (id * 7 + {k} * 3) % 5 <> 0 THEN concat({cents}, '.', {k}) END"),
    "note": ("(id + {k}) % 3 <> 1", "CASE WHEN (id + {k}) % 7 <> 0 THEN concat('n', (id * {k}) % 6) END"),
    "transaction_type": ("{k} IN (0, 2)", "CASE WHEN {k} = 2 AND id % 8 = 0 THEN 'itemMarket' WHEN {k} = 2 OR id % 6 <> 0 THEN 'trading' END"),
}
ITEM = "CASE WHEN {k} = 3 AND id % 9 = 0 THEN 'other' ELSE event_type END"
REVISION = "CASE WHEN (id + {k}) % 3 <> 0 THEN (id * ({k} + 1)) % 4 END"
ARRIVALS = 4


def _arrivals(events: DataFrame) -> DataFrame:
    """(id, arrival, item_code, revised_at, fields) of events, which may be a stream."""
    text = {"k": "k", "cents": "cents", "ts": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "later": "date_format(ts + interval 1 day, 'yyyy-MM-dd HH:mm:ss')"}
    rows = events.select(F.col("event_id").alias("id"), "event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").cast("string").alias("cents"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ARRIVALS - 1).cast("long"))))

    def entry(field: str) -> Column:
        present, value = FIELDS[field]
        return F.struct(F.lit(field).alias("field"), F.expr(value.format(**text)).cast("string").alias("value"), F.expr(present.format(**text)).alias("present"))

    entries = F.filter(F.array(*map(entry, FIELDS)), lambda e: e["present"])
    fields = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["field"], e["value"])))
    return rows.select("id", F.col("k").alias("arrival"), F.expr(ITEM.format(**text)).alias("item_code"), F.expr(REVISION.format(**text)).cast("long").alias("revised_at"), fields.alias("fields"))


def _steps() -> str:
    """CTEs of a record's state after each arrival: for each field whether it is known, its value and its revision."""
    names = range(len(FIELDS))
    text = {"cents": "cents", "ts": "ts_text", "later": "later_text"}
    parts = ["e0 AS (SELECT event_id AS id, event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS cents, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS later_text FROM events)"]
    start = ", ".join(f"false AS h{f}, CAST(NULL AS VARCHAR) AS v{f}, CAST(NULL AS BIGINT) AS r{f}, CAST(0 AS BIGINT) AS n{f}" for f in names)
    parts.append(f"s0 AS (SELECT id, event_type, cents, ts_text, later_text, {start} FROM e0)")
    kept = "id, event_type, cents, ts_text, later_text, " + ", ".join(f"outcome{k}" for k in range(ARRIVALS))
    kind = list(FIELDS).index("transaction_type")
    for k in range(ARRIVALS):
        had = "".join(f", outcome{j}" for j in range(k))
        seen = ", ".join(f"({p}) AS p{f}, ({v}) AS x{f}" for f, (p, v) in ((f, [s.format(k=k, **text) for s in spec]) for f, spec in enumerate(FIELDS.values())))
        parts.append(f"a{k} AS (SELECT *, {seen}, {REVISION.format(k=k)} AS rev, ({ITEM.format(k=k)}) <> event_type AS other FROM s{k})")
        parts.append(f"b{k} AS (SELECT *, other OR coalesce(p{kind} AND x{kind} <> v{kind}, false) AS bad FROM a{k})")
        newer = lambda f: f"(rev IS NOT NULL AND (r{f} IS NULL OR rev > r{f}))"
        takes = ", ".join(f"NOT bad AND p{f} AND (NOT h{f} OR {newer(f)} OR (v{f} IS NULL AND r{f} IS NULL AND x{f} IS NOT NULL)) AS u{f}" for f in names)
        parts.append(f"c{k} AS (SELECT *, {takes} FROM b{k})")
        after = ", ".join(f"h{f} OR u{f} AS h{f}, CASE WHEN u{f} THEN x{f} ELSE v{f} END AS v{f}, CASE WHEN u{f} THEN rev ELSE r{f} END AS r{f}, n{f} + CASE WHEN p{f} AND NOT bad THEN 1 ELSE 0 END AS n{f}" for f in names)
        outcome = f"CASE WHEN bad THEN 'rejected' WHEN {'true' if k == 0 else 'false'} THEN 'inserted' WHEN {' OR '.join(f'u{f}' for f in names)} THEN 'enriched' ELSE 'unchanged' END AS outcome{k}"
        parts.append(f"s{k + 1} AS (SELECT id, event_type, cents, ts_text, later_text{had}, {outcome}, {after} FROM c{k})")
    long = " UNION ALL ".join(f"SELECT id, event_type, '{name}' AS field, v{f} AS value, r{f} AS revised_at, n{f} AS revisions FROM s{ARRIVALS} WHERE h{f}" for f, name in enumerate(FIELDS))
    done = " UNION ALL ".join(f"SELECT id, {k} AS arrival, outcome{k} AS outcome FROM s{ARRIVALS}" for k in range(ARRIVALS))
    return ", ".join(parts) + f", resolved AS ({long}), done AS ({done})"


STEPS = _steps()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events")


def _accepted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(arrivals of one identity, those in conflict)."""
    rows = _arrivals(_events(spark, sf_dir)).withColumn("kind", F.col("fields")["transaction_type"])
    return R.by_identity(rows, ["item_code"], ["kind"])


@query("resolved_fields", f"WITH {STEPS} SELECT id, field, value, value IS NULL AS is_null, revised_at, revisions FROM resolved")
def resolved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_fields(R.field_log(_accepted(spark, sf_dir)[0]))


@query("ingest_outcomes", f"WITH {STEPS} SELECT outcome, count(*) AS n FROM done GROUP BY outcome")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = _accepted(spark, sf_dir)
    done = R.outcomes(R.field_log(good)).select("outcome").unionByName(bad.select(F.lit("rejected").alias("outcome")))
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table as a stream of its files; a pattern, as a stream takes a plain path for a folder and the table may be one file."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _run(stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends until all that has landed is read."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("live_outcomes", f"WITH {STEPS} SELECT arrival, outcome, count(*) AS n FROM done GROUP BY ALL")
def live_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _run(V.resolved_records(_arrivals(_stream(spark, sf_dir, "events"))), "outcomes")
    return done.groupBy("arrival", "outcome").agg(F.count("*").alias("n"))


@query("live_resolved_fields", f"WITH {STEPS} SELECT id, field, value, revised_at FROM resolved")
def live_resolved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _run(V.resolved_records(_arrivals(_stream(spark, sf_dir, "events"))), "resolved")
    changes = done.select("id", "arrival", F.explode("changes").alias("field", "change"))
    return changes.groupBy("id", "field").agg(F.max_by("change", "arrival").alias("last")).select("id", "field", "last.value", "last.revised_at")


def _merged(spark: SparkSession, sf_dir: str) -> tuple[str, list[tuple[int, dict[str, int]]]]:
    """A store after two batches of two arrivals each, the second given twice, and each batch's counts."""
    rows, folder = _arrivals(_events(spark, sf_dir)), scratch(spark, "facts")
    return folder, [(batch, S.merge(folder, batch, rows.where((F.col("arrival") >= 2 * batch) & (F.col("arrival") < 2 * batch + 2)))) for batch in (0, 1, 1)]


@query("merged_facts", f"WITH {STEPS}, day AS (SELECT id, CAST(value AS DATE) AS day FROM resolved WHERE field = 'created_at') SELECT id, event_type AS item_code, strftime(day, '%Y-%m-%d') AS day, field, value, revised_at FROM resolved JOIN day USING (id)")
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.facts(spark, _merged(spark, sf_dir)[0], id_type=dict(_events(spark, sf_dir).dtypes)["event_id"])
    return rows.select("id", "item_code", F.col("day").cast("string").alias("day"), F.explode("fields").alias("field", "state")).select("id", "item_code", "day", "field", "state.value", "state.revised_at")


@query("merge_counts", f"WITH {STEPS}, b AS (SELECT CAST(arrival // 2 AS BIGINT) AS batch, outcome, count(*) AS n FROM done GROUP BY ALL) SELECT run, batch, outcome, n FROM b, (VALUES (0), (1)) r(run) WHERE run <= batch")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, done = _merged(spark, sf_dir)
    runs = [(done[:n].count((batch, counts)), batch, outcome, count) for n, (batch, counts) in enumerate(done) for outcome, count in counts.items() if count]
    return spark.createDataFrame(runs, "run int, batch long, outcome string, n long")


PAGES = """pages AS (SELECT 's' || (event_id % 7) AS stream, event_id // 700 AS page, event_id % 700 // 7 AS position, event_id AS id,
  -(event_id // 700) * 6000 - (event_id % 700 // 7) * 60 + CASE WHEN event_id % 50 = 0 THEN 7200 ELSE 0 END AS s FROM events WHERE (event_id // 700 * 3 + event_id % 7) % 11 <> 5)"""


@query("live_page_faults", f"""WITH {PAGES}, o AS (SELECT *, min(s) OVER (PARTITION BY stream ORDER BY page, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS oldest, lag(page) OVER (PARTITION BY stream ORDER BY page, position) AS before FROM pages)
SELECT stream, page, position, id, CASE WHEN s > oldest THEN 'not_descending' END AS reason, CASE WHEN page > before + 1 THEN page - before - 1 ELSE 0 END AS missing_pages FROM o WHERE s > oldest OR page > before + 1""")
def live_page_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id")
    page, position = F.floor(at / 700), F.floor(at % 700 / 7)
    rows = _stream(spark, sf_dir, "events").where((page * 3 + at % 7) % 11 != 5).select(
        F.concat(F.lit("s"), at % 7).alias("stream"), page.alias("page"), position.alias("position"), at.alias("id"),
        F.timestamp_seconds(F.lit(2_000_000_000) - page * 6000 - position * 60 + F.when(at % 50 == 0, 7200).otherwise(0)).alias("created_at"),
    )
    return _run(V.guarded_pages(rows), "pages").where("reason is not null or missing_pages > 0").select("stream", "page", "position", "id", "reason", "missing_pages")


@query("live_inventory", f"""WITH {FIFO}, final AS (SELECT date_trunc('milliseconds', max(created_at)) - INTERVAL 1 HOUR AS t FROM x0)
SELECT kind, account, item_code, sale_id, lot_id, {rounded('matched')}, round(matched * d, 6) + 0.0 AS profit, round(matched * dn, 6) + 0.0 AS net_profit, lot_tied AS lot_equal_time FROM met, final WHERE matched > 1e-9 AND sold_at <= t""")
def live_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream has matched when all files are read: sales up to an hour before the newest trade."""
    parts = L.sides(L.attributed(T.ledger_trades_of(_stream(spark, sf_dir, "events"))))
    return r6(_run(V.live_matches(parts, "1 hour"), "inventory").select("kind", "account", "item_code", "sale_id", "lot_id", "matched", "profit", "net_profit", "lot_equal_time"))


#: Trades in at most twelve pieces and in cents, so that SQL can bring all shares to one denominator.
DOZENS = FIFO.replace("FROM parts_all WHERE", "FROM (SELECT * REPLACE (1 + quantity % 12 AS quantity, round(money, 2) AS money) FROM parts_all) WHERE").replace("s.quantity AS sq", "l.quantity AS lq, l.money AS lm, s.quantity AS sq")


@query("exact_profits", f"""WITH {DOZENS}, n AS (SELECT kind, account, sum(CAST(matched AS HUGEINT) * (CAST(round(sm * 100) AS HUGEINT) * (27720 // CAST(sq AS HUGEINT)) - CAST(round(lm * 100) AS HUGEINT) * (27720 // CAST(lq AS HUGEINT)))) AS n FROM met WHERE matched > 0 AND sm IS NOT NULL AND lm IS NOT NULL GROUP BY ALL),
g AS (SELECT *, gcd(CAST(abs(n) AS HUGEINT), CAST(2772000 AS HUGEINT)) AS g FROM n)
SELECT kind, account, CAST(CAST(n AS HUGEINT) // g AS VARCHAR) AS numerator, CAST(2772000 // g AS VARCHAR) AS denominator, round(CAST(n AS DOUBLE) / 2772000, 6) + 0.0 AS profit FROM g""")
def exact_profits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = L.sides(L.attributed(T.ledger_trades(spark, sf_dir))).withColumns({"quantity": 1 + F.col("quantity") % 12, "money": F.round("money", 2)})
    found = E.exact_profits(parts).where("measure = 'money'")
    return r6(found.select("kind", "account", "numerator", "denominator", F.col("profit").cast("double").alias("profit")))
