"""Streams with state of their own: records resolved field by field, guarded pages, live inventory.

All three keep their state in Spark's key-value store (RocksDB on each executor, saved with
the checkpoint), so a state larger than memory and the loss of an executor do no harm, and
they go through a key's new rows in an order that the rows themselves state. What they give
is therefore the same however rows were dealt to files and micro-batches.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Have the session's streams keep their state in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


#: Groups that ids are dealt to by a hash and slots that their records are kept in; fixed, as what is kept is found by them.
BUCKETS, SLOTS = 1 << 12, 1 << 18
#: Rows of a frame that a task gives.
FRAME = 10_000


class FieldResolver(StatefulProcessor):
    """Records of a bucket of ids: each one's item and fields, each field with its value and revision, as JSON.

    A call to the state costs far more than an arrival, so a slot of records is read once and
    written once for all arrivals of a micro-batch, and a bucket that is new is not read at all.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot long", "records string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrivals, held, done = defaultdict(lambda: defaultdict(list)), self.slots.exists(), []
        for frame in rows:
            for slot, *arrival in zip(*(frame[c].tolist() for c in ("slot", "id", "arrival", "given")), strict=True):
                arrivals[slot][arrival[0]].append(arrival[1:])
        while arrivals:
            slot, ids = arrivals.popitem()
            kept = self.slots.getValue((slot,)) if held else None
            records, changed = {} if kept is None else json.loads(kept[0]), False
            for ident, of_id in ids.items():
                changed |= self.resolved(records, ident, of_id, done)
            if changed:
                self.slots.updateValue((slot,), (json.dumps(records),))
            if len(done) >= FRAME or not arrivals:
                yield pd.DataFrame(done, columns=["id", "arrival", "outcome", "changes"])
                done = []

    def resolved(self, records: dict, ident, of_id: list[tuple[int, str]], done: list[tuple]) -> bool:
        """List what each arrival of an id did; whether its record is another one now."""
        record = records.get(str(ident))
        item, fields = (None, {}) if record is None else record
        new = changed = record is None
        for arrival, text in sorted(of_id, key=itemgetter(0)):
            given = json.loads(text)
            code, revised, values = given["item_code"], given["revised_at"], given["fields"] or {}
            item = code if new else item
            changes = None if not new and self.conflicts(item, fields, code, values) else self.merged(fields, values, revised)
            done.append((ident, arrival, "rejected" if changes is None else "inserted" if new else "enriched" if changes else "unchanged", json.dumps(changes or {})))
            new, changed = False, changed or bool(changes)
        records[str(ident)] = (item, fields)
        return changed

    @staticmethod
    def conflicts(item: str | None, fields: dict, code: str | None, values: dict) -> bool:
        """Whether an arrival is of another item than its record, or of another transaction type than is known."""
        kind, known = values.get("transaction_type"), fields.get("transaction_type", (None, None))[0]
        return item != code or kind is not None and known is not None and known != kind

    @staticmethod
    def merged(fields: dict, values: dict, revision: int | None) -> dict:
        """The fields that an arrival changes: by their first value, a newer revision's, or one where only an unrevised null was."""
        changes = {}
        for field, value in values.items():
            known, prior = fields.get(field, (None, None))
            newer = revision is not None and (prior is None or revision > prior)
            if field not in fields or newer or known is None and prior is None and value is not None:
                fields[field] = (value, revision)
                changes[field] = {"value": value, "revised_at": revision}
        return changes

    def close(self) -> None:
        pass


def resolved_records(stream: DataFrame) -> DataFrame:
    """(id, arrival, outcome, changes) of arrivals (id, arrival, item_code, revised_at, fields).

    ``fields`` maps what an arrival has, null values too; what it lacks never changes
    anything. ``changes`` has the fields that the arrival changed, each with its value and
    revision. An arrival of another item than its record, or of another transaction type than
    is known of it, is rejected. Arrivals of an id come in order of ``arrival`` from file to
    file; within a micro-batch they may come in any. A task holds the arrivals of one bucket,
    one in 4,096 of a micro-batch's.
    """
    keep_state(stream.sparkSession)
    given = F.to_json(F.struct("item_code", F.col("revised_at").cast("long").alias("revised_at"), "fields"), {"ignoreNullFields": "false"})
    rows = stream.where("id is not null").select(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(SLOTS)).alias("slot"), "id", "arrival", given.alias("given")).withColumn("bucket", F.pmod("slot", F.lit(BUCKETS)))
    kind = dict(rows.dtypes)
    found = rows.groupBy("bucket").transformWithStateInPandas(FieldResolver(), f"id {kind['id']}, arrival {kind['arrival']}, outcome string, changes string", "Append", "None")
    return found.withColumn("changes", F.from_json("changes", "map<string, struct<value: string, revised_at: bigint>>"))


class PageGuard(StatefulProcessor):
    """Where the scan of a stream stands: its last page, that page's oldest time and the newest of all.

    A micro-batch's trades are held in columns of numbers, not as rows, and are given in frames.
    """

    def __init__(self, late_us: int | None):
        self.late_us = late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stand = handle.getValueState("stand", "page long, oldest long, newest long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, oldest, newest = self.stand.get() if self.stand.exists() else (None, None, None)
        frames = [(*(f[c].to_numpy("int64") for c in ("page", "position", "us")), pa.array(f["id"], from_pandas=True)) for f in rows]
        page, position, us = (np.concatenate([f[n] for f in frames]) for n in range(3))
        ids = pa.chunked_array([f[3] for f in frames])
        del frames
        order = np.lexsort((position, page))
        page, position, us = page[order], position[order], us[order]

        starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        before = np.r_[FIRST if last is None else last, page[starts][:-1]]
        before = np.maximum.accumulate(before)
        passed = page[starts] <= before
        missing = np.zeros(len(page), "int64")
        missing[starts] = np.where(passed | (before == FIRST), 0, page[starts] - before - 1)
        late_page = np.repeat(passed, np.diff(np.r_[starts, len(page)]))
        tops = np.maximum.accumulate(np.r_[FIRST if newest is None else newest, np.maximum.reduceat(us, starts)])
        late = np.zeros(len(page), bool)
        if self.late_us is not None:
            floor = np.where(tops[:-1] == FIRST, FIRST, tops[:-1] - self.late_us)
            late = us < np.repeat(floor, np.diff(np.r_[starts, len(page)]))
        # A trade that is not taken for its order is later than the oldest one, so it changes no minimum.
        lows = np.minimum.accumulate(np.r_[LAST if oldest is None else oldest, np.where(late_page | late, LAST, us)])
        code = np.where(late_page, 1, np.where(late, 2, np.where(us > lows[:-1], 3, 0)))
        self.stand.update((int(page[-1]) if last is None else max(last, int(page[-1])), int(lows[-1]) if lows[-1] != LAST else None, int(tops[-1])))
        del lows, late, late_page
        for low in range(0, len(page), FRAME):
            some = slice(low, low + FRAME)
            yield pd.DataFrame({"stream": key[0], "page": page[some], "position": position[some], "id": ids.take(pa.array(order[some])).to_pandas(), "us": us[some], "reason": REASONS[code[some]], "missing_pages": missing[some]})

    def close(self) -> None:
        pass


#: Before and after all numbers and times; why a trade is set aside.
FIRST, LAST = np.iinfo("int64").min, np.iinfo("int64").max
REASONS = np.array([None, "late_page", "late", "not_descending"], dtype=object)


def guarded_pages(stream: DataFrame, late: str | None = None) -> DataFrame:
    """(stream, page, position, id, us, reason, missing_pages) of trades (stream, page, position, id, created_at).

    A scan's pages go newest first, across files and micro-batches: each trade is held
    against the one taken before it, wherever that was read. ``reason`` says why a trade is set
    aside: ``late_page`` (its page's number has been passed), ``late`` (older than ``late``
    before the newest time of earlier pages, for streams that follow the clock) or
    ``not_descending``; it is null for a trade that is taken. ``missing_pages``, on the first
    row after a gap, counts the pages that have not come, so coverage ends there.
    """
    spark = stream.sparkSession
    keep_state(spark)
    late_us = None if late is None else int(spark.sql(f"select unix_micros(timestamp '2000-01-01' + interval {late}) - unix_micros(timestamp '2000-01-01')").first()[0])
    rows = stream.select("stream", F.col("page").cast("long").alias("page"), F.col("position").cast("long").alias("position"), "id", F.unix_micros("created_at").alias("us"))
    kind = dict(rows.dtypes)
    return rows.where("us is not null and stream is not null and page is not null").groupBy("stream").transformWithStateInPandas(
        PageGuard(late_us), f"stream {kind['stream']}, page long, position long, id {kind['id']}, us long, reason string, missing_pages long", "Append", "None")


def guard_to_tables(stream: DataFrame, taken: str, aside: str, gaps: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Write guarded trades, those set aside and the gaps to tables of their own.

    Each batch has its own folder and overwrites it when it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.where("reason is null").drop("reason", "missing_pages").write.mode("overwrite").parquet(f"{taken}/batch={number}")
            batch.where("reason is not null").drop("missing_pages").write.mode("overwrite").parquet(f"{aside}/batch={number}")
            batch.where("missing_pages > 0").select("stream", "page", "missing_pages").write.mode("overwrite").parquet(f"{gaps}/batch={number}")
        finally:
            batch.unpersist()

    return guarded_pages(stream, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A trade as it waits, in frames; amounts per trade, NaN where they are not known.
WAITS = pa.schema([("slot", pa.int64()), ("kind", pa.string()), ("account", pa.string()), ("item_code", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("side", pa.string()), *((c, pa.float64()) for c in ("quantity", "money", "gross", "net"))])
MATCHES = "kind string, account string, item_code string, sale_id long, sold_at_us long, lot_id long, matched double, profit double, gross_profit double, net_profit double, sale_quantity double, lot_equal_time boolean"
#: Lots of a queue that are kept as one value.
BLOCK = 1_000


class Lots:
    """One account's lots of one item, oldest first: [us, id, quantity, money, gross, net, equal_time, left].

    The first and last lots lie with their slot, full blocks between them in a map by number,
    so a sale reads only the blocks that it takes from, however many lots are held.
    """

    def __init__(self, blocks, name: tuple[int, str], kept: dict | None):
        self.blocks, self.name = blocks, name
        kept = kept or {"barred": False, "first": 0, "last": 0, "head": [], "tail": []}
        self.barred, self.first, self.last = kept["barred"], kept["first"], kept["last"]
        self.head, self.tail = deque(kept["head"]), kept["tail"]

    def kept(self) -> dict | None:
        """What lies with the slot; nothing if no lot is held or barred."""
        if not (self.barred or self.head or self.tail or self.first < self.last):
            return None
        return {"barred": self.barred, "first": self.first, "last": self.last, "head": list(self.head), "tail": self.tail}

    def add(self, lot: list) -> None:
        self.tail.append(lot)
        if len(self.tail) >= BLOCK:
            self.blocks.updateValue((*self.name, self.last), (json.dumps(self.tail),))
            self.last, self.tail = self.last + 1, []

    def oldest(self) -> list | None:
        if not self.head and self.first < self.last:
            place = (*self.name, self.first)
            self.head, self.first = deque(json.loads(self.blocks.getValue(place)[0])), self.first + 1
            self.blocks.removeKey(place)
        elif not self.head:
            self.head, self.tail = deque(self.tail), []
        return self.head[0] if self.head else None

    def clear(self) -> None:
        for number in range(self.first, self.last):
            self.blocks.removeKey((*self.name, number))
        self.barred, self.first, self.head, self.tail = False, self.last, deque(), []


class Inventory(StatefulProcessor):
    """The lots of a bucket of accounts and items, and the trades that wait for the watermark.

    A call to the state costs far more than a trade, so trades wait in frames, and a slot of
    queues is read once and written once for all trades that are due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "trades binary")
        self.slots = handle.getMapState("slots", "slot long", "queues string")
        self.blocks = handle.getMapState("blocks", "slot long, name string, number long", "lots string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        trades = pa.concat_tables([pa.Table.from_pandas(f[WAITS.names], WAITS, preserve_index=False) for f in rows])
        self.waiting.appendList(self.framed(trades))
        self.handle.registerTimer(pc.min(trades["us"]).as_py() // 1000 + 1)
        yield from ()

    @staticmethod
    def framed(trades: pa.Table) -> list[tuple[bytes]]:
        frames = []
        for low in range(0, len(trades), FRAME):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, WAITS) as out:
                out.write_table(trades.slice(low, FRAME))
            frames.append((sink.getvalue().to_pybytes(),))
        return frames

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        frames = [pa.ipc.open_stream(f[0]).read_all() for f in self.waiting.get()]
        waiting = pa.concat_tables(frames) if frames else WAITS.empty_table()
        late = pc.greater(waiting["us"], upto)
        left, due = waiting.filter(late), waiting.filter(pc.invert(late))
        if not len(due):
            return
        if len(left):
            self.waiting.put(self.framed(left))
            self.handle.registerTimer(pc.min(left["us"]).as_py() // 1000 + 1)
        else:
            self.waiting.clear()
        due = due.sort_by([(c, "ascending") for c in ("slot", "kind", "account", "item_code", "us", "id")])
        rows = (r for low in range(0, len(due), FRAME) for r in zip(*(due[c].slice(low, FRAME).to_numpy().tolist() for c in WAITS.names), strict=True))
        held, done = self.slots.exists(), []
        for slot, of_slot in groupby(rows, key=itemgetter(0)):
            kept = self.slots.getValue((slot,)) if held else None
            queues = {} if kept is None else json.loads(kept[0])
            for owner, own in groupby(of_slot, key=itemgetter(1, 2, 3)):
                name = json.dumps(owner)
                lots = Lots(self.blocks, (slot, name), queues.pop(name, None))
                for match in self.matched(lots, own):
                    done.append((*owner, *match))
                    if len(done) >= FRAME:
                        yield pd.DataFrame(done, columns=MATCHED)
                        done = []
                if (now := lots.kept()) is not None:
                    queues[name] = now
            if queues:
                self.slots.updateValue((slot,), (json.dumps(queues),))
            elif kept is not None:
                self.slots.removeKey((slot,))
        if done:
            yield pd.DataFrame(done, columns=MATCHED)

    @staticmethod
    def matched(lots: Lots, rows: Iterator[tuple]) -> Iterator[tuple]:
        """What each sale takes from the lots, one match after the other; an unknown amount is NaN and so is its profit."""
        for us, same in groupby(rows, key=itemgetter(4)):
            same = list(same)
            for row in same:
                ident, side, quantity, *amounts = row[5:]
                known = quantity > 0
                if side == "buy":
                    lots.barred = lots.barred or not known
                    if not lots.barred:
                        lots.add([us, ident, quantity, *amounts, len(same) > 1, quantity])
                elif not known:
                    lots.clear()
                else:
                    need = quantity
                    while need > 0 and (lot := lots.oldest()) is not None and lot[0] < us:
                        taken = min(need, lot[7])
                        yield ident, us, lot[1], taken, *(taken * (mine / quantity - theirs / lot[2]) for mine, theirs in zip(amounts, lot[3:6], strict=True)), quantity, lot[6]
                        need -= taken
                        if taken == lot[7]:
                            lots.head.popleft()
                        else:
                            lot[7] -= taken

    def close(self) -> None:
        pass


MATCHED = [c.split()[0] for c in MATCHES.split(", ")]


def live_matches(parts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sales of commodities matched with the oldest purchases of strictly earlier time, live.

    ``parts`` are an account's sides of trades, as for ``ledger.fifo``, with created_at, and
    matches are the same. Trades wait until the watermark, ``late`` behind the newest time, has
    passed them, and are then matched in order of time and id whatever file they came in; what
    is later still is dropped by Spark and belongs in a side table before. Accounts and items
    are dealt to 4,096 buckets by a hash; a task holds the waiting trades of one.
    """
    keep_state(parts.sparkSession)
    rows = parts.where("transaction_type = 'trading' and kind is not null and account is not null and created_at is not null").withWatermark("created_at", late)
    rows = rows.select(F.pmod(F.xxhash64("kind", "account", "item_code"), F.lit(SLOTS)).alias("slot"), "kind", "account", "item_code", "created_at", F.unix_micros("created_at").alias("us"), F.col("id").cast("long").alias("id"), "side", *(F.col(c).cast("double").alias(c) for c in ("quantity", "money", "gross", "net")))
    found = rows.withColumn("bucket", F.pmod("slot", F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(Inventory(), MATCHES, "Append", "EventTime")
    return found.withColumn("sold_at", F.timestamp_micros("sold_at_us")).drop("sold_at_us")
