"""What processors with state hold and how often they call it, without Spark."""

import json

import pandas as pd

from tidemark.streaming import stateful as S


class Fake:
    """A map and a value that count their calls."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def getMapState(self, *_):  # noqa: N802
        return self

    getValueState = getMapState  # noqa: N815

    def exists(self):
        return bool(self.kept)

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.kept[key] = value

    def get(self):
        return self.kept[0]

    def update(self, value):
        self.kept[0] = value


def test_a_slot_of_records_is_read_and_written_once():
    fake, resolver = Fake(), S.FieldResolver()
    resolver.init(fake)
    text = lambda n: json.dumps({"item_code": "x", "revised_at": n, "fields": {"money": str(n), "note": None}})
    for batch in (0, 1):
        rows = [(n % 3, n, a, text(a)) for n in range(60) for a in (2 * batch + 1, 2 * batch)]
        out = pd.concat(resolver.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["slot", "id", "arrival", "given"])]), None))
        assert len(out) == 120
    assert set(out["outcome"]) == {"enriched"}
    assert fake.calls == 3 + 6


def test_pages_come_out_in_frames():
    fake, guard = Fake(), S.PageGuard(None)
    guard.init(fake)
    rows = 2 * S.FRAME + 5
    frame = pd.DataFrame({"page": [n // 100 for n in range(rows)], "position": [n % 100 for n in range(rows)], "id": range(rows), "us": range(rows, 0, -1)})
    frames = list(guard.handleInputRows(("s",), iter([frame.iloc[7:], frame.iloc[:7]]), None))
    assert [len(f) for f in frames] == [S.FRAME, S.FRAME, 5]
    assert all(f["reason"].isna().all() for f in frames) and [i for f in frames for i in f["id"]] == list(range(rows))
    assert fake.kept[0] == ((rows - 1) // 100, 1, rows)


class Waiting:
    """A list and the timers of a bucket."""

    def __init__(self, fakes):
        self.rows, self.fakes, self.timers = [], fakes, []

    def getListState(self, *_):  # noqa: N802
        return self

    def getMapState(self, name, *_):  # noqa: N802
        return self.fakes[name]

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.upto


class Shrinking(Fake):
    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.kept[key]


def test_lots_of_a_slot_are_read_and_written_once():
    fakes = {"slots": Shrinking(), "blocks": Shrinking()}
    waiting, inventory = Waiting(fakes), S.Inventory()
    inventory.init(waiting)
    nan, lots = float("nan"), 3 * S.BLOCK + 7

    def given(rows, upto):
        waiting.upto = upto
        list(inventory.handleInputRows((0,), iter([pd.DataFrame(rows, columns=S.WAITS.names)]), waiting))
        return [tuple(r) for f in inventory.handleExpiredTimer((0,), waiting, None) for r in f.itertuples(index=False)]

    rows = [(5, "user", a, "x", 1_000 * n, n, "buy", 1.0, float(n), nan, 2.0) for a in ("a", "b") for n in range(lots)]
    assert given(rows, lots) == [] and fakes["slots"].calls == 1 and fakes["blocks"].calls == 6 and not waiting.rows
    late = (5, "user", "b", "x", 10_000_000, lots + 1, "sell", 1.0, 1.0, 1.0, 1.0)
    found = given([(5, "user", "a", "x", 9_000_000, lots, "sell", 3.0, 30.0, 1.0, nan), late], 9_500)
    assert [r[3:8] for r in found] == [(lots, 9_000_000, n, 1.0, 10.0 - n) for n in range(3)] and all(r[8] != r[8] and r[9] != r[9] for r in found)
    # One slot read and written, one block taken of the three; the later sale still waits.
    assert fakes["slots"].calls == 3 and fakes["blocks"].calls == 8 and len(waiting.rows) == 1 and waiting.timers[-1] == 10_001
    # A sale of unknown quantity leaves nothing of its queue, and the slot keeps the other's.
    given([(5, "user", "a", "x", 9_600_000, lots + 2, "sell", nan, nan, nan, nan)], 9_700)
    assert len(fakes["blocks"].kept) == 3 and list(json.loads(fakes["slots"].kept[(5,)][0])) == ['["user", "b", "x"]']
    waiting.upto = 10_001
    assert [tuple(r)[3:6] for f in inventory.handleExpiredTimer((0,), waiting, None) for r in f.itertuples(index=False)] == [(lots + 1, 10_000_000, 0)] and not waiting.rows
