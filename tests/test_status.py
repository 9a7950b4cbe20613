"""The life of audits: by hand, as a stream over late and replayed files, and against SQL."""

from __future__ import annotations

import datetime as dt
import random

from conftest import DATA, agree

from chargeaudit.plans import status as plans
from chargeaudit.streaming import status as T

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_changes_by_hand():
    run, out = T.moved(None, [(1, 1, "run"), (2, 2, "run"), (3, 3, "complete"), (4, 4, "failed"), (10, 5, "run")], 12, 5)
    assert run == (5, 10) and out == [(1, "processing", 1), (1, "complete", 3), (5, "processing", 10)]
    assert T.moved(run, [(15, 6, "failed")], 16, 5) == (None, [(5, "failed", 15)])
    assert T.moved(run, [(16, 6, "failed"), (17, 7, "run")], 18, 5) == ((7, 17), [(5, "timed out", 15), (7, "processing", 17)])
    assert T.moved(run, [], None, 5) == (None, [(5, "timed out", 15)])


def test_table(spark):
    agree(plans.audit_status(spark, DATA), plans.ORACLE_SQL["audit_status"])


def test_stream_of_late_and_replayed_files(spark, tmp_path):
    """Events come out of order by up to the watermark's delay, one file comes twice, and some rows are null."""
    rng, begin = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(i, begin + dt.timedelta(minutes=20 * i, seconds=rng.randint(0, 900)), rng.randint(1, 4), rng.choice(["signup", "purchase", "error", "view", None]), 1.0, "") for i in range(300)]
    rows += [(900, None, 1, "signup", 1.0, ""), (901, begin, None, "signup", 1.0, "")]
    folder = tmp_path / "events.parquet"
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for i, part in enumerate([*parts, parts[-1]]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
    folder.mkdir()
    for i in range(len(parts) + 1):
        next((tmp_path / f"w{i}").glob("*.parquet")).rename(folder / f"{i}.parquet")
    want = sorted(map(tuple, T.audit_status_batch(spark.createDataFrame(rows, SCHEMA), plans.KINDS, plans.TIMEOUT).collect()))
    assert {s for _, _, s, _ in want} == {"processing", "complete", "failed", "timed out"}
    assert sorted(map(tuple, plans.audit_status(spark, str(tmp_path)).collect())) == want
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}*")
    end = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "end*"))
    spark.createDataFrame([(None, begin + dt.timedelta(days=60), -1, "click", None, None)], SCHEMA).write.parquet(str(tmp_path / "end"))
    got = sorted(map(tuple, T.run_status(stream.union(end), plans.KINDS, plans.TIMEOUT).collect()))
    assert [x for x in got if x in want] == got  # a file may come after the end's watermark, but nothing is said wrongly or twice


def test_few_timers():
    """A key asks for one timer for all rows of a batch, and for one more when it fires and something still waits or runs."""

    class Handle:
        def __init__(self):
            self.timers, self.states = [], {}

        def getListState(self, name, schema):
            return self.states.setdefault(name, State([]))

        def getValueState(self, name, schema):
            return self.states.setdefault(name, State(None))

        def registerTimer(self, at):
            self.timers.append(at)

    class State:
        def __init__(self, value):
            self.value = value

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def appendList(self, rows):
            self.value = [*(self.value or []), *rows]

        def put(self, rows):
            self.value = rows

        update = put

        def clear(self):
            self.value = [] if isinstance(self.value, list) else None

    class Now:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    rows = [(i * 5_000_000, i, ("run", "failed")[i % 3 == 0]) for i in range(1, 200)]
    audit, handle, said = T.AuditStatus(7_000_000), Handle(), []
    audit.init(handle)
    for part in (rows[100:], rows[:100], rows[:3]):
        list(audit.handleInputRows((1,), iter([dict(zip(("at", "event_id", "kind"), r, strict=True)) for r in part]), None))
    assert len(handle.timers) == 3
    for mark in (300_000, 600_000, 10_000_000):  # each is after the timers that the one before left
        assert min(handle.timers) <= mark
        handle.timers.clear()
        said += [(r.run_id, r.status, r["at"]) for r in audit.handleExpiredTimer((1,), Now(mark), Now(mark))]
        assert len(handle.timers) <= 1
    assert said == T.moved(None, rows, None, 7_000_000)[1] and not handle.timers
