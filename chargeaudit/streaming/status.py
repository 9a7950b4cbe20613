"""The life of an audit as a keyed state machine: asked for, then complete, failed or timed out.

Events of one key may come late and twice.  They wait in the state until the watermark has passed them, so they are taken in the
order of their times whatever the order of their files; what comes after the watermark is dropped by the stream, and so is a
batch that is replayed after it was taken; one that is replayed before is recognised by its event ids.  A timer on event time
takes what has waited, and ends an audit whose time is up; a key has one for the earliest of both and one for each batch that
brought it rows, not one for each event.  An audit that runs is not asked for again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import streams

OUT = "key long, run_id long, status string, at long"
Run = tuple[int, int] | None
Event = tuple[int, int, str]


def moved(run: Run, events: Iterable[Event], until: int | None, timeout: int) -> tuple[Run, list[tuple[int, str, int]]]:
    """The audit that runs after ``events`` (time, id, kind), in order, and the changes (run id, status, time) that they make.

    ``run`` is (id, start) or None.  Times are microseconds; at ``until`` (None: at the end of all) audits are ended whose time is up.
    """
    out: list[tuple[int, str, int]] = []

    def expire(now: int | None) -> None:
        nonlocal run
        if run is not None and (now is None or now > run[1] + timeout):
            out.append((run[0], "timed out", run[1] + timeout))
            run = None

    for at, event_id, kind in events:
        expire(at)
        if kind == "run" and run is None:
            run = event_id, at
            out.append((event_id, "processing", at))
        elif kind in ("complete", "failed") and run is not None:
            out.append((run[0], kind, at))
            run = None
    expire(until)
    return run, out


class AuditStatus(StatefulProcessor):
    def __init__(self, timeout: int) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string")
        self.running = handle.getValueState("running", "run_id long, started long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        come = [(r["at"], r["event_id"], r["kind"]) for r in rows]
        self.waiting.appendList(come)
        # the timer of the earliest one takes or calls again for the others
        self.handle.registerTimer(min(x[0] for x in come) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # no event from before the watermark comes any more, so all up to it is taken at once
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        every = {tuple(x) for x in self.waiting.get()}
        due = sorted(x for x in every if x[0] < now)
        run = self.running.get() if self.running.exists() else None
        run, changes = moved(tuple(run) if run is not None else None, due, now, self.timeout)
        rest = sorted(every - set(due))
        if rest:
            self.waiting.put(rest)
        elif every:
            self.waiting.clear()
        if run is None:
            self.running.clear()
        else:
            self.running.update(run)
        call = [x[0] for x in rest[:1]] + ([run[1] + self.timeout] if run is not None else [])
        if call:
            self.handle.registerTimer(min(call) // 1000 + 1)
        for run_id, status, at in changes:
            yield Row(key=key[0], run_id=run_id, status=status, at=at)

    def close(self) -> None:
        pass


def _asked(events: DataFrame, kinds: dict[str, str]) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    return events.select(F.col("user_id").alias("key"), "event_id", F.unix_micros("ts").alias("at"), kind.alias("kind"), "ts")


def _told(changes: DataFrame) -> DataFrame:
    return changes.select("key", "run_id", "status", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"))


def audit_status(events: DataFrame, kinds: dict[str, str], timeout: int, late: str = "10 minutes") -> DataFrame:
    """A stream of changes (key, run_id, status, at) of the audits in ``events`` (user_id, event_id, event_type, ts).

    ``kinds`` maps event types to run, complete and failed, others and nulls pass without effect; ``timeout`` is in seconds.
    """
    # events of no kind need not wait, but the watermark must see them: a filter that reads ts is not moved before it
    asked = _asked(events, kinds).withWatermark("ts", late).filter("key IS NOT NULL AND at IS NOT NULL AND (kind IS NOT NULL OR ts IS NULL)")
    return asked.groupBy("key").transformWithState(AuditStatus(timeout * 1_000_000), OUT, "append", "eventTime")


def audit_status_batch(events: DataFrame, kinds: dict[str, str], timeout: int) -> DataFrame:
    """The changes of a finished table of events: what the stream has said when all its audits are closed."""
    import pandas as pd

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates().sort_values(["at", "event_id", "kind"])
        _, changes = moved(None, rows[["at", "event_id", "kind"]].itertuples(index=False, name=None), None, timeout * 1_000_000)
        return pd.DataFrame([(key[0], *c) for c in changes], columns=["key", "run_id", "status", "at"])

    asked = _asked(events, kinds).filter("key IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL").drop("ts")
    return _told(asked.groupBy("key").applyInPandas(group, OUT))


def run_status(events: DataFrame, kinds: dict[str, str], timeout: int) -> DataFrame:
    """Runs the stream to its end."""
    return _told(streams.run_on_disk(audit_status(events, kinds, timeout)))
