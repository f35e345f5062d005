"""What streams keep for each key; imported by workers without a session, so nothing here makes columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ACTIONS = ("claim", "heartbeat", "release")


class LeaseKeeper(StatefulProcessor):
    """Holds the open lease of a key, and ends it at its release, at the first event behind its end, or by its timer.

    Times are microseconds, timers milliseconds; the timer of a lease fires when its whole last millisecond is over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = StructType()
        for name in ("item", "worker", "acquired_at", "until", "beats"):
            held = held.add(name, "long")
        self.lease = handle.getValueState("lease", held)
        self.gone = handle.getValueState("gone", StructType().add("at", "long"))

    def _end(self, key: tuple, status: str, at: int) -> Row:
        item, worker, acquired, until, beats = self.lease.get()
        self.handle.deleteTimer(until // 1000 + 1)
        self.lease.clear()
        self.gone.update((at,))
        # an ended lease is remembered until no event of its time can come any more
        self.handle.registerTimer(max(at, until) // 1000 + 2)
        return Row(lease_id=key[0], item=item, worker=worker, status=status, acquired_at=acquired, ended_at=at, beats=beats)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted((r for r in rows if r.action in ACTIONS), key=lambda r: (r.at, ACTIONS.index(r.action))):
            if self.gone.exists():
                continue
            ends = r.at + int((r.ttl or 0) * 1_000_000)
            if not self.lease.exists():
                if r.action == "claim":
                    self.lease.update((r.item, r.worker, r.at, ends, 0))
                    self.handle.registerTimer(ends // 1000 + 1)
                continue
            item, worker, acquired, until, beats = self.lease.get()
            if r.at > until:
                yield self._end(key, "expired", until)
            elif r.action == "release":
                yield self._end(key, "released", r.at)
            elif r.action == "heartbeat":
                later = max(until, ends)
                self.lease.update((item, worker, acquired, later, beats + 1))
                if later > until:
                    self.handle.deleteTimer(until // 1000 + 1)
                    self.handle.registerTimer(later // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.lease.exists():
            yield self._end(key, "expired", self.lease.get()[3])
        else:
            self.gone.clear()

    def close(self) -> None:
        pass


class FirstSight(StatefulProcessor):
    """Lets a key's first row through, and forgets it ttl_ms after."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType().add("yes", "boolean"), ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min(rows, key=lambda r: (r.ts, r.payload or ""))
        if not self.seen.exists():
            self.seen.update((True,))
            yield Row(seed=key[0], ts=first.ts, payload=first.payload)

    def close(self) -> None:
        pass
