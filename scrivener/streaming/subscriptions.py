"""Streams with timers: subscriptions with heartbeats, retention of finished tasks, and guarded calls.

Timers are processing-time timeouts of a key's state. What a timer or an event does to the state is a plain step with the
time as an argument, so the tests drive it by a clock of their own; the streams only bring state, events and time to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scrivener.operators.jobs import CallGuard

OUTPUT = "job string, sequence long, kind string, status string, dropped long, at_ms long"


class Subscription:
    """One subscriber of a job: what it has been sent, as (sequence, kind, status, dropped, time)."""

    STATE = "status string, dropped long, last_ms long, ended boolean"

    def __init__(self, status: str = "queued", dropped: int = 0, last_ms: int = 0, ended: bool = False):
        self.status, self.dropped, self.last_ms, self.ended = status, dropped, last_ms, ended

    def events(self, rows: list[tuple[int, str, str | None, int]], now: int) -> list[tuple]:
        """Events (sequence, kind, status, dropped) go through until one is `done`; all later ones are lost on purpose."""
        out = []
        for sequence, kind, status, dropped in rows:
            if self.ended:
                break
            self.status, self.dropped, self.last_ms, self.ended = status or self.status, max(self.dropped, dropped), now, kind == "done"
            out.append((sequence, kind, self.status, self.dropped, now))
        return out

    def silence(self, now: int, idle_ms: int) -> list[tuple]:
        """A heartbeat if nothing was sent for so long."""
        if self.ended or now - self.last_ms < idle_ms:
            return []
        self.last_ms = now
        return [(None, "heartbeat", self.status, self.dropped, now)]


def subscriptions(events: DataFrame, idle_seconds: float = 20, keep_ended_seconds: float = 86_400) -> DataFrame:
    """Events (job, sequence, kind, status, dropped) as a subscriber gets them: in order of their sequence, with a heartbeat
    after each `idle_seconds` without one, up to the first `done`. A job that has ended is remembered for a day, so that
    late events don't begin it anew; then its state goes."""
    idle = int(idle_seconds * 1000)

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.getCurrentProcessingTimeMs(), Subscription(*state.get) if state.exists else Subscription()
        if state.hasTimedOut:
            if held.ended:
                state.remove()
                return
            out = held.silence(now, idle)
        else:
            rows = pd.concat(list(batches)).sort_values("sequence", kind="stable")
            out = held.events([(int(s), k, None if pd.isna(x) else x, 0 if pd.isna(d) else int(d)) for s, k, x, d in zip(rows["sequence"], rows["kind"], rows["status"], rows["dropped"], strict=True)], now)
        state.update((held.status, held.dropped, held.last_ms, held.ended))
        state.setTimeoutDuration(int(keep_ended_seconds * 1000) if held.ended else max(1, held.last_ms + idle - now))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["job", "sequence", "kind", "status", "dropped", "at_ms"]).astype({"sequence": "Int64"})

    rows = events.select("job", "sequence", "kind", "status", "dropped").filter("job is not null and sequence is not null")
    return rows.groupBy("job").applyInPandasWithState(each, OUTPUT, Subscription.STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


class Retained:
    """The finished tasks of a group, and how many subscribers each task has."""

    STATE = "tasks array<string>, finished array<long>, watched array<string>, watchers array<int>"

    def __init__(self, tasks: list = (), finished: list = (), watched: list = (), watchers: list = ()):
        self.finished, self.watchers = dict(zip(tasks, finished, strict=True)), dict(zip(watched, watchers, strict=True))

    def state(self) -> tuple[list, list, list, list]:
        return list(self.finished), list(self.finished.values()), list(self.watchers), list(self.watchers.values())

    def take(self, task: str, kind: str, at: int) -> None:
        if kind == "finished":
            self.finished.setdefault(task, at)
        elif kind in ("subscribed", "unsubscribed"):
            n = self.watchers.pop(task, 0) + (1 if kind == "subscribed" else -1)
            if n > 0:
                self.watchers[task] = n

    def _unwatched(self) -> list[tuple[int, str]]:
        return sorted((at, t) for t, at in self.finished.items() if t not in self.watchers)

    def evict(self, now: int, ttl: int, most: int) -> list[tuple[str, str]]:
        """Tasks that go, and why: those older than ttl, then the oldest beyond `most`. Watched ones stay."""
        out = [(t, "expired") for at, t in self._unwatched() if now - at >= ttl]
        left = [t for at, t in self._unwatched() if now - at < ttl]
        out += [(t, "overflow") for t in left[: max(0, len(left) - most)]]
        for t, _ in out:
            del self.finished[t]
        return out

    def next_expiry(self, ttl: int) -> int | None:
        return next((at + ttl for at, _ in self._unwatched()), None)


def retention(events: DataFrame, ttl_seconds: float = 86_400, most: int = 200) -> DataFrame:
    """Evictions (group, task, reason, at_ms) from events (group, task, kind, sequence) of finished tasks and subscribers.
    A group's state is its tasks that are kept: `most` of them and the watched ones."""
    ttl = int(ttl_seconds * 1000)

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.getCurrentProcessingTimeMs(), Retained(*map(list, state.get)) if state.exists else Retained()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("sequence", kind="stable")
            for task, kind in zip(rows["task"], rows["kind"], strict=True):
                held.take(task, kind, now)
        out = held.evict(now, ttl, most)
        if held.finished or held.watchers:
            state.update(held.state())
            if (due := held.next_expiry(ttl)) is not None:
                state.setTimeoutDuration(max(1, due - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], t, why, now) for t, why in out], columns=["group", "task", "reason", "at_ms"])

    rows = events.select("group", "task", "kind", "sequence").filter("group is not null and task is not null")
    return rows.groupBy("group").applyInPandasWithState(each, "group string, task string, reason string, at_ms long", Retained.STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def guarded_calls(calls: DataFrame, **limits: float) -> DataFrame:
    """Whether each call (job, sequence, tokens, ok, category) may be made: job, sequence, refused and reason. The limits are
    those of CallGuard; the state of a job is its guard."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard = CallGuard(**limits)
        if state.exists:
            guard.requests, guard.tokens, recent, guard.fatal, guard.reason = state.get
            guard.recent.extend(recent)
        rows = pd.concat(list(batches)).sort_values("sequence", kind="stable")
        reasons = [guard.call(int(t), bool(ok), c) for t, ok, c in zip(rows["tokens"], rows["ok"], rows["category"], strict=True)]
        state.update((guard.requests, guard.tokens, list(guard.recent), guard.fatal, guard.reason))
        yield pd.DataFrame({"job": rows["job"], "sequence": rows["sequence"], "refused": [bool(r) for r in reasons], "reason": reasons})

    kind = "requests long, tokens long, recent array<boolean>, fatal int, reason string"
    return calls.groupBy("job").applyInPandasWithState(each, "job string, sequence long, refused boolean, reason string", kind, "append", GroupStateTimeout.NoTimeout)
