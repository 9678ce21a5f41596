"""Keyed state machines over streams, and the same machines over batches.

Each machine is a small class that sees the rows of one key in time order. ``run_batch`` gives each key's
rows to a new machine; ``run_stream`` keeps the machine's state between micro-batches, so that a stream
and a batch of the same rows give the same result. ``finish`` gives what is still open when a key's rows
end (in a stream: when a key has been quiet for a while). Batches are read in sorted partitions row by row,
so a key may have any number of rows; of a stream, one key's rows of a micro-batch are in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


class Pressure:
    """Backlog events by fill: degraded at half, alert at 95 per cent, recovered below a quarter. A jump
    past both gives both events."""

    schema = "event string, fill double"

    def __init__(self, state: dict | None = None):
        self.now = (state or {}).get("now")

    def state(self) -> dict:
        return {"now": self.now}

    def see(self, row) -> Iterator[tuple]:
        fill = row.fill
        if self.now is None and fill >= 0.5:
            yield "degraded", fill
            self.now = "degraded"
        if self.now == "degraded" and fill >= 0.95:
            yield "alert", fill
            self.now = "alert"
        elif self.now and fill < 0.25:
            yield "recovered", fill
            self.now = None


class BoundedQueue:
    """Speech (start, end) beyond ``capacity`` seconds drops the oldest and leaves a gap; ``take`` rows
    hand out the head; silence marks at the tail become one."""

    schema = "event string, start double, end double"
    capacity = 120.0

    def __init__(self, state: dict | None = None):
        self.items = [tuple(x) for x in (state or {}).get("items", [])]

    def state(self) -> dict:
        return {"items": self.items}

    def see(self, row) -> Iterator[tuple]:
        if row.kind == "speech":
            self.items.append(("speech", row.start, row.end))
            while sum(e - s for k, s, e in self.items if k == "speech") > self.capacity and len(self.items) > 1:
                oldest = next(i for i, x in enumerate(self.items) if x[0] == "speech")
                _, start, end = self.items.pop(oldest)
                yield "gap", start, end
        elif row.kind == "silence":
            if self.items and self.items[-1][0] == "silence":
                self.items[-1] = ("silence", None, max(self.items[-1][2], row.end))
            else:
                self.items.append(("silence", None, row.end))
        elif self.items:
            yield self.items.pop(0)


class VoiceSegments:
    """Utterances from frames (frame_no, db) of 20 ms: the floor falls fast and rises by 2 per cent,
    two loud frames begin, 700 ms of quiet end, 300 ms before and 200 ms after are kept, less than 200 ms of
    speech is nothing, and 30 s are cut at the quietest frame of the last 2 s."""

    schema = "start double, end double"
    frame, onset, pre_roll, hangover, tail, least, longest, search = 0.02, 2, 15, 35, 10, 10, 1500, 100
    margin, floor_min, loud = 9.0, -90.0, -50.0

    def __init__(self, state: dict | None = None):
        s = state or {}
        self.floor, self.onsets, self.held = s.get("floor", -90.0), s.get("onsets", 0), s.get("held", 0)
        self.first, self.energies = s.get("first"), s.get("energies", [])
        self.speech, self.quiet, self.last_speech = s.get("speech", 0), s.get("quiet", 0), s.get("last_speech", 0)

    def state(self) -> dict:
        return dict(self.__dict__)

    def _span(self, n: int) -> tuple:
        return round(self.first * self.frame, 4), round((self.first + n) * self.frame, 4)

    def finish(self) -> Iterator[tuple]:
        """Ends what is open, without the quiet at its end."""
        if self.first is not None and self.speech >= self.least:
            yield self._span(min(len(self.energies), self.last_speech + self.tail))
        self.first, self.energies, self.held, self.onsets = None, [], 0, 0

    def settled_through(self, frames_seen: int) -> float:
        """Nothing that comes later starts before this."""
        return (self.first if self.first is not None else frames_seen - self.held) * self.frame

    def see(self, row) -> Iterator[tuple]:
        db, loud = row.db, row.db > max(self.floor + self.margin, self.loud)
        if self.first is None:
            self.floor = min(max(db if db < self.floor else self.floor + (db - self.floor) * 0.02, self.floor_min), -30.0)
            self.held, self.onsets = min(self.held + 1, self.pre_roll), self.onsets + 1 if loud else 0
            if self.onsets >= self.onset:
                self.first, self.energies = row.frame_no + 1 - self.held, [-90.0] * self.held
                self.speech, self.quiet, self.last_speech, self.onsets, self.held = self.onset, 0, self.held, 0, 0
            return
        self.energies.append(db)
        if loud:
            self.speech, self.quiet, self.last_speech = self.speech + 1, 0, len(self.energies)
        else:
            self.quiet += 1
            if self.quiet >= self.hangover:
                if self.speech >= self.least:
                    yield self._span(min(len(self.energies), self.last_speech + self.tail))
                self.first, self.energies = None, []
                return
        if len(self.energies) >= self.longest:
            low = len(self.energies) - self.search
            cut = min(range(low, len(self.energies)), key=self.energies.__getitem__) + 1
            yield self._span(cut)
            self.first, self.energies = self.first + cut, self.energies[cut:]
            self.speech, self.last_speech = sum(e > self.loud for e in self.energies), len(self.energies)


def _names(machine: type) -> list[str]:
    return [x.split()[0] for x in machine.schema.split(", ")]


def _finish(machine) -> list[tuple]:
    return list(machine.finish()) if hasattr(machine, "finish") else []


def _schema(df: DataFrame, keys: list[str], machine: type) -> str:
    return ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]) + ", " + machine.schema


def run_batch(df: DataFrame, keys: list[str], order: str, machine: type) -> DataFrame:
    """Rows with a null in a key are a key of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, key, now = [*keys, *_names(machine)], None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                its_key = tuple(None if pd.isna(getattr(row, k)) else getattr(row, k) for k in keys)
                if now is None or its_key != key:
                    out += [(*key, *event) for event in _finish(now)] if now else []
                    key, now = its_key, machine()
                out += [(*key, *event) for event in now.see(row)]
            yield pd.DataFrame(out, columns=names)
        if now:
            yield pd.DataFrame([(*key, *event) for event in _finish(now)], columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, _schema(df, keys, machine))


def run_stream(df: DataFrame, keys: list[str], order: str, machine: type, quiet_ms: int = 60_000) -> DataFrame:
    """Rows of a key have to arrive in order between micro-batches; inside one they are sorted. A key without rows
    for ``quiet_ms`` is finished."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = machine(json.loads(state.get[0]) if state.exists else None)
        if state.hasTimedOut:
            events = _finish(m)
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values(order)
            events = [event for row in rows.itertuples(index=False) for event in m.see(row)]
            state.update((json.dumps(m.state()),))
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame([(*key, *event) for event in events], columns=[*keys, *_names(machine)])

    return df.groupBy(*keys).applyInPandasWithState(step, _schema(df, keys, machine), "state string", "append", "ProcessingTimeTimeout")
