"""Voice segments of a stream of frames, with the state of each key in typed state variables and event-time timers.

The same machine as ``stateful.VoiceSegments`` over batches. Its counters are one row of a value state, the energies of
the utterance under way a list state, so that a store can change its schema; a timer ends a key that has had no frames
for a while of event time, whatever the clock says. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.streaming.stateful import VoiceSegments

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNTERS = "floor double, onsets int, held int, first bigint, speech int, quiet int, last_speech int, frames bigint, timer bigint"
_NAMES = [c.split()[0] for c in _COUNTERS.split(", ")]


class VoiceProcessor(StatefulProcessor):
    """Rows (kind, start, end): utterances, and after each micro-batch how far a key is settled."""

    def __init__(self, keys: list[str], quiet_ms: int):
        self.keys, self.quiet_ms = keys, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", _COUNTERS)
        self.energies = handle.getListState("energies", "db double")

    def _machine(self) -> tuple[VoiceSegments, int, int | None]:
        if not self.counters.exists():
            return VoiceSegments(), 0, None
        held = dict(zip(_NAMES, self.counters.get(), strict=True))
        frames, timer = held.pop("frames"), held.pop("timer")
        energies = [x[0] for x in self.energies.get()] if self.energies.exists() else []
        return VoiceSegments(held | {"energies": energies}), frames, timer

    def _keep(self, machine: VoiceSegments, frames: int, timer: int) -> None:
        state = machine.state()
        self.counters.update((*[state[n] for n in _NAMES[:-2]], frames, timer))
        if state["energies"]:
            self.energies.put([(float(x),) for x in state["energies"]])
        else:
            self.energies.clear()

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["kind", "start", "end"]).astype({"start": "float64", "end": "float64"})
        for k, name in reversed(list(enumerate(self.keys))):
            out.insert(0, name, key[k])
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine, frames, timer = self._machine()
        batch = pd.concat(list(rows)).sort_values("frame_no")
        out = [("utterance", *span) for row in batch.itertuples(index=False) for span in machine.see(row)]
        frames = int(batch["frame_no"].iloc[-1]) + 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(pd.Timestamp(batch["at"].max()).timestamp() * 1000) + self.quiet_ms
        self.handle.registerTimer(timer)
        self._keep(machine, frames, timer)
        yield self._frame(key, [*out, ("settled", machine.settled_through(frames), None)])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, frames, _ = self._machine()
        out = [("utterance", *span) for span in machine.finish()]
        self.counters.clear()
        self.energies.clear()
        yield self._frame(key, [*out, ("settled", frames * machine.frame, None)])

    def close(self) -> None:
        pass


def voice_stream(frames: DataFrame, keys: list[str], late: str = "10 seconds", quiet_ms: int = 5_000) -> DataFrame:
    """A stream of frames (keys, frame_no, db, at) to rows (keys, kind, start, end). Frames of a key arrive
    in order between micro-batches; inside one they are sorted. A key is ended once the watermark is ``quiet_ms`` past its
    last frame."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = ", ".join([*[f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys], "kind string, start double, end double"])
    return frames.withWatermark("at", late).groupBy(*keys).transformWithStateInPandas(VoiceProcessor(keys, quiet_ms), schema, "Append", "EventTime")
