"""State by key for the exact streams: what is known about a run record or a call."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TRIAL_CHANGES = "source string, change bigint"
PAIRED = ("call_id bigint, end_no bigint, tool string, status string, text string, started_at timestamp, ended_at timestamp, "
          "reason string")
DAY_MS = 86_400_000


def plain(value: object) -> object:
    return None if pd.isna(value) else value


class Keyed(StatefulProcessor):
    """State that expires ``days`` after a key's last row, or never."""

    def __init__(self, days: int | None) -> None:
        self.days = days

    def remember(self, handle: StatefulProcessorHandle, name: str, schema: str):
        self.handle = handle
        return handle.getValueState(name, schema) if self.days is None else handle.getValueState(name, schema, self.days * DAY_MS)

    def close(self) -> None:
        pass


class FirstTrials(Keyed):
    """The earliest trial of a run record, by time and then source; records without one are one record."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = self.remember(handle, "first", "ts timestamp, source string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        best = before = tuple(self.first.get()) if self.first.exists() else None
        order = lambda x: (not pd.isna(x[0]), x[0] if not pd.isna(x[0]) else 0, x[1] is not None, x[1] or "")
        for frame in rows:
            for ts, source in zip(frame["ts"], frame["source"]):
                row = (plain(ts), plain(source))
                if best is None or order(row) < order(best):
                    best = row
        if best is not before:
            self.first.update(best)
            gone = [] if before is None else [(before[1], -1)]
            if not gone or gone[0][0] != best[1]:
                yield pd.DataFrame([*gone, (best[1], 1)], columns=["source", "change"])


class CallPairs(Keyed):
    """All starts and ends of a call; an end is paired with every start at or before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        end = "tool:string,status:string,text:string,ts:timestamp,paired:boolean"
        self.call = self.remember(handle, "call", f"starts array<timestamp>, ends array<struct<{end}>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        starts, ends = self.call.get() if self.call.exists() else ([], [])
        starts, ends = list(starts), [tuple(x) for x in ends]
        old_starts, old_ends = len(starts), len(ends)
        for frame in rows:
            for kind, ts, tool, status, text in zip(frame["kind"], frame["ts"], frame["tool"], frame["status"], frame["text"]):
                ts = ts.to_pydatetime()
                if kind == "start":
                    starts.append(ts)
                elif kind == "end":
                    ends.append((plain(tool), plain(status), plain(text), ts, False))
        out = []
        for no, (tool, status, text, ended, paired) in enumerate(ends):
            fresh = no >= old_ends
            found = [s for s in (starts if fresh else starts[old_starts:]) if s <= ended]
            reason = "paired" if fresh or paired else "late-start"
            out += [(key[0], no, tool, status, text, s, ended, reason) for s in found]
            if fresh and not found:
                out.append((key[0], no, tool, status, text, None, ended, "no-start"))
            ends[no] = (tool, status, text, ended, paired or bool(found))
        self.call.update((starts, ends))
        if out:
            frame = pd.DataFrame(out, columns=["call_id", "end_no", "tool", "status", "text", "started_at", "ended_at", "reason"])
            yield frame.astype({"started_at": "datetime64[ns]", "ended_at": "datetime64[ns]"})


# ---- many keys a state: what is kept for good, by bucket of keys --------------------
def micros(times: pd.Series) -> list[int]:
    """Microseconds, the smallest number for a missing time."""
    return times.to_numpy("datetime64[us]").astype(np.int64).tolist()


def times(values: list[int | None]) -> np.ndarray:
    missing = np.iinfo(np.int64).min
    return np.array([missing if v is None else v for v in values], np.int64).view("datetime64[us]").astype("datetime64[ns]")


def texts(values: pd.Series) -> list[str | None]:
    return [plain(v) for v in values]


class Bucket(StatefulProcessor):
    """What is known about all keys of a bucket, as one value: a call into the state store a batch, not one a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("known", "rows binary")

    def load(self) -> dict:
        return pickle.loads(self.state.get()[0]) if self.state.exists() else {}

    def store(self, known: dict) -> None:
        self.state.update((pickle.dumps(known),))

    def close(self) -> None:
        pass


class FirstTrialsOfMany(Bucket):
    """``FirstTrials`` for a bucket of run records."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known, before = self.load(), {}
        for frame in rows:
            for record, ts, source in zip(texts(frame["run_record"]), micros(frame["ts"]), texts(frame["source"])):
                row, best = (ts, source is not None, source or ""), known.get(record)
                if best is None or row < best:
                    before.setdefault(record, best)
                    known[record] = row
        name = lambda x: x[2] if x[1] else None
        out = []
        for record, old in before.items():
            if old is None or name(old) != name(known[record]):
                out += ([] if old is None else [(name(old), -1)]) + [(name(known[record]), 1)]
        if before:
            self.store(known)
        if out:
            yield pd.DataFrame(out, columns=["source", "change"])


class CallPairsOfMany(Bucket):
    """``CallPairs`` for a bucket of calls."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known, fresh = self.load(), {}
        for frame in rows:
            for call, kind, ts, *end in zip(texts(frame["call_id"]), frame["kind"], micros(frame["ts"]), *(texts(frame[c]) for c in ("tool", "status", "text"))):
                starts, ends = known.setdefault(call, ([], []))
                fresh.setdefault(call, (len(starts), len(ends)))
                if kind == "start":
                    starts.append(ts)
                elif kind == "end":
                    ends.append((*end, ts, False))
        out = []
        for text_id, (old_starts, old_ends) in fresh.items():  # as text, so that a missing one makes no numbers of the others
            call, (starts, ends) = None if text_id is None else int(text_id), known[text_id]
            for no, (tool, status, text, ended, paired) in enumerate(ends):
                new = no >= old_ends
                found = [s for s in (starts if new else starts[old_starts:]) if s <= ended]
                reason = "paired" if new or paired else "late-start"
                out += [(call, no, tool, status, text, s, ended, reason) for s in found]
                if new and not found:
                    out.append((call, no, tool, status, text, None, ended, "no-start"))
                ends[no] = (tool, status, text, ended, paired or bool(found))
        self.store(known)
        if out:
            frame = pd.DataFrame(out, columns=["call_id", "end_no", "tool", "status", "text", "started_at", "ended_at", "reason"])
            yield frame.astype({"call_id": "Int64"}).assign(started_at=times([x[5] for x in out]), ended_at=times([x[6] for x in out]))
