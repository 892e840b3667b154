"""Possession numbers on a stream, rows in any order over batches.

State of a match is the last counted row, the number and team of the possession, the next position, and the rows that wait for an earlier position. A row
is numbered as soon as every position before it is there. A gap that stays open is given up by an event-time timer: once the watermark has passed
a waiting row by `patience`, the row and what follows it go on without the missing ones, and a row that comes even later is handed on as late, without a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.operators.state import ENDS_POSSESSION, OUTSIDE_POSSESSION, TAKES_CONTROL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "matchId string, eventId long, index long, possession_id long, possession_team string, late boolean"
PLACE = "next long, number long, team string, before_team string, before_lost boolean, before_ends boolean, before_goal boolean, before_failed boolean"
WAITING = "index long, eventId long, team string, outside boolean, takes boolean, lost boolean, ends boolean, goal boolean, failed boolean, ms long"
ROW = [part.split()[0] for part in WAITING.split(", ")]


class Numbering(StatefulProcessor):
    """The view rule over a match's rows in the order of their position."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.waiting = handle.getListState("waiting", WAITING)

    def _load(self):
        place = dict(zip([p.split()[0] for p in PLACE.split(", ")], self.place.get())) if self.place.exists() else {
            "next": 0, "number": 0, "team": None, "before_team": None, "before_lost": False, "before_ends": False, "before_goal": False, "before_failed": False}
        return place, {r[0]: tuple(r) for r in (self.waiting.get() if self.waiting.exists() else ())}

    def _save(self, place: dict, waiting: dict) -> None:
        self.place.update(tuple(place.values()))
        if waiting:
            self.waiting.put([waiting[i] for i in sorted(waiting)])
        elif self.waiting.exists():
            self.waiting.clear()

    def _numbered(self, place: dict, waiting: dict) -> list[tuple]:
        """Rows from the next position on, as far as there is no gap."""
        out = []
        while place["next"] in waiting:
            index, event, team, outside, takes, lost, ends, goal, failed, _ = waiting.pop(place["next"])
            place["next"] = index + 1
            if outside:
                out.append((event, index, None, None, False))
                continue
            other = place["before_team"] is not None and team is not None and team != place["before_team"]
            change = place["before_goal"] or (other and (lost or takes or place["before_lost"] or place["before_ends"] or place["before_failed"]))
            first = place["number"] == 0
            if first or change:
                place["team"] = team
                place["number"] += 1
            place.update(before_team=team, before_lost=lost, before_ends=ends, before_goal=goal, before_failed=failed)
            out.append((event, index, place["number"], place["team"], False))
        return out

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["eventId", "index", "possession_id", "possession_team", "late"])
        frame.insert(0, "matchId", key[0])
        return frame.astype({"eventId": "Int64", "index": "Int64", "possession_id": "Int64", "late": "boolean"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place, waiting = self._load()
        out = []
        for pdf in rows:
            for r in pdf[ROW].itertuples(index=False, name=None):
                if pd.isna(r[0]) or r[0] < place["next"]:
                    out.append((r[1], r[0], None, None, True))
                else:
                    waiting[int(r[0])] = (int(r[0]), *(None if pd.isna(v) else v for v in r[1:3]), *map(bool, r[3:9]), int(r[9]))
        out += self._numbered(place, waiting)
        self._save(place, waiting)
        if waiting:
            self.handle.registerTimer(min(w[9] for w in waiting.values()) + self.patience)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        place, waiting = self._load()
        passed, out = timerValues.getCurrentWatermarkInMs() - self.patience, []
        while waiting and any(w[9] <= passed for w in waiting.values()):
            place["next"] = min(waiting)
            out += self._numbered(place, waiting)
        self._save(place, waiting)
        if waiting:
            self.handle.registerTimer(min(w[9] for w in waiting.values()) + self.patience)
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def possession_stream(stream: DataFrame, patience_seconds: int = 120) -> DataFrame:
    """(matchId, eventId, index, possession_id, possession_team, late) of a stream with a watermark on ``ts``. The session must use the
    RocksDB state store (`ROCKSDB`); positions of a match are dense from 0, as the canonical index is."""
    c, flag = F.col, lambda cond: F.coalesce(cond, F.lit(False))
    rows = stream.select(
        "matchId", "ts", "index", "eventId", c("teamName").alias("team"), flag(c("type").isin(OUTSIDE_POSSESSION)).alias("outside"),
        flag(c("type").isin(TAKES_CONTROL) & (c("outcomeType") == "Successful")).alias("takes"), flag(c("turnover")).alias("lost"),
        flag(c("type").isin(ENDS_POSSESSION)).alias("ends"), flag(c("type") == "Goal").alias("goal"),
        flag(c("outcomeType") == "Unsuccessful").alias("failed"), F.unix_millis("ts").alias("ms"))
    return rows.groupBy("matchId").transformWithStateInPandas(Numbering(patience_seconds * 1000), OUT, "Append", "EventTime")
