"""Stream forms of the match operators. Each takes rows with event time ``ts`` (batch or stream alike).

A function applied to a finished match in batch gives what the stream gives once its watermark has
passed: the stream adds only ``with_event_time`` before and a sink after.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.functions import predicates as p
from touchline.functions.core import fsum, n_if, pct
from touchline.schema import conform, event_ddl

LATE = "2 minutes"


def c(name):
    return F.col(name)


def with_event_time(rows: DataFrame, delay: str = LATE) -> DataFrame:
    return rows.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", delay)


def read_landed(spark: SparkSession, root: str, schema: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Event files as they land."""
    reader = spark.readStream.schema(schema or event_ddl())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(root)


def land(stream: DataFrame, root: str, checkpoint: str, keys=("matchId", "teamId", "eventId")):
    """Append each micro-batch once: a batch writes its own folder, so a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        conform(batch).dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{root}/batch={number}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_late(rows: DataFrame, keys=("matchId", "teamId", "eventId")) -> DataFrame:
    """Repeats inside the watermark are dropped; in batch all repeats are."""
    return rows.dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else rows.dropDuplicates(list(keys))


def team_windows(rows: DataFrame, length: str = "15 minutes") -> DataFrame:
    """Tumbling windows per match and team: passes, accuracy, pressing actions, turnovers."""
    passed = p.is_pass()
    g = rows.groupBy(F.window("ts", length).alias("w"), "matchId", "teamName").agg(
        F.count("*").alias("events"), n_if(passed).alias("passes"), n_if(passed & p.completed()).alias("completed"), n_if(p.kind(*p.PRESS_TYPES)).alias("press_actions"),
        n_if(F.coalesce(c("turnover"), F.lit(False)) | (c("type") == "Dispossessed")).alias("turnovers"))
    return g.select(c("w.start").alias("window_start"), "matchId", "teamName", "events", "passes", pct(c("completed"), c("passes")).alias("pass_accuracy_pct"), "press_actions", "turnovers")


def sliding_momentum(rows: DataFrame, value: str = "xT", length: str = "3 minutes", step: str = "1 minute", cap: float = 0.1) -> DataFrame:
    """Best and total capped action value per team in sliding windows."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(cap), F.coalesce(c(value), F.lit(0.0))))
    g = rows.where(p.on_ball_success()).groupBy(F.window("ts", length, step).alias("w"), "matchId", "teamName").agg(F.max(v).alias("best"), fsum(v).alias("total"))
    return g.select(c("w.start").alias("window_start"), "matchId", "teamName", "best", "total")


def pressure_spells(rows: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Spells of pressing actions of a team, closed by a quiet gap."""
    g = rows.where(p.kind(*p.PRESS_TYPES)).groupBy(F.session_window("ts", gap).alias("s"), "matchId", "teamName").agg(F.count("*").alias("actions"), n_if(p.completed()).alias("won"))
    return g.select(c("s.start").alias("spell_start"), c("s.end").alias("spell_end"), "matchId", "teamName", "actions", "won")


def shot_leadups(shots: DataFrame, actions: DataFrame, seconds: int = 15) -> DataFrame:
    """Shots with the same side's actions in the seconds before. Both streams need a watermark."""
    s = shots.select(c("matchId").alias("s_match"), c("teamName").alias("s_team"), c("eventId").alias("shot_id"), c("ts").alias("shot_ts"))
    a = actions.select("matchId", "teamName", "eventId", "type", "ts")
    return s.join(a, (c("s_match") == c("matchId")) & (c("s_team") == c("teamName")) & (c("ts") < c("shot_ts"))
                  & (c("ts") >= c("shot_ts") - F.expr(f"INTERVAL {seconds} SECONDS"))).select("matchId", "teamName", "shot_id", "eventId", "type")


SCORE_OUT = "matchId string, eventId bigint, index bigint, home_score_before bigint, away_score_before bigint"
SCORE_STATE = "home bigint, away bigint"


def _score(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    home, away = state.get if state.exists else (0, 0)
    # a group comes in several pieces in no order; all of them are put in order by position first
    for pdf in [pd.concat(list(frames)).sort_values("index")]:
        goal = pdf["type"].eq("Goal")
        own = pdf["goalOwn"].fillna(False).astype(bool)
        for_home = goal & (pdf["h_a"].eq("h") != own)
        for_away = goal & (pdf["h_a"].eq("h") == own)
        before_h = home + for_home.cumsum() - for_home
        before_a = away + for_away.cumsum() - for_away
        yield pd.DataFrame({"matchId": key[0], "eventId": pdf["eventId"], "index": pdf["index"], "home_score_before": before_h.astype("int64"), "away_score_before": before_a.astype("int64")})
        home, away = home + int(for_home.sum()), away + int(for_away.sum())
    state.update((home, away))
    state.setTimeoutDuration(6 * 3600 * 1000)


def running_score(stream: DataFrame) -> DataFrame:
    """Score before each event, two numbers of state per match; rows of a match must arrive in order."""
    return stream.select("matchId", "eventId", "index", "type", "h_a", "goalOwn").groupBy("matchId").applyInPandasWithState(
        _score, SCORE_OUT, SCORE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


REGAIN_OUT = "matchId string, teamName string, loss_id bigint, regain_id bigint, seconds bigint"
REGAIN_STATE = "ids array<bigint>, times array<bigint>, periods array<string>"


def regain_timer(stream: DataFrame, limit: int = 60, quiet_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """Open losses of a side wait for its next controlling action of the same period; after ``limit`` seconds, in the next
    period, or when the side stays quiet for ``quiet_ms``, they close empty.

    State holds the losses of at most ``limit`` seconds of one side.
    """
    from touchline.plans.defending import confirms_control, is_loss

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(zip(*state.get)) if state.exists else []
        out = []
        if state.hasTimedOut:
            out = [(i, None, None) for i, _, _ in waiting]
            state.remove()
        else:
            # a group comes in several pieces in no order
            for r in pd.concat(list(frames)).sort_values("index").itertuples():
                late = lambda w: w[2] != r.period or not 0 <= r.t - w[1] <= limit  # noqa: E731, B023
                out += [(w[0], None, None) for w in waiting if late(w)]
                waiting = [w for w in waiting if not late(w)]
                if r.control:
                    out += [(i, r.eventId, r.t - t) for i, t, _ in waiting]
                    waiting = []
                if r.loss:
                    waiting.append((r.eventId, r.t, r.period))
            state.update(tuple([w[k] for w in waiting] for k in range(3)))
            state.setTimeoutDuration(quiet_ms)
        rows = [(key[0], key[1], *o) for o in out]
        yield pd.DataFrame(rows, columns=["matchId", "teamName", "loss_id", "regain_id", "seconds"]).astype({"regain_id": "Int64", "seconds": "Int64"})

    t = (c("minute") * 60 + c("second")).cast("bigint")
    rows = stream.select("matchId", "teamName", "eventId", "index", "period", t.alias("t"), is_loss().alias("loss"), confirms_control().alias("control")).where("loss or control")
    return rows.groupBy("matchId", "teamName").applyInPandasWithState(step, REGAIN_OUT, REGAIN_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def merge_schedule(ledger: DataFrame, feed: DataFrame) -> DataFrame:
    """Latest feed row per fixture onto the ledger.

    Published fixtures stay; cancelled and postponed ones take the feed's state; a changed kick-off resets
    the attempts; everything else keeps its ledger state.
    """
    last = feed.groupBy("fixture_id").agg(F.max_by(F.struct("kickoff", "state"), "seq").alias("f"))
    out = ledger.join(last, "fixture_id", "full")
    moved = c("f.kickoff").isNotNull() & ~c("f.kickoff").eqNullSafe(c("kickoff"))
    done = F.coalesce(c("state") == "uploaded", F.lit(False))
    state = (F.when(done, "uploaded").when(c("f.state").isin("cancelled", "postponed"), c("f.state")).when(c("state").isNull() | moved, "pending").otherwise(c("state")))
    return out.select("fixture_id", F.when(done, c("kickoff")).otherwise(F.coalesce("f.kickoff", "kickoff")).alias("kickoff"), state.alias("state"),
                      F.when(done | ~F.coalesce(moved, F.lit(False)), F.coalesce("attempts", F.lit(0))).otherwise(0).alias("attempts"))


def schedule_upserts(feed: DataFrame, ledger_root: str, checkpoint: str):
    """Apply each batch of schedule rows to the ledger, one version folder per batch."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger = spark.read.parquet(f"{ledger_root}/v={number - 1}") if number else spark.createDataFrame([], "fixture_id string, kickoff timestamp, state string, attempts int")
        merge_schedule(ledger, batch).write.mode("overwrite").parquet(f"{ledger_root}/v={number}")
    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(rows: DataFrame, delay_seconds: int = 120) -> DataFrame:
    """Rows that arrived after the watermark of their match had passed them: the ones a stream would drop.

    The watermark before a row is the largest event time among rows of earlier arrival; arrivals are folded
    per (match, arrival) first, so the ordered window sees arrivals, not rows.
    """
    per = rows.groupBy("matchId", "arrival").agg(F.max("ts").alias("_m"))
    w = W.partitionBy("matchId").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    mark = per.select("matchId", "arrival", F.max("_m").over(w).alias("_mark"))
    out = rows.join(mark, ["matchId", "arrival"])
    return out.where(c("ts") < c("_mark") - F.expr(f"INTERVAL {delay_seconds} SECONDS")).drop("_mark")


