"""Small hand-made cases with known answers."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.functions.core import truthy
from touchline.functions.names import normal_name
from touchline.models import evaluate
from touchline.operators import grids, state
from touchline.operators.carries import rebuild_carries, with_carries
from touchline.plans import comparison, defending, fixtures, lineups, research
from touchline.schema import conform
from touchline.sources import store
from touchline.sources.feed import match_feed

BASE = dict(matchId="1", league="L", season="2024", h_a="h", teamId=1, teamName="A", opponentName="B", period="FirstHalf", outcomeType="Successful", x=50.0, y=34.0)


def events(spark, rows):
    out = []
    for n, r in enumerate(rows):
        out.append({**BASE, "eventId": n, "index": n, "playerId": 1, "playerName": "P", "minute": 0, "second": n, **r})
    keys = sorted({k for r in out for k in r})
    kinds = {"x": "double", "y": "double", "endX": "double", "endY": "double", "xG": "double", "minute": "int", "second": "int", "eventId": "bigint", "index": "bigint",
             "teamId": "bigint", "playerId": "bigint", "turnover": "boolean", "goalOwn": "boolean", "isShot": "boolean", "isGoal": "boolean"}
    ddl = ", ".join(f"`{k}` {kinds.get(k, 'string')}" for k in keys)
    return conform(spark.createDataFrame([tuple(r.get(k) for k in keys) for r in out], ddl))


def test_transition_numbers(spark):
    """Two losses: one won back in 5 s by a counterpress, one after 11 s."""
    away = dict(h_a="a", teamId=2, teamName="B", opponentName="A", playerName="Q")
    ev = events(spark, [
        dict(type="Dispossessed", second=0), dict(type="Pass", second=2, **away), dict(type="BallRecovery", second=5),
        dict(type="Pass", second=8), dict(type="Dispossessed", minute=1, second=0), dict(type="Pass", minute=1, second=5, **away), dict(type="Pass", minute=1, second=11)])
    r = defending.transition_summary(defending.loss_sequences(ev)).where("teamName = 'A'").first()
    assert (r.opportunities, r.counterpress_actions, r.counterpress_regains) == (2, 1, 1)
    assert (r.avg_recovery_seconds, r.median_recovery_seconds, r.within_5_seconds, r.within_15_seconds, r.counterpress_success_pct) == (8.0, 8.0, 1, 2, 50.0)


def test_own_goal_credits_opponent(spark):
    ev = events(spark, [dict(type="Goal", isGoal=True), dict(type="Goal", isGoal=True, goalOwn=True), dict(type="Pass")])
    assert [(r.home_score_before, r.away_score_before) for r in state.with_score(ev).orderBy("index").collect()] == [(0, 0), (1, 0), (1, 1)]


def test_carry_needs_distance_time_and_follower(spark):
    ev = state.with_match_clock(events(spark, [
        dict(type="Pass", endX=50.0, endY=34.0, second=0), dict(type="Pass", x=60.0, endX=70.0, endY=34.0, second=4), dict(type="Pass", x=71.0, endX=80.0, endY=34.0, second=8)]))
    made = with_carries(ev).where("is_generated").collect()
    assert [(r.x, r.endX, r.event_ord) for r in made] == [(50.0, 60.0, 0.5)]


def test_rebuilding_carries_changes_nothing(spark, sf):
    first = with_carries(state.with_match_clock(match_feed(spark, sf, pace=4)))
    again = rebuild_carries(first)
    cols = ["matchId", "index", "event_ord", "type"]
    assert sorted(map(tuple, first.select(cols).collect())) == sorted(map(tuple, again.select(cols).collect()))


def test_clock_continues_and_breaks(spark):
    ev = events(spark, [dict(minute=47, second=0, type="Pass"), dict(minute=45, second=0, type="Pass", period="SecondHalf"), dict(minute=95, second=0, type="Pass", period="SecondPeriodOfExtraTime")])
    got = [r.cumulative_mins for r in state.with_match_clock(ev).orderBy("index").collect()]
    assert got == [47.0, 47.0, None]


def test_dedupe_keeps_first(spark):
    rows = spark.createDataFrame([("1", 1, 7, 0, 0.4), ("1", 1, 7, 1, 0.9), ("1", 2, 7, 0, 0.1)], "matchId string, teamId int, eventId int, seq int, v double")
    assert sorted(tuple(r)[:5] for r in store.dedupe_events(rows).collect()) == [("1", 1, 7, 0, 0.4), ("1", 2, 7, 0, 0.1)]


def test_truthy_words(spark):
    df = spark.createDataFrame([("1",), ("True",), ("yes",), ("0",), ("nan",), (None,), ("2.5",), ("no",)], "v string")
    assert [r[0] for r in df.select(truthy(F.col("v"))).collect()] == [True, True, True, False, False, False, True, False]


def test_feed_check_values(spark):
    f = match_feed(spark, "/root/testdata/sf0.01")
    r = f.agg(F.count("*"), F.count_distinct("matchId"), F.count_distinct("teamName"), F.count_if("isGoal"), F.count_if(F.col("outcomeType") == "Successful"), F.sum("minute")).first()
    assert tuple(r) == (10000, 20, 20, 93, 7470, 444200)


def test_epv_edges(spark):
    df = spark.createDataFrame([(0.0,), (104.99,), (105.0,), (105.1,), (None,)], "x double")
    assert [r[0] for r in df.select(grids.cell(F.col("x"), 105.0, 32)).collect()] == [0, 31, 31, None, None]


def test_grid_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("0.1,0.2\n0.3,0.4\n")
    assert sorted(map(tuple, grids.read_grid(spark, str(tmp_path / "g.csv")).collect())) == [(0, 0, 0.1), (0, 1, 0.2), (1, 0, 0.3), (1, 1, 0.4)]


@pytest.mark.parametrize("minutes, windows", [
    ([], [(0, 90)]), ([5], [(0, 90)]), ([60, 65, 80], [(0, 60), (60, 80), (80, 90)]),
    ([46, 50, 58, 85], [(0, 46), (46, 58), (58, 90)]), ([88], [(0, 90)])])
def test_substitution_windows(spark, minutes, windows):
    rows = [("m", "A", "FormationSet", 0)] + [("m", "A", "SubstitutionOn", v) for v in minutes]
    df = spark.createDataFrame(rows, "matchId string, teamName string, type string, minute int")
    got = [(r.minute_start, r.minute_end) for r in lineups.merged_windows(df).orderBy("window").collect()]
    assert got == windows


def test_contested_slot_moves_earlier_player(spark):
    rows = [("m", "A", "FormationSet", 0, None, 1, None, 2, [(p, p if p <= 11 else 0) for p in range(1, 14)]),
            ("m", "A", "SubstitutionOn", 60, 12, 3, 2, None, None), ("m", "A", "SubstitutionOff", 60, 5, 2, None, None, None)]
    df = spark.createDataFrame([(a, b, t, m, p, e, 5 if t == "SubstitutionOn" else None, f, pl, 2 if t == "SubstitutionOn" else None) for a, b, t, m, p, e, _, f, pl in rows],
                               "matchId string, teamName string, type string, minute int, playerId bigint, eventId bigint, slot int, formation_id int, players array<struct<playerId:bigint,slot:int>>, relatedEventId bigint")
    last = {r.playerId: r.slot for r in lineups.lineup_phases(df).where("phase = 1").collect()}
    assert len(last) == 11 and sorted(last.values()) == list(range(1, 12)) and last[12] == 5 and 5 not in last


def test_rounds_split_and_orphans(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [("L", "S", "1", d(1), "A", "B"), ("L", "S", "2", d(2), "C", "D"), ("L", "S", "3", d(8), "A", "C"), ("L", "S", "4", d(14), "B", "D"), ("L", "S", "5", d(15), "B", "A")]
    df = spark.createDataFrame(rows, "league string, season string, match_id string, date date, home_team string, away_team string")
    assert [r.round for r in fixtures.infer_rounds(df).orderBy("match_id").collect()] == [1, 1, 2, 3, 4]
    assert [r.round for r in fixtures.infer_rounds(df, merge_orphans=True).orderBy("match_id").collect()] == [1, 1, 1, 1, 1]


def test_ambiguous_fixture_is_refused(spark):
    d = dt.date(2024, 1, 1)
    fx = spark.createDataFrame([("L", "S", "f1", d, "Real Madrid", "Sevilla"), ("L", "S", "f2", d, "Getafe", "Betis")], "league string, season string, fixture_id string, date date, home_team string, away_team string")
    mt = spark.createDataFrame([("L", "S", "m1", d, "Real Madrid", "Sevilla FC"), ("L", "S", "m2", d, "Real Madrid", "Sevilla FC"), ("L", "S", "m3", d + dt.timedelta(days=1), "Getafe CF", "Betis")],
                               "league string, season string, match_id string, date date, home_team string, away_team string")
    got = {r.fixture_id: (r.match_id, r.problem) for r in fixtures.resolve_fixtures(fx, mt).collect()}
    assert got == {"f1": (None, "ambiguous"), "f2": ("m3", None)}


def test_share_below_counts_strictly(spark):
    v = spark.createDataFrame([("k", float(n)) for n in (1, 2, 2, 3)], "k string, value double")
    p = spark.createDataFrame([("k", "lo", 1.0), ("k", "mid", 2.0), ("k", "hi", 9.0)], "k string, name string, value double")
    assert {r.name: r.s for r in comparison.share_below(v, p, ["k"], "s").collect()} == {"lo": 0.0, "mid": 25.0, "hi": 100.0}


def test_publish_twice_keeps_one_copy(spark, sf, tmp_path):
    ev = match_feed(spark, sf).select("league", "season", "matchId", "startDate", "eventId", "index", "teamName", "type", "x")
    root = str(tmp_path / "events")
    assert store.publish(ev, root).count() == 2
    assert store.publish(ev, root).count() == 0
    assert store.read_events(spark, root).count() == 1000


def test_slot_taken_after_a_formation_change(spark):
    """The change at 60 hands out slots; the player who comes on at 70 into slot 11 keeps it, the earlier holder moves."""
    start = [(p, p if p <= 11 else 0) for p in range(1, 14)]
    rows = [("FormationSet", 0, None, 1, None, 2, start, None), ("FormationChange", 60, None, 2, None, 5, [(4, 11), (11, 4)], None),
            ("SubstitutionOff", 70, 5, 3, None, None, None, None), ("SubstitutionOn", 70, 12, 4, 11, None, None, 3)]
    df = spark.createDataFrame([("m", "A", *r) for r in rows], "matchId string, teamName string, type string, minute int, playerId bigint, eventId bigint, slot int, "
                               "formation_id int, players array<struct<playerId:bigint,slot:int>>, relatedEventId bigint")
    full = spark.createDataFrame([("m", 97)], "matchId string, minute int")
    out = lineups.lineup_phases(df, full)
    assert sorted({(r.phase, r.start, r.end) for r in out.collect()}) == [(0, 0, 60), (1, 60, 70), (2, 70, 97)]
    last = {r.playerId: r.slot for r in out.where("phase = 2").collect()}
    assert last[12] == 11 and last[4] == 5 and len(last) == 11 and 5 not in last


def test_names_of_all_latin_letters(spark):
    names = ["Beşiktaş", "Śląsk Wrocław", "Fenerbahçe", "Þór Akureyri", "Großaspach", "Øster Ærø"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(normal_name(F.col("name"))).collect()] == ["besiktas", "slask wroclaw", "fenerbahce", "thor akureyri", "grossaspach", "oster aero"]
    known = spark.createDataFrame([("Besiktas",), ("Olimpiacos",), ("Himki",)], "name string")
    wanted = spark.createDataFrame([("Beşiktaş",), ("Olympiacos",), ("Khimki",), ("Xx",)], "name string")
    assert {r.name: r.known for r in fixtures.match_names(wanted, known).collect()} == {"Beşiktaş": "Besiktas", "Olympiacos": "Olimpiacos", "Khimki": "Himki"}


def test_metrics_of_rare_events(spark):
    rows = spark.createDataFrame([(1, 0.00004)] * 5 + [(0, 0.00001)] * 20, "y int, q double")
    r = evaluate.model_metrics(rows, "y", "q").first()
    assert (r.roc_auc, r.average_precision) == (1.0, 1.0)


def test_large_grid_is_read_whole(spark, tmp_path):
    (tmp_path / "g.csv").write_text("\n".join(",".join(f"{r}.{c:03d}" for c in range(100)) for r in range(3000)))
    got = grids.read_grid(spark, str(tmp_path / "g.csv"))
    assert got.count() == 300_000 and got.where("row = 2999 and col = 7").first().value == 2999.007
    assert grids.sent_grid(got, 2, 3).count() == 6


def test_control_sequences_cross_spans(spark, sf, monkeypatch):
    """Spans and runs of any length give the same numbers."""
    feed = match_feed(spark, sf)
    want = sorted(map(tuple, research.control_sequences(feed).collect()), key=str)
    monkeypatch.setattr(research, "SPAN", 37)
    monkeypatch.setattr(research, "RUN", 5)
    assert sorted(map(tuple, research.control_sequences(feed).collect()), key=str) == want


def test_a_season_folder_gets_one_file_not_one_of_each_task(spark, tmp_path):
    rows = spark.range(0, 900, 1, 6).select(F.lit("L").alias("league"), (F.col("id") % 5).cast("string").alias("season"), F.col("id").cast("string").alias("matchId"))
    store.write_season_tables({"t": rows}, str(tmp_path), "test")
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 5
    assert store.read_season_table(spark, str(tmp_path), "t", "league string, season string, matchId string").count() == 900


def test_hulls_come_from_batches_of_players(spark):
    at = [("1", "a", 0.0, 0.0), ("1", "a", 4.0, 0.0), ("1", "a", 4.0, 3.0), ("1", "a", 0.0, 3.0), ("1", "a", 2.0, 1.0), ("1", "a", 2.04, 1.0), ("1", "b", 5.0, 5.0), ("2", "a", 1.0, 1.0),
          ("2", "a", 2.0, 2.0)]
    out = research.action_hulls(spark.createDataFrame(at, "matchId string, playerName string, x double, y double").withColumn("type", F.lit("Tackle")))
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()  # a call to Python for each player of a match
    assert sorted(map(tuple, out.collect())) == [("1", "a", 5, 4, 12.0), ("1", "b", 1, 1, 0.0), ("2", "a", 2, 2, 0.0)]


def test_carries_and_their_events_come_out_of_one_scan(spark, sf):
    out = with_carries(state.with_match_clock(match_feed(spark, sf, pace=4))).select("matchId", "event_ord", "index", "is_generated")
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    again = rebuild_carries(with_carries(state.with_match_clock(match_feed(spark, sf, pace=4))))
    assert again.schema["index"].metadata == {"below": 2000}  # so that its scans are plain windows
