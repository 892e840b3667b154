"""Defender ledgers, duel profiles, spread of pass lengths and possession-adjusted tables: ties, nulls, single rows, empty tables."""
from pyspark.sql import functions as F

from touchline.plans import attacking as a, duels as d, lineups as ln, research as r

ENTRY = "matchId int, opponentName string, kind string, minute int, player string, end_y double, led_to_shot boolean, led_to_goal boolean, last_defender string, uncontested boolean"
ACT = "matchId int, teamName string, playerName string, type string, outcomeType string, x double, y double"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def test_ledger_counts_homes_ties_and_missing_names(spark):
    en = entries(spark, [(1, "A", "box", 70, "z", 10.0, True, False, "d1", False), (1, "A", "final_third", 10, "y", 10.0, False, False, "d1", False),
                         (1, "A", "exit", 10, "y", 10.0, True, True, "d1", False), (1, "A", "box", 90, None, 10.0, True, True, "d2", False),
                         (1, "A", "box", 5, "z", 60.0, True, False, None, True), (1, "A", "box", 6, "z", 30.0, False, False, None, True)])
    acts = spark.createDataFrame([(1, "A", "d1", "Tackle", "Successful", 35.0, 4.0), (1, "A", "d1", "Tackle", "Successful", 20.0, 10.0), (1, "A", "d1", "Clearance", "Successful", 36.0, 60.0),
                                  (1, "A", "d3", "Interception", "Successful", 10.0, 34.0), (1, "A", None, "Tackle", "Successful", 10.0, 34.0), (1, "B", "d1", "Pass", "Successful", 10.0, 34.0)], ACT).withColumn("qualifiers", F.array().cast("array<string>"))
    ledger = a.defender_ledger(en, acts)
    got = {x.defender: x for x in ledger.collect()}
    assert set(got) == {"d1", "d2", "d3"}
    one = got["d1"]
    assert (one.beaten, one.to_shot, one.to_goal, one.late, one.stops, one.stop_rate_pct) == (2, 1, 0, 1, 3, 60.0)
    # Places 4 and 10 lie in the right lane; equal attackers go by name; one action makes no home.
    assert (one.home_lane, one.top_attacker, one.top_attacker_times) == ("right", "y", 1)
    assert (got["d2"].top_attacker, got["d2"].stops, got["d2"].stop_rate_pct) == (None, 0, 0.0)
    assert (got["d3"].home_lane, got["d3"].beaten, got["d3"].stop_rate_pct) == (None, 0, 100.0)
    lanes = {x.own_lane: (x.entries, x.to_shot, x.owners) for x in a.uncontested_lanes(en, ledger).collect()}
    assert lanes == {"right": (1, 1, "d1"), "center": (1, 0, None)}
    assert a.defender_ledger(en.limit(0), acts.limit(0)).count() == 0


def test_duel_profiles_without_rows_of_a_kind(spark):
    rows = spark.createDataFrame([(1, "A", "Ground", True, "led_to_attack", "Attacking Third"), (1, "A", "Ground", False, "turnover", "Middle Third"), (1, "A", "Ground", None, None, "Defensive Third")],
                                 "matchId int, teamName string, category string, won boolean, duel_context string, zone string")
    got = {x.profile: (x.hits, x.rows, x.score) for x in d.duel_profiles(rows).collect()}
    assert got == {"Ground Duel Edge": (1, 3, 33), "Aerial Control": (0, 0, 0), "Attack Starter": (1, 1, 100), "Risk Zone Losses": (2, 2, 100)}
    moves = spark.createDataFrame([(1, "A", "x", True, "Middle Third"), (1, "A", "x", False, "Attacking Third"), (1, "A", None, True, "Middle Third")], "matchId int, team string, player string, led_to_attack boolean, third string")
    (one,) = d.transition_player_rows(moves).collect()
    assert (one.transitions, one.to_attack, one.stalled, one.defensive_third, one.middle_third, one.attacking_third, one.hit_pct) == (2, 1, 1, 0, 1, 1, 50)


def test_adjusted_tables_use_the_mean_share_of_matches(spark):
    # Side A has three of four passes in one match and half of the other: 62.5 on average.
    rows = [("m1", "A", "p", "Successful", 0.5)] * 2 + [("m1", "A", None, "Unsuccessful", 0.5), ("m1", "B", "q", "Successful", 0.9), ("m2", "A", "p", "Unsuccessful", 0.5), ("m2", "B", "q", "Successful", None)]
    passes = spark.createDataFrame(rows, "matchId string, teamName string, playerName string, outcomeType string, xPass double").select(
        "*", F.lit("l").alias("league"), F.lit("s").alias("season"), F.lit("short").alias("pass_type"), F.lit("Pass").alias("type"), F.array(F.lit("KeyPass")).alias("qualifiers"))
    got = {x.playerName: x for x in r.adjusted_pass_leaders(passes, 2).collect()}
    assert got["p"].avg_possession_pct == 62.5 and got["p"].above_per_100_possession == (2 - 1.5) * 100 / 62.5
    assert got["q"].expected == 0.9 and [got["q"].rank, got["p"].rank] == [1, 2]
    made = {x.playerName: (x.key_passes, x.avg_xPass, x.key_passes_per_100_possession) for x in r.adjusted_creators(passes, 2).collect()}
    assert made == {"p": (3, 0.5, 3 * 100 / 62.5), "q": (2, 0.9, 2 * 100 / 37.5)}
    assert r.adjusted_creators(passes.limit(0), 2).count() == 0


def test_substitution_markers_keep_to_full_time(spark):
    side = ("l", "s", "m", "A")
    rows = [(*side, "SubstitutionOn", 97, 1, 11, 10, 4), (*side, "SubstitutionOff", 97, 2, 10, None, None), (*side, "SubstitutionOn", 60, 3, 13, 99, 5), (*side, "SubstitutionOn", -1, 5, 14, None, 5), (*side, "SubstitutionOn", None, 6, 15, None, 5)]
    made = spark.createDataFrame(rows, "league string, season string, matchId string, teamName string, type string, minute int, eventId long, playerId long, relatedEventId long, slot int")
    made = made.withColumns({n: F.lit("x") for n in ln.SIDE if n not in made.columns}).withColumn("relatedEventId", F.when(F.col("eventId") == 1, 2).otherwise(F.col("relatedEventId")))
    got = {x.player_on: (x.minute, x.player_off) for x in ln.substitution_markers(made).collect()}
    assert got == {11: (95, 10), 13: (60, None)}
    got = {x.player_on: x.minute for x in ln.substitution_markers(made, spark.createDataFrame([("m", 92)], "matchId string, minute int")).collect()}
    assert got == {11: 92, 13: 60}
