"""Facts: each limit on both sides, ties by name, one side only, nulls, repeated rows, empty tables; roles of players at the edges."""
from pyspark.sql import functions as F

from touchline.plans import facts as f, possession_views as v

TEAMS = "matchId int, team string, name string, goals int, xg double, possession_pct double, ppda double"


def texts(df):
    return {(r.matchId, r.text): r for r in df.collect()}


def dynamics(spark, rows):
    flanks = spark.createDataFrame([(1, "A", "Left", 3, 0.5, 1), (1, "B", "Left", 2, 0.5, 2), (2, "A", "Left", 3, 0.0, 1), (3, "A", "Left", 1, None, 1)],
                                   "matchId int, team string, name string, num_attacks int, total_xg double, place int")
    return texts(f.view_facts("match-dynamics", {"teams": spark.createDataFrame(rows, TEAMS), "flanks": flanks}))


def test_limits_ties_and_single_sides(spark):
    got = dynamics(spark, [(1, "B", "B", 0, 1.75, 58.0, 8.0), (1, "A", "A", 2, 1.0, 42.0, 10.0), (2, "A", "A", 1, 1.0, 50.0, 9.0), (2, "B", "B", 1, 1.0, 50.0, 9.0),
                           (3, "A", "A", 0, 3.0, 100.0, 0.0), (4, "A", "A", 0, None, None, None), (4, "B", "B", 1, 0.2, 60.0, 5.0),
                           (5, "A", "A", 0, 0.2, 60.0, 9.0), (5, "B", "B", 0, 0.4, 40.0, 8.0)])
    assert got[1, "better_chances"].subject == "B" and got[1, "better_chances"].other == "A"
    assert got[1, "above_chances"].subject == "A" and (1, "below_chances") not in got
    assert got[1, "ball_and_threat"].subject == "B" and got[1, "harder_press"].value == 8.0
    assert (got[1, "best_route"].team, got[1, "best_route"].other_value) == ("A", 3.0)
    assert got[2, "even_chances"].subject == "A" and not {"harder_press", "best_route", "ball_and_threat"} & {t for m, t in got if m == 2}
    # One side only: nothing is compared, a missing xG of a lane is no route; missing measures come last and give no difference.
    assert {t for m, t in got if m == 3} == {"below_chances"}
    assert {t for m, t in got if m == 4} == set()
    assert got[5, "ball_without_threat"].other == "B" and got[5, "ball_without_threat"].other_value == 0.4


def test_shots_skip_the_holder_of_the_biggest_chance(spark):
    shots = spark.createDataFrame([(1, "A", "x", 0.4, 10, 1, 3), (1, "A", "x", 0.4, 9, 0, 2), (1, "B", None, 0.35, 20, 0, 5)],
                                  "matchId int, team string, name string, xg double, minute int, scored int, place int")
    players = spark.createDataFrame([(1, "A", "x", 0.8, 2, True), (1, "B", "z", 0.2, 1, False), (1, "B", "y", 0.2, 1, False), (1, "A", "w", 0.1, 9, False)],
                                    "matchId int, team string, name string, total_xg double, total_shots int, holds_biggest boolean")
    sides = spark.createDataFrame([(1, "A", "A", 2, 0.24), (1, "B", "B", 0, 0.0), (2, "A", "A", 3, 0.3)], "matchId int, team string, name string, shots int, xg double")
    got = texts(f.view_facts("shots", {"shots": shots, "shot_players": players, "shot_teams": sides}))
    assert set(got) == {(1, "good_looks"), (2, "low_value_shots"), (1, "biggest_chance_missed"), (1, "big_chances"), (1, "other_threat")}
    assert (got[1, "biggest_chance_missed"].other_value, got[1, "big_chances"].value, got[1, "big_chances"].other_value, got[1, "other_threat"].subject) == (9.0, 2.0, 1.0, "y")


def test_sides_are_kept_apart_and_hubs(spark):
    side = "matchId int, team string, name string, "
    tables = {"thirds": spark.createDataFrame([(1, "A", "final", 80.0, 0.5, 2), (1, "A", "middle", 90.0, 0.2, 3), (1, "B", "middle", 70.0, 0.1, 1)], side + "completion_pct double, xt double, progressive int"),
              "channels": spark.createDataFrame([(1, "A", "central", 0.2, 4)] * 2, side + "xt double, final_third_entries int"),
              "pairs": spark.createDataFrame([(1, "A", "7", "8", 5, 2), (1, "A", "9", "8", 6, 1)], side + "receiver string, passes int, rank int"),
              "centre": spark.createDataFrame([(1, "A", "A", 0.15), (1, "B", "B", 0.149), (2, "A", "A", 0.0)], side + "index double")}
    got = {(r.team, r.text): r for r in f.view_facts("in-possession", tables).collect()}
    assert set(got) == {("A", "final_third_passing"), ("B", "threat_from_deeper"), ("A", "main_channel"), ("A", "top_pair"), ("A", "one_hub"), ("B", "spread_build_up")}
    assert got["A", "top_pair"].other == "8" and got["A", "top_pair"].value == 6.0


def test_all_rules_have_leaders_and_empty_tables_give_nothing(spark):
    names = {l.name for l in f.LEADERS}
    assert len(names) == len(f.LEADERS) and {r.leader for r in f.RULES} <= names and len({r.text for r in f.RULES}) == len(f.RULES)
    assert f.view_facts("match-dynamics", {"teams": spark.createDataFrame([], TEAMS)}).count() == 0


def test_player_roles_by_place_and_without_edges(spark):
    node = "matchId int, teamName string, playerId int, player string, x double, y double, passes_made long, passes_received long, progressive_passes_made long, progressive_passes_received long, progressive_carries long, take_ons long, count long"
    nodes = spark.createDataFrame([(1, "A", 1, "deep", 45.0, 34.0, 9, 1, 2, 0, 0, 0, 10), (1, "A", 2, "high", 60.0, 48.0, 1, 9, 0, 2, 1, 3, 10), (1, "A", 3, "alone", 50.0, 34.0, 1, 0, 0, 0, 0, 0, 1)], node)
    edges = spark.createDataFrame([(1, "A", 1, 2, 9, 44.0, 34.0, 72.0, 52.0, -0.5, 2, 45.0, 34.0, 70.0, 52.0, -0.05)],
                                  "matchId int, teamName string, playerId int, receiver int, pass_count long, source_x double, source_y double, target_x double, target_y double, total_xt double, progressive_count long, x0 double, y0 double, x1 double, y1 double, avg_xt double")
    got = {(r.player, r.role): (r.score, r.rank) for r in v.player_roles(nodes, edges).collect()}
    assert {r for p, r in got if p == "alone"} == {"Progressor", "Connector", "Final Third Creator", "Outlet Receiver"}
    assert ("deep", "Build-up Anchor") in got and {("high", "Advanced Link Player"), ("high", "Wide Outlet")} <= set(got)
    # 2 of 2 progressive actions, no gain, no take-ons: 46 points; all ten passes of the side's best and its only link: 46 + 28 + 10/30 of 10.
    assert got["deep", "Progressor"][0] == 46
    assert got["deep", "Connector"] == (77, 1) and got["high", "Outlet Receiver"] == (80, 1)
    assert got["alone", "Progressor"][0] == 0
    kinds = {r.profile for r in v.profile_edges(edges).collect()}
    assert kinds == {"Build-up Control", "Progressive Passing", "Wide Progression", "Directness", "Progressor", "Connector", "Outlet Receiver", "Build-up Anchor", "Advanced Link Player", "Wide Outlet"}
    assert v.player_roles(nodes.where(F.lit(False)), edges).count() == 0
