"""Out-of-possession views: defensive actions with follow-up, loss-to-regain transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from touchline.functions import predicates as p, zones as z
from touchline.functions.core import n_if, ratio
from touchline.operators.intervals import near_in_time, prefixed
from touchline.operators.scan import NextAfter, scan, with_halo

# Windows in seconds and the action groups of the transition rule.
COUNTERPRESS_SECONDS, RECOVERY_SECONDS = 5, 60
REGAIN = ["BallRecovery", "Interception", "Tackle", "Challenge", "Aerial"]
COUNTERPRESS = ["BallRecovery", "Interception", "Tackle", "Challenge"]
CONTROL = ["Pass", "Carry", "TakeOn", "GoodSkill", "KeeperPickup", "KeeperSweeper", "Claim", "Goal", "SavedShot",
           "MissedShots", "ShotOnPost"]


def c(name):
    return F.col(name)


def seconds():
    return (c("minute") * 60 + c("second")).cast("bigint")


def worked():
    return F.coalesce(F.lower(F.trim("outcomeType")), F.lit("")).isin("", "successful", "goal", "saved")


def is_loss():
    return c("type").isin("Turnover", "Dispossessed") | F.coalesce(c("turnover"), F.lit(False))


def is_regain():
    return c("type").isin(REGAIN) & worked()


def confirms_control():
    return is_regain() | (c("type").isin(CONTROL) & worked())


def named(events: DataFrame) -> DataFrame:
    """Rows with a type and a team."""
    return events.where((F.trim("type") != "") & (F.trim("teamName") != ""))


def loss_sequences(events: DataFrame) -> DataFrame:
    """Each possession loss with the losing team's next confirmed regain within 60 s of the same period,
    and its counterpress actions within 5 s (up to the regain).

    The regain is an as-of-forward lookup per side; only the 5-second part is an interval join.
    """
    ev = named(events).withColumn("t", seconds())
    hit = F.struct("eventId", "index", "t", "period", "type", "playerName", "x", "y", is_regain().alias("regains"))
    ok = confirms_control()
    ev = scan(ev, [NextAfter("_h", hit, ok & (c("h_a") == "h")), NextAfter("_a", hit, ok & (c("h_a") == "a"))])
    nxt = F.when(c("h_a") == "h", c("_h")).otherwise(c("_a"))
    near = (nxt["period"] == c("period")) & (nxt["t"] - c("t")).between(0, RECOVERY_SECONDS)
    loss = ev.where(is_loss()).withColumn("regain", F.when(near, nxt)).drop("_h", "_a")
    press = prefixed(named(events).withColumn("t", seconds()).where(c("type").isin(COUNTERPRESS)), "p_",
                     ["matchId", "teamName", "period", "eventId", "index", "t", "playerName"])
    lhs = loss.select("matchId", "teamName", "period", "eventId", "index", "t", c("regain.index").alias("r_index"))
    pairs = near_in_time(lhs, press, [("matchId", "p_matchId"), ("teamName", "p_teamName"), ("period", "p_period")], "t", "p_t",
                         ahead=COUNTERPRESS_SECONDS,
                         extra=(c("p_index") > c("index")) & (c("r_index").isNull() | (c("p_index") <= c("r_index"))))
    per = pairs.groupBy("matchId", "eventId").agg(F.count("*").alias("counterpress_actions"))
    out = loss.join(per, ["matchId", "eventId"], "left").fillna(0, ["counterpress_actions"])
    wait = c("regain.t") - c("t")
    return out.select(
        "matchId", "season", "teamName", "eventId", "index", "minute", "second", c("playerName").alias("loss_player"), c("type").alias("loss_type"),
        c("x").alias("loss_x"), c("y").alias("loss_y"), wait.alias("recovery_seconds"), c("regain.eventId").alias("regain_id"),
        c("regain.playerName").alias("regain_player"), c("regain.type").alias("regain_type"), c("regain.regains").alias("regain_is_action"),
        "counterpress_actions",
        F.coalesce((wait <= COUNTERPRESS_SECONDS) & (c("counterpress_actions") > 0), F.lit(False)).alias("counterpress_success"),
        *[n for n in ("team_score_state", "team_goal_diff_before") if n in events.columns])


def counterpress_pairs(events: DataFrame) -> DataFrame:
    """(loss, counterpress action) pairs, for per-player counts."""
    seq = loss_sequences(events).select("matchId", "teamName", "eventId", "index", "regain_id", (c("minute") * 60 + c("second")).cast("bigint").alias("t"))
    regain = events.select("matchId", c("eventId").alias("regain_id"), c("index").alias("r_index"))
    seq = seq.join(regain, ["matchId", "regain_id"], "left")
    period = events.select("matchId", "eventId", "period")
    seq = seq.join(period, ["matchId", "eventId"])
    press = prefixed(named(events).withColumn("t", seconds()).where(c("type").isin(COUNTERPRESS)), "p_",
                     ["matchId", "teamName", "period", "eventId", "index", "t", "playerName"])
    return near_in_time(seq, press, [("matchId", "p_matchId"), ("teamName", "p_teamName"), ("period", "p_period")], "t", "p_t",
                        ahead=COUNTERPRESS_SECONDS,
                        extra=(c("p_index") > c("index")) & (c("r_index").isNull() | (c("p_index") <= c("r_index"))))


def transition_summary(sequences: DataFrame) -> DataFrame:
    r = c("recovery_seconds")
    return sequences.groupBy("matchId", "teamName").agg(
        F.count("*").alias("opportunities"), F.sum("counterpress_actions").alias("counterpress_actions"),
        n_if(c("counterpress_success")).alias("counterpress_regains"),
        ratio(n_if(c("counterpress_success")), F.count("*"), 100.0).alias("counterpress_success_pct"),
        F.count(r).alias("confirmed_recoveries"), (F.sum(r).cast("double") / F.count(r)).alias("avg_recovery_seconds"),
        # At most 61 distinct whole seconds: the exact median keeps one counter per value.
        F.median(r).alias("median_recovery_seconds"), F.min(r).alias("fastest_recovery_seconds"),
        *[n_if(r <= s).alias(f"within_{s}_seconds") for s in (5, 10, 15)])


def with_next_events(events: DataFrame, n: int = 3, reach: int = 15) -> DataFrame:
    """The next ``n`` named events within ``reach`` positions, as structs ``next_1 ..``."""
    ev = with_halo(named(events), ahead=reach + 1)
    w = W.partitionBy("matchId", "_seg").orderBy("index")
    nxt = F.struct("index", "teamName", "playerName", "type", "outcomeType", "minute", "second", "x", "y", "endX", "endY")
    out = ev.withColumns({f"next_{k}": F.lead(nxt, k).over(w) for k in range(1, n + 1)}).where(c("_own")).drop("_seg", "_own")
    return out.withColumns({f"next_{k}": F.when(c(f"next_{k}.index") - c("index") <= reach, c(f"next_{k}")) for k in range(1, n + 1)})


def defensive_actions(events: DataFrame) -> DataFrame:
    """Successful defensive actions with zone, score state and what happened next."""
    ev = with_next_events(events).where(p.defensive_action())
    return ev.select(
        "matchId", "eventId", "teamName", "playerName", "minute", "second", "type", "x", "y", z.third_name(c("x")).alias("zone"),
        "team_score_state", *[c(f"next_{k}.{n}").alias(f"next_{k}_{n}") for k in (1, 2, 3) for n in ("teamName", "playerName", "type")],
        F.coalesce(c("next_1.teamName") == c("teamName"), F.lit(False)).alias("next_team_retained"))


ACTION_COUNTS = {"tackles": "Tackle", "interceptions": "Interception", "recoveries": "BallRecovery", "clearances": "Clearance",
                 "blocked_passes": "BlockedPass", "aerials": "Aerial"}


def defensive_team_totals(events: DataFrame) -> DataFrame:
    return events.where(p.defensive_action()).groupBy("matchId", "teamName").agg(
        F.count("*").alias("total"), *[n_if(c("type") == t).alias(n) for n, t in ACTION_COUNTS.items()])


def defensive_player_summary(events: DataFrame) -> DataFrame:
    """Per player: action counts by type and third, counterpress work and mean time to own regain."""
    zone = z.third_name(c("x"))
    acts = events.where(p.defensive_action() & c("playerName").isNotNull())
    base = acts.groupBy("matchId", "playerName").agg(
        F.count("*").alias("total"), *[n_if(c("type") == t).alias(n) for n, t in ACTION_COUNTS.items()],
        *[n_if(zone == f"{n} Third").alias(f"{n.lower()}_third") for n in ("Defensive", "Middle", "Attacking")])
    seq = loss_sequences(events)
    cp = counterpress_pairs(events).groupBy("matchId", c("p_playerName").alias("playerName")).agg(F.count("*").alias("counterpress_actions"))
    rg = seq.where("counterpress_success").groupBy("matchId", c("regain_player").alias("playerName")).agg(F.count("*").alias("counterpress_regains"))
    # One regain may answer several losses; the latest one gives its waiting time.
    took = (seq.where("regain_is_action").groupBy("matchId", "regain_id").agg(F.max_by("recovery_seconds", "index").alias("s"), F.first("regain_player").alias("playerName")))
    mean = (took.join(acts.select("matchId", c("eventId").alias("regain_id")), ["matchId", "regain_id"], "left_semi")
            .groupBy("matchId", "playerName").agg((F.sum("s").cast("double") / F.count("s")).alias("avg_time_to_player_regain")))
    out = base
    for side in (cp, rg, mean):
        out = out.join(side, ["matchId", "playerName"], "left")
    out = out.fillna(0, ["counterpress_actions", "counterpress_regains"])
    return out.withColumn("counterpress_success_pct", ratio(c("counterpress_regains"), F.greatest(F.lit(1), c("counterpress_actions")), 100.0))


# Weight of each share in a profile's score.
PROFILE_WEIGHTS = {
    "High Press Regains": {"high_regains": 58, "retained": 30, "attacking_third": 24},
    "Deep Block Volume": {"deep_emergency": 62, "defensive_third": 24, "emergency": 20},
    "Regain To Attack": {"retained": 42, "transition_next": 42, "regains": 16},
    "Defensive Risk": {"risk": 70, "deep_risk": 28},
    "Pressing Forward": {"high_regains": 64, "attacking_third": 24, "retained": 18},
    "Ball Winner": {"regains": 48, "retained": 32, "counterpress_regains": 20},
    "Box Defender": {"deep_emergency": 66, "defensive_third": 22, "emergency": 18},
    "Outlet Regainer": {"transition_next": 50, "retained": 34, "regains": 16},
    "Risk Aggressor": {"risk": 72, "deep_risk": 26},
}
TEAM_PROFILES = ["High Press Regains", "Counterpress Control", "Deep Block Volume", "Regain To Attack", "Defensive Risk"]


def defensive_profiles(events: DataFrame, keys=("matchId", "teamName")) -> DataFrame:
    """Role scores (0-100) of a side or, keyed by player, of a player: weighted shares of its actions.

    Needs score columns (the action rows carry them).
    """
    keys = list(keys)
    acts = defensive_actions(events)
    pairs = counterpress_pairs(events).select("matchId", c("p_eventId").alias("eventId")).distinct().withColumn("_cp", F.lit(True))
    won = loss_sequences(events).where("counterpress_success").select("matchId", c("regain_id").alias("eventId")).distinct().withColumn("_cr", F.lit(True))
    a = acts.join(pairs, ["matchId", "eventId"], "left").join(won, ["matchId", "eventId"], "left")
    high, deep = c("zone") == "Attacking Third", c("zone") == "Defensive Third"
    regain, emergency, risk = c("type").isin("BallRecovery", "Interception", "Tackle"), c("type").isin("Clearance", "BlockedPass", "Aerial"), c("type").isin("Foul", "Error")
    onward = c("next_team_retained") & c("next_1_type").isin("Pass", "Carry", "TakeOn", "Shot", "Goal", "MissedShots", "SavedShot")
    cp, cr = F.coalesce("_cp", F.lit(False)), F.coalesce("_cr", F.lit(False)) & F.coalesce("_cp", F.lit(False))
    n = {"high_regains": high & regain, "retained": c("next_team_retained"), "attacking_third": high, "defensive_third": deep, "deep_emergency": deep & emergency, "emergency": emergency,
         "transition_next": onward, "regains": regain, "risk": risk, "deep_risk": deep & risk, "counterpress_regains": cr, "counterpress": cp}
    g = a.groupBy(*keys).agg(F.count("*").alias("total"), *[n_if(v).alias(k) for k, v in n.items()])
    share = lambda k: c(k) / c("total")
    score = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)) + 0.5).cast("int")
    cols = {}
    for name, parts in PROFILE_WEIGHTS.items():
        total = None
        for k, w in parts.items():
            total = share(k) * w if total is None else total + share(k) * w
        cols[name] = score(total)
    control = ratio(c("counterpress_regains"), F.greatest(F.lit(1), c("counterpress")), 56.0) + share("counterpress") * 28 + share("retained") * 16
    cols["Counterpress Control"] = score(control)
    names = TEAM_PROFILES if "teamName" in keys and "playerName" not in keys else [p_ for p_ in cols if p_ not in TEAM_PROFILES]
    out = g.select(*keys, "total", *[cols[p_].alias(p_) for p_ in names])
    return out.unpivot([*keys, "total"], names, "profile", "score")
