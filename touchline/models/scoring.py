"""Model scores on events: xG, then xGOT on it, then xA and xPass, each with its version.

A step gives one row per event it has a value for, keyed by match and position. `plans.enrich.with_models` writes these rows before it puts them on
the events, so a step that fails while rows are scored leaves NULLs and its name, and the next steps still run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.models import evaluate as e, features as f
from touchline.models.artifacts import ModelStore
from touchline.models.training import Artifact
from touchline.operators import state
from touchline.plans.enrich import ModelStep

KEYS = ["matchId", "index"]
VERSION = {"xG": "xg_model_version", "xGOT": "xgot_model_version", "xA": "xa_model_version", "xPass": "xpass_model_version"}


def c(name):
    return F.col(name)


def _own():
    return F.coalesce(c("goalOwn"), F.lit(False))


def shot_scores(events: DataFrame, artifact: Artifact) -> DataFrame:
    """xG of every shot: own goals 0, penalties their fixed value, else the model's score inside its limits."""
    rows = artifact.score(f.shot_features(events), "_raw")
    return e.apply_shot_rules(rows, "_raw").select(*KEYS, "xG", c("shot_distance").alias("xg_shot_distance"), c("shot_angle").alias("xg_shot_angle"),
                                                   F.when(_own(), "own_goal").otherwise(c("shot_family")).alias("xg_shot_family"))


def placement_scores(events: DataFrame, artifact: Artifact) -> DataFrame:
    """xGOT of every shot: 0 unless on target and not blocked; own goals 0. Reads the events' xG."""
    rows = artifact.score(f.xgot_features(f.shot_features(events)), "_raw")
    return e.apply_xgot_rules(rows, "_raw").select(*KEYS, F.when(_own(), 0.0).otherwise(c("xGOT")).alias("xGOT"),
                                                   F.when(_own(), "own_goal").otherwise(c("goal_mouth_zone")).alias("xgot_shot_placement_zone"))


def assist_scores(events: DataFrame, artifact: Artifact) -> DataFrame:
    """xA of every completed pass."""
    return e.apply_pass_rules(artifact.score(f.assist_features(events), "_raw"), "_raw", "xA").select(
        *KEYS, "xA", c("pass_type").alias("xa_pass_type"), c("play_pattern").alias("xa_play_pattern"))


def completion_scores(events: DataFrame, artifact: Artifact) -> DataFrame:
    """xPass of every attempted pass."""
    rows = f.completion_features(state.with_possession(events))
    return e.apply_pass_rules(artifact.score(rows, "_raw"), "_raw", "xPass").select(*KEYS, "xPass", c("pass_type").alias("xpass_pass_type"))


STEPS = {
    "xG": (shot_scores, {"xG": "double", "xg_shot_distance": "double", "xg_shot_angle": "double", "xg_shot_family": "string"}),
    "xGOT": (placement_scores, {"xGOT": "double", "xgot_shot_placement_zone": "string"}),
    "xA": (assist_scores, {"xA": "double", "xa_pass_type": "string", "xa_play_pattern": "string"}),
    "xPass": (completion_scores, {"xPass": "double", "xpass_pass_type": "string"})}


def model_steps(store: ModelStore, versions: dict, force: bool = False) -> list[ModelStep]:
    """Scoring steps in their order for the models named with a version. An event that already has a value of the same version keeps it unless
    forced; a version that the store lacks makes its step fail, not the job."""
    def step(name: str, version: str) -> ModelStep:
        score, columns = STEPS[name]

        def apply(events: DataFrame) -> DataFrame:
            rows = score(events, store.load(name, version)).withColumn(VERSION[name], F.lit(version))
            if VERSION[name] not in events.columns or force:
                return rows
            have = events.where(c(VERSION[name]).eqNullSafe(version) & c(name).isNotNull()).select(*KEYS)
            return rows.join(have, KEYS, "left_anti")

        return ModelStep(name, {**columns, VERSION[name]: "string"}, apply, keyed=True)

    return [step(name, versions[name]) for name in STEPS if name in versions]
