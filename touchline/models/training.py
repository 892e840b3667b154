"""Training, calibration, ranking and scoring with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from touchline.models import features as f
from touchline.models.evaluate import model_metrics
from touchline.models.preparation import Preparation, learn
from touchline.session import materialise

FOLDS = 3
MOST_POSITIVE_WEIGHT = 500.0


def c(name):
    return F.col(name)


@dataclass(frozen=True)
class ModelSpec:
    """What a model predicts from which columns of its feature table, and how it is calibrated."""
    name: str
    target: str
    numeric: tuple
    categories: tuple
    rows: Callable[[DataFrame], DataFrame]
    calibration: str            # "folds": by folds of matches; "held_out": on the calibration matches
    minimum: int = 50
    weigh_positives: bool = False


def _own(shots: DataFrame) -> DataFrame:
    return shots.where(~F.coalesce(c("goalOwn"), F.lit(False)))


SPECS = {s.name: s for s in (
    ModelSpec("xG", "isGoal", tuple(f.SHOT_NUMERIC), tuple(f.SHOT_CATEGORIES), lambda d: _own(f.shot_training_rows(d)), "folds"),
    ModelSpec("xGOT", "xgot_model_target", tuple(f.PLACEMENT_NUMERIC), tuple(f.PLACEMENT_CATEGORIES), lambda d: _own(f.xgot_training_rows(d)), "folds"),
    ModelSpec("xA", "xa_target_assist", tuple(f.PASS_NUMERIC), tuple(f.PASS_CATEGORIES), f.pass_training_rows, "held_out", weigh_positives=True),
    ModelSpec("xPass", "xpass_completed", tuple(f.COMPLETION_NUMERIC), tuple(f.COMPLETION_CATEGORIES), f.completion_training_rows, "held_out"))}


@dataclass(frozen=True)
class Linear:
    """A fitted logistic model as plain numbers."""
    coefficients: list
    intercept: float

    def margin(self, terms: list[str]) -> Column:
        parts = [f"({self.intercept!r}D)", *(f"{t} * ({w!r}D)" for t, w in zip(terms, self.coefficients))]
        while len(parts) > 1:  # pairs, so that the expression stays shallow
            parts = ["(" + " + ".join(parts[i:i + 2]) + ")" for i in range(0, len(parts), 2)]
        return F.expr(parts[0])


@dataclass(frozen=True)
class Member:
    """One fitted model with its own preparation and a curve: probability = 1 / (1 + exp(-(slope * margin + shift)))."""
    preparation: Preparation
    model: object  # Linear, or a fitted tree model
    slope: float
    shift: float

    def margin(self, rows: DataFrame, out: str = "margin") -> DataFrame:
        return margins(rows, [self], [out])

    def probability(self, margin: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(F.lit(self.slope) * margin + F.lit(self.shift))))


def margins(rows: DataFrame, members: list[Member], names: list[str]) -> DataFrame:
    """The rows with each member's margin: linear ones as an expression, trees on vectors that all come from one projection."""
    linear = {n: m.model.margin(m.preparation.terms()) for n, m in zip(names, members) if isinstance(m.model, Linear)}
    trees = [(n, m) for n, m in zip(names, members) if n not in linear]
    if not trees:
        return rows.withColumns(linear)
    out = rows.select(F.struct(*rows.columns).alias("_row"), *[v.alias(n) for n, v in linear.items()], *[m.preparation.vector().alias(f"_v{n}") for n, m in trees])
    for n, m in trees:
        out = m.model.copy().setFeaturesCol(f"_v{n}").setRawPredictionCol(f"_r{n}").setProbabilityCol("").setPredictionCol("").transform(out)
    return out.select("_row.*", *linear, *[vector_to_array(f"_r{n}")[1].alias(n) for n, _ in trees])


@dataclass(frozen=True)
class Artifact:
    """A scorer: the mean of its members' probabilities."""
    spec: str
    candidate: str
    members: list = field(default_factory=list)

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        names = [f"_m{i}" for i in range(len(self.members))]
        rows = margins(rows, self.members, names)
        total = sum((m.probability(c(n)) for n, m in zip(names, self.members)), F.lit(0.0))
        return rows.withColumn(out, total / F.lit(float(len(names)))).drop(*names)


def fold_of(match: Column, folds: int = FOLDS) -> Column:
    """Fold of a match, the same in every run."""
    return (F.conv(F.substring(F.md5(match.cast("string")), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def estimator(kind: str, seed: int = 7):
    if kind == "logistic":
        return LogisticRegression(labelCol="label", weightCol="weight", maxIter=25, tol=1e-5, regParam=0.001, standardization=False)
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=10, maxDepth=3, stepSize=0.1, subsamplingRate=0.86, seed=seed)


def weight_of(rows: DataFrame, kind: str, weigh_positives: bool) -> Column:
    """Class weights: balanced classes for the logistic model; boosted trees count positives up, at most `MOST_POSITIVE_WEIGHT` times."""
    n, yes = rows.agg(F.count("*"), F.sum("label")).first()
    yes, no = max(yes or 0.0, 1.0), max(n - (yes or 0.0), 1.0)
    if kind == "logistic":
        return F.when(c("label") == 1, n / (2.0 * yes)).otherwise(n / (2.0 * no))
    return F.when((c("label") == 1) & F.lit(weigh_positives), min(no / yes, MOST_POSITIVE_WEIGHT)).otherwise(1.0)


def _base(rows: DataFrame, spec: ModelSpec, kind: str, minimum: int, preparation: Preparation | None = None) -> Member:
    """A model on all the rows given, with the curve that its kind has by itself."""
    preparation = preparation or learn(rows, spec.numeric, spec.categories, minimum)
    model = estimator(kind).fit(preparation.apply(rows).withColumn("weight", weight_of(rows, kind, spec.weigh_positives)).select("label", "features", "weight"))
    if kind == "logistic":
        return Member(preparation, Linear([float(w) for w in model.coefficients], float(model.intercept)), 1.0, 0.0)
    return Member(preparation, model, 2.0, 0.0)


def logistic_curve(margins: DataFrame, rounds: int = 25) -> tuple[float, float]:
    """Slope and shift of P(label = 1) = 1 / (1 + exp(-(slope * margin + shift))) by Newton's method, one aggregate of five sums a round.

    Margins are standardised for the search and labels drawn in a little, as in Platt's rule, so that separable margins give a finite curve too.
    """
    n, yes, mean, spread = margins.agg(F.count("*"), F.sum("label"), F.avg("margin"), F.stddev_pop("margin")).first()
    if not n:
        return 1.0, 0.0
    spread = spread if spread > 1e-9 else 1.0
    x = (c("margin") - mean) / spread
    y = F.when(c("label") == 1, (yes + 1.0) / (yes + 2.0)).otherwise(1.0 / (n - yes + 2.0))
    slope, shift = 0.0, math.log((yes + 1.0) / (n - yes + 1.0))
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-(x * slope + shift)))
        w = p * (1.0 - p)
        g1, g0, h11, h10, h00 = margins.agg(F.sum((y - p) * x), F.sum(y - p), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first()
        h11, h00 = h11 + 1e-9 * n, h00 + 1e-9 * n
        det = h11 * h00 - h10 * h10
        step1, step0 = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
        longest = max(abs(step1), abs(step0))
        scale = min(1.0, 2.0 / longest) if longest else 1.0  # far from the end a whole Newton step may overshoot
        slope, shift = slope + scale * step1, shift + scale * step0
        if longest < 1e-7:
            break
    return slope / spread, shift - slope * mean / spread


def with_curve(member: Member, rows: DataFrame) -> Member:
    """The member with a logistic curve fitted on its margins over rows that it did not see."""
    margins = materialise(member.margin(rows).select("margin", "label"), "margins")
    return Member(member.preparation, member.model, *logistic_curve(margins))


def training_rows(features: DataFrame, split: DataFrame, spec: ModelSpec) -> DataFrame:
    """The rows a model learns from, with label, part and fold; computed once, as fitting reads them many times."""
    rows = spec.rows(features).join(split.select("matchId", "part"), "matchId")
    keep = dict.fromkeys(["matchId", "eventId", *spec.numeric, *spec.categories])
    return materialise(rows.select(*keep, "part", c(spec.target).cast("double").alias("label"), fold_of(c("matchId")).alias("fold")), f"training-{spec.name}")


def fold_members(rows: DataFrame, spec: ModelSpec, kind: str, minimum: int, folds: int = FOLDS) -> list[Member]:
    """For each fold a model that never saw the fold's matches, with a curve fitted on its margins there."""
    return [with_curve(_base(rows.where(c("fold") != k), spec, kind, minimum), rows.where(c("fold") == k)) for k in range(folds)]


def out_of_fold(rows: DataFrame, members: list[Member], out: str = "score") -> DataFrame:
    """Every row scored by the member of its own fold."""
    parts = []
    for k, member in enumerate(members):
        scored = member.margin(rows.where(c("fold") == k), "_m")
        parts.append(scored.withColumn(out, member.probability(c("_m"))).drop("_m"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def fit(rows: DataFrame, spec: ModelSpec, candidate: str, minimum: int | None = None, trained: dict | None = None) -> Artifact:
    """A candidate: `logistic`, `boosted_trees`, either with `_calibrated`. Folds use the training and calibration matches together; the held-out
    form learns on the training matches and calibrates on the others. `trained` keeps, for candidates of the same rows, the held-out form's model of
    each kind, so that a kind is fitted once with and without a curve."""
    minimum = spec.minimum if minimum is None else minimum
    kind = candidate.removesuffix("_calibrated")
    known, train = rows.where("part <> 'test'"), rows.where("part = 'train'")
    if spec.calibration == "folds":
        members = [_base(known, spec, kind, minimum)] if kind == candidate else fold_members(known, spec, kind, minimum)
    else:
        trained = {} if trained is None else trained
        if kind not in trained:
            trained[kind] = _base(train, spec, kind, minimum, next((m.preparation for m in trained.values()), None))
        members = [trained[kind] if kind == candidate else with_curve(trained[kind], rows.where("part = 'calibrate'"))]
    return Artifact(spec.name, candidate, members)


CANDIDATES = ("logistic", "boosted_trees", "boosted_trees_calibrated")


def train_ranked(rows: DataFrame, spec: ModelSpec, names=CANDIDATES, minimum: int | None = None) -> tuple[DataFrame, dict]:
    """Fit every candidate and rank them on the test matches by (log loss, Brier, calibration error): metrics table and artifacts."""
    trained = {}
    fitted, table = {n: fit(rows, spec, n, minimum, trained) for n in names}, None
    test = rows.where("part = 'test'")
    for name, artifact in fitted.items():
        m = model_metrics(artifact.score(test), "label", "score").withColumn("model", F.lit(name))
        table = m if table is None else table.unionByName(m)
    return table.orderBy("log_loss", "brier", "calibration_error"), fitted


def cluster_patterns(vectors: DataFrame, columns, k: int = 6, seed: int = 11):
    """K-means on standardised possession vectors; labels carry no order."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="v", handleInvalid="skip"), StandardScaler(inputCol="v", outputCol="s", withMean=True),
              KMeans(k=k, seed=seed, featuresCol="s", predictionCol="pattern")]
    model = Pipeline(stages=stages).fit(vectors)
    return model.transform(vectors).drop("v", "s"), model.stages[-1].summary.trainingCost
