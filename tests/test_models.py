"""Preparation, calibration curves, the artifact store and the scoring chain on small tables."""
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.models import training as t
from touchline.models.artifacts import ModelMissing, ModelStore
from touchline.models.preparation import Preparation, learn
from touchline.plans import enrich
from touchline.plans.enrich import ModelStep, with_models
from touchline.session import checkpoint_dir

SPEC = t.ModelSpec("toy", "y", ("a", "b"), ("kind",), lambda d: d, "folds", minimum=5)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(240):
        a, kind = float(rng.normal()), "odd'q" if i % 3 else "back\\slash"
        y = float(rng.random() < 1 / (1 + math.exp(-(2 * a + (1.0 if i % 3 else -1.0)))))
        out.append((str(i // 8), i, a if i % 11 else None, float("nan") if i % 7 == 0 else 5.0 * a, None if i % 13 == 0 else kind, y,
                    ("train", "calibrate", "test")[(i // 8) % 3]))
    df = spark.createDataFrame(out, "matchId string, eventId long, a double, b double, kind string, label double, part string")
    return df.withColumn("fold", t.fold_of(F.col("matchId"))).cache()


def test_preparation_fills_scales_and_folds_levels(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "x"), (None, "it's"), (float("nan"), None), (100.0, "rare"), (2.0, "it's"), (2.0, "x")], "n double, k string")
    p = learn(df, ["n"], ["k"], minimum=2)
    assert p.levels == {"k": ["x", "it's"]} and p.common == {"k": "x"} and p.numeric["n"][0] == 2.0
    filled = [1, 3, 2, 2, 100, 2, 2]
    assert p.numeric["n"][1] == pytest.approx(np.mean(filled)) and p.numeric["n"][2] == pytest.approx(np.std(filled))
    got = [r.features.toArray().tolist()[1:] for r in p.apply(df).collect()]
    assert got == [[1, 0, 0], [1, 0, 0], [0, 1, 0], [1, 0, 0], [0, 0, 1], [0, 1, 0], [1, 0, 0]]
    unknown = spark.createDataFrame([(None, "new")], "n double, k string")
    assert p.apply(unknown).first().features.toArray()[1:].tolist() == [0, 0, 1]


def test_preparation_of_empty_constant_and_null_columns(spark):
    df = spark.createDataFrame([(5.0, None, None)] * 3, "same double, none double, k string")
    p = learn(df, ["same", "none"], ["k"], 1)
    assert p.apply(df).first().features.toArray().tolist() == [0.0, 0.0, 1.0]
    empty = learn(df.limit(0), ["same", "none"], ["k"], 1)
    assert empty.apply(df).first().features.toArray().tolist() == [5.0, 0.0, 1.0]


def test_too_many_levels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("touchline.models.preparation.LEVELS", 3)
    df = spark.range(8).select((F.col("id") % 4).cast("string").alias("k"))
    with pytest.raises(ValueError, match="more than 3 levels"):
        learn(df, [], ["k"], 2)


def test_linear_margin_is_that_of_the_fitted_model(rows):
    p = learn(rows, SPEC.numeric, SPEC.categories, 5)
    x = p.apply(rows).withColumn("weight", F.lit(1.0))
    model = t.estimator("logistic").fit(x)
    member = t.Member(p, t.Linear([float(v) for v in model.coefficients], float(model.intercept)), 1.0, 0.0)
    both = member.margin(model.transform(x).withColumn("p1", F.element_at(t.vector_to_array("probability"), 2)))
    assert both.select(F.max(F.abs(member.probability(F.col("margin")) - F.col("p1")))).first()[0] < 1e-9


def test_curve_is_the_best_one_and_finite_for_separable_margins(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(0, 30, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.1 * m - 0.5)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(m, y)], "margin double, label double").cache()
    slope, shift = t.logistic_curve(df)
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    p = 1 / (1 + np.exp(-(slope * m + shift)))
    assert abs(((goal - p) * m).sum()) < 1e-3 and abs((goal - p).sum()) < 1e-4  # the gradient is 0 there
    apart = spark.createDataFrame([(float(i), float(i > 4)) for i in range(10)], "margin double, label double")
    assert all(map(math.isfinite, t.logistic_curve(apart))) and t.logistic_curve(apart)[0] > 0
    assert t.logistic_curve(apart.limit(0)) == (1.0, 0.0)


@pytest.mark.parametrize("candidate", ["logistic_calibrated", "boosted_trees_calibrated"])
def test_stored_artifacts_score_equally_and_members_are_by_fold(spark, rows, candidate):
    artifact = t.fit(rows, SPEC, candidate)
    assert len(artifact.members) == t.FOLDS and len({(m.slope, m.shift) for m in artifact.members}) == t.FOLDS
    store = ModelStore(spark, f"{checkpoint_dir(spark)}/test-models-{uuid.uuid4().hex}")
    store.save(artifact, "v1")
    test = rows.where("part = 'test'")
    both = store.load("toy", "v1").score(artifact.score(test, "s1"), "s2")
    assert both.columns == [*rows.columns, "s1", "s2"] and both.where("not (s1 = s2 and s1 between 0 and 1)").count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        store.save(artifact, "v1")
    with pytest.raises(ModelMissing):
        store.load("toy", "v2")


def test_rows_are_scored_by_the_fold_that_did_not_see_them(rows):
    known = rows.where("part <> 'test'")
    members = t.fold_members(known, SPEC, "logistic", 5)
    got = {r.eventId: r.score for r in t.out_of_fold(known, members).collect()}
    for k, m in enumerate(members):
        own = m.margin(known.where(F.col("fold") == k)).select("eventId", m.probability(F.col("margin")).alias("p")).collect()
        assert all(got[r.eventId] == r.p for r in own)
    assert len(got) == known.count()


def test_failing_steps_leave_what_was_there(spark):
    ev = spark.createDataFrame([("1", i, float(i)) for i in range(5)], "matchId string, index long, xG double")
    steps = [ModelStep("rows", {"xG": "double", "v": "string"}, lambda d: d.withColumns({"xG": F.raise_error(F.lit("no")).cast("double"), "v": F.lit("v1")})),
             ModelStep("some", {"xG": "double"}, lambda d: d.where("index < 2").select("matchId", "index", F.lit(0.5).alias("xG")), keyed=True),
             ModelStep("next", {"twice": "double"}, lambda d: d.withColumn("twice", F.col("xG") * 2))]
    got = sorted((r["index"], r.xG, r.v, r.twice, tuple(r.failed_models)) for r in with_models(ev, steps).collect())
    assert got == [(i, x, None, 2 * x, ("rows",)) for i, x in enumerate([0.5, 0.5, 2.0, 3.0, 4.0])]


def test_values_of_a_step_are_never_sent_whole(spark):
    """A constant score is as many rows as the events but a few bytes on disk, so that file sizes call for a broadcast."""
    ev = spark.range(20_000).select(F.lit("1").alias("matchId"), F.col("id").alias("index"))
    out = with_models(ev, [ModelStep("all", {"xPass": "double"}, lambda d: d.withColumn("xPass", F.lit(0.5)))])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("xPass = 0.5").count() == 20_000


def test_a_kind_is_fitted_once_with_and_without_a_curve(rows, monkeypatch):
    spec = t.ModelSpec("toy", "y", ("a", "b"), ("kind",), lambda d: d, "held_out", minimum=5)
    alone = {n: t.fit(rows, spec, n) for n in t.CANDIDATES}
    kinds, learned, estimator, learn_ = [], [], t.estimator, t.learn
    monkeypatch.setattr(t, "estimator", lambda kind: kinds.append(kind) or estimator(kind))
    monkeypatch.setattr(t, "learn", lambda *a: learned.append(1) or learn_(*a))
    _, fitted = t.train_ranked(rows, spec)
    assert kinds == ["logistic", "boosted_trees"] and learned == [1]
    for n in t.CANDIDATES:
        both = fitted[n].score(alone[n].score(rows, "s1"), "s2")
        assert both.where("not abs(s1 - s2) < 1e-9").isEmpty()


def test_written_events_are_not_written_again(spark, monkeypatch):
    written, materialise = [], enrich.materialise
    monkeypatch.setattr(enrich, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    ev = spark.range(20).select(F.lit("1").alias("matchId"), F.col("id").alias("index"))
    out = with_models(materialise(ev, "test-events"), [ModelStep("all", {"xPass": "double"}, lambda d: d.withColumn("xPass", F.lit(0.5)))], written=True)
    assert written == ["scores"] and out.where("xPass = 0.5").count() == 20


def test_a_sum_of_many_terms_is_not_one_method_of_stage_code(rows):
    """One method for all terms of a model is too long for the JVM to compile, so it would run interpreted for every row."""
    p = learn(rows, SPEC.numeric, SPEC.categories, 5)
    for out in (p.apply(rows), t.Member(p, t.Linear([0.5] * len(p.terms()), 0.1), 1.0, 0.0).margin(rows)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.startswith("Project")  # "*(1) Project" is stage code
