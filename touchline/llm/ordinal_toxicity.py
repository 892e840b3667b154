"""Toxicity by cumulative-link ordinal regression.

Severity grades 0..K-1 are ordered. The model is P(grade <= k) = sigmoid(theta_k - w.x): one weight vector w shared by
all thresholds theta_0 < theta_1 < ..., so a word pushes a text along one severity axis. Output is the expected
severity sum_k P(grade > k) and the chance of any toxicity P(grade > 0).

Features x are sparse: log(1 + count) of words and word beginnings that the labelled texts tie to the toxic label. They are
chosen by the signed root of the likelihood ratio. Labels say toxic or not; grades come from them: 0 if not toxic, else 1..3 by
the number of telling words in the text, cut at thirds of the toxic texts of the sample.

Fitting uses at most `SAMPLE` labelled rows, those of least hashed id, and at most `FEATURES` features. Texts are
scored whole. Null and empty texts, and any text without a known feature, score the model's bias alone (as clean).
Labels that are null or whose document is missing are left out; of several labels of one document the largest holds. A labelled id
counts once: of several rows with it the text of least hash is learned from (of equal hashes the first text), every row is scored. Features
of equal worth are taken in the order of their names.
Without toxic or without clean labelled texts nothing can be learned and every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow_rows, mapped, written

SAMPLE = 8000      # most labelled rows used
FEATURES = 2048    # most features kept
LEAST_Z = 4.5      # of a feature's tie to the label
BEGINNINGS = (3, 4, 5)
GRADES = 4
REJECT = 0.5       # chance of any toxicity from which a text is rejected

WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words, and beginnings of longer words marked by a dash."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in BEGINNINGS))


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def measure(self, text: str | None) -> tuple[float, float]:
        """Expected severity and chance of any toxicity."""
        if not self.thresholds:
            return 0.0, 0.0
        counts: dict[str, int] = {}
        weights = self.weights
        for word in WORD.findall((text or "").lower()):
            if word in weights:
                counts[word] = counts.get(word, 0) + 1
            for n in BEGINNINGS:
                if len(word) > n and (head := word[:n] + "-") in weights:
                    counts[head] = counts.get(head, 0) + 1
        push = sum(weights[w] * np.log1p(c) for w, c in counts.items())
        above = [1 / (1 + np.exp(min(700.0, t - push))) for t in self.thresholds]
        return float(sum(above)), float(above[0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(x: tuple[np.ndarray, np.ndarray, np.ndarray], m: int, grade: np.ndarray, grades: int, steps: int = 800, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of least penalised negative log likelihood, by Adam from zero. The features are sparse: row,
    column (below m) and value of each entry."""
    (row, column, value), n = x, len(grade)
    # thresholds are a first value and positive gaps, kept positive by exp
    params = np.concatenate([np.zeros(m), [1.0], np.zeros(grades - 2)])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[:m], np.exp(np.clip(params[m + 1:], -10, 5))
        theta = params[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, value * w[column], n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = _sigmoid(edges[grade + 1] - score), _sigmoid(edges[grade] - score)
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
        g_score = (d_upper - d_lower) / chance / n           # of the loss by the score
        g_theta = np.zeros(grades - 1)
        np.add.at(g_theta, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -d_upper / chance / n, 0))
        np.add.at(g_theta, np.maximum(grade - 1, 0), np.where(grade > 0, d_lower / chance / n, 0))
        tails = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(column, value * g_score[row], m) + ridge * w, [tails[0]], tails[1:] * gaps])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        params = params - 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-9)
    theta = params[m] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(params[m + 1:], -10, 5)))])
    return params[:m], theta


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from labelled documents; at most `sample` rows reach the fit."""
    marked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic")))
    chosen = marked.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    rows = (docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
            .groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"), F.first("toxic").alias("toxic"))
            .select("doc_id", "least.text", "toxic"))
    rows = written(rows, "labelled")  # read three times below, at most `sample` rows

    def present(source):
        for _, text, toxic in source:
            for f in features(text):
                yield f, toxic

    seen = arrow_rows(rows, "feature string, toxic int", present).groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    total = rows.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = int(total[0] or 0), int(total[1]) - int(total[0] or 0)
    if not bad or not good:
        return Model({}, [])
    # signed root of the likelihood ratio between the classes
    a, n, part = F.col("a"), F.col("n"), bad / (bad + good)
    log_ratio = lambda x, mean: F.when(x > 0, x * F.log(x / mean)).otherwise(0.0)
    gain = (log_ratio(a, n * part) + log_ratio(n - a, n * (1 - part)) + log_ratio(bad - a, bad - n * part)
            + log_ratio(good - n + a, good - n * (1 - part)))
    z = F.signum(a / n - part) * F.sqrt(2 * F.greatest(gain, F.lit(0.0)))
    best = seen.where(F.col("n") >= 3).select("feature", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES).collect()
    if not best:
        return Model({}, [])
    place = {r["feature"]: i for i, r in enumerate(best)}
    telling = {r["feature"] for r in best if r["z"] > 0}

    def counted(source):
        for ident, text, toxic in source:
            words = WORD.findall(text.lower())
            counts = Counter(w for w in words if w in place)
            for n in BEGINNINGS:
                counts.update(h for w in words if len(w) > n and (h := w[:n] + "-") in place)
            hits = float(sum(c for f, c in counts.items() if f in telling))
            yield ident, toxic, hits, [place[f] for f in counts], [float(np.log1p(c)) for c in counts.values()]

    made = arrow_rows(rows, "doc_id long, toxic int, hits double, at array<int>, value array<double>", counted).orderBy("doc_id", "hits").collect()
    column = np.array([k for r in made for k in r["at"]], np.int64)
    value = np.array([v for r in made for v in r["value"]])
    row = np.repeat(np.arange(len(made)), [len(r["at"]) for r in made])
    hits = np.array([r["hits"] for r in made])
    toxic = np.array([r["toxic"] for r in made]) > 0
    cuts = np.quantile(hits[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, hits, side="left"), 0)
    w, theta = fit_ordinal((row, column, value), len(place), grade, GRADES)
    return Model({f: float(w[i]) for f, i in place.items()}, theta.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity (0..3), toxic_chance (0..1) of each row."""
    def rows(source):
        for ident, text in source:
            yield (ident, *model.measure(text))

    return arrow_rows(docs.select("doc_id", "text"), "doc_id long, expected_severity double, toxic_chance double", rows)


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.withColumn("rejected", F.col("toxic_chance") >= REJECT)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, all columns as they are, less those rejected."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def batches(source):
        import pyarrow as pa
        for batch in source:
            yield batch.filter(pa.array([model.measure(t)[1] < REJECT for t in batch.column(at).to_pylist()], pa.bool_()))

    return mapped(docs, batches, docs.schema)
