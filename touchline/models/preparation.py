"""Feature vectors: medians, scales and one-hot levels learned in two aggregates and applied as plain expressions.

Numbers and levels are literals of the plan, so preparing rows never joins or shuffles them, however common a level is. The number of
levels is bounded by `minimum` (a level needs that many training rows) and checked against `LEVELS` before anything is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

LEVELS = 1000  # most one-hot levels of a column


def c(name):
    return F.col(name)


# Expressions are written as SQL text: one call hands a whole vector to the planner, where thousands of column objects take seconds.
def _name(n: str) -> str:
    return "`" + n.replace("`", "``") + "`"


def _text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(n: str) -> str:
    """A column as double, NaN as NULL."""
    return f"nanvl(cast({_name(n)} as double), cast(null as double))"


@dataclass(frozen=True)
class Preparation:
    """numeric: name -> [median, mean, deviation]; levels: name -> one-hot values; common: name -> most frequent value."""
    numeric: dict
    levels: dict
    common: dict

    def terms(self) -> list[str]:
        """Scaled numbers, NULL as the median, then for each category a place per level and one for all others; NULL is the most frequent value.

        The first term passes through a lambda function. A hundred terms in one stage's code are one method too long for the JVM to compile, which costs
        several times the run; a lambda function is left out of stage code, and the projection with it is made of short methods."""
        out = [f"((coalesce({_number(n)}, {median!r}D) - ({mean!r}D)) / {deviation!r}D)" for n, (median, mean, deviation) in self.numeric.items()]
        for n, values in self.levels.items():
            common = "cast(null as string)" if self.common[n] is None else _text(self.common[n])
            value = f"coalesce(cast({_name(n)} as string), {common})"
            out += [f"if({value} <=> {_text(v)}, 1.0D, 0.0D)" for v in values]
            out.append(f"if({value} in ({', '.join(map(_text, values))}), 0.0D, 1.0D)" if values else "1.0D")
        return [f"transform(array({out[0]}), v -> v)[0]", *out[1:]] if out else out

    def vector(self) -> Column:
        return array_to_vector(F.expr(f"array({', '.join(self.terms())})"))

    def apply(self, rows: DataFrame, out: str = "features") -> DataFrame:
        return rows.withColumn(out, self.vector())


def learn(rows: DataFrame, numeric, categories, minimum: int = 50) -> Preparation:
    """Medians, means and deviations after filling, frequent levels and the most frequent one, over the training rows.

    Equally frequent levels go by value. A column without any number is 0; one without any value has no level.
    """
    numeric, categories = list(numeric), list(categories)
    stats = {}
    if numeric:
        pairs = ", ".join(f"struct({_text(n)} as column, {_number(n)} as value)" for n in numeric)
        long = rows.select(F.expr(f"explode(array({pairs}))").alias("g"))
        stats = {r["column"]: r for r in long.groupBy("g.column").agg(
            F.count("*").alias("rows"), F.percentile_approx("g.value", 0.5, 10_000).alias("median"), F.count("g.value").alias("have"),
            F.sum("g.value").alias("total"), F.sum(c("g.value") * c("g.value")).alias("squares")).collect()}  # a row per column
    scales = {}
    for n in numeric:
        if n not in stats or not stats[n]["have"]:
            scales[n] = [0.0, 0.0, 1.0]
            continue
        count, have, median, total, squares = (stats[n][k] for k in ("rows", "have", "median", "total", "squares"))
        mean = (total + (count - have) * median) / count
        deviation = max((squares + (count - have) * median * median) / count - mean * mean, 0.0) ** 0.5
        scales[n] = [float(median), float(mean), float(deviation) if deviation > 1e-9 * max(1.0, abs(mean)) else 1.0]
    levels, common = {n: [] for n in categories}, {n: None for n in categories}
    if categories:
        pairs = ", ".join(f"struct({_text(n)} as column, cast({_name(n)} as string) as value)" for n in categories)
        long = rows.select(F.expr(f"explode(array({pairs}))").alias("g"))
        counts = long.where("g.value is not null").groupBy("g.column", "g.value").agg(F.count("*").alias("n"))
        place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
        # A window limit: each task hands on at most LEVELS + 1 values of a column.
        for r in counts.withColumn("place", place).where(c("place") <= LEVELS + 1).orderBy("column", "place").collect():
            if r.place == 1:
                common[r["column"]] = r.value
            if r.n >= minimum:
                if r.place > LEVELS:
                    raise ValueError(f"{r['column']} has more than {LEVELS} levels of {minimum} rows; raise the minimum")
                levels[r["column"]].append(r.value)
    return Preparation(scales, levels, common)
