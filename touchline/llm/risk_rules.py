"""Quality rules with risk-controlled cutoffs, in JVM functions only.

Each rule is a statistic of the text that grows with badness and a fixed sequence of cutoffs, lax to strict. Labelled
documents are the holdout. Per stratum (language) and rule the cutoffs are tested in order: a cutoff passes if, were
the rule to reject a share `RISK / rules` of the stratum's good documents, so few false rejections among the labelled good
ones would have a chance of at most `DELTA / (strata * rules)`, by the exact binomial distribution. Testing stops at the
first that fails (fixed-sequence testing needs no further correction inside a sequence; Bonferroni covers strata and
rules). So with confidence 1 - DELTA, in every stratum all rules together reject at most `RISK` of the good documents. A
stratum with too few labels gets no cutoff and rejects nothing.

Null text counts as empty; null language is a stratum of its own. Labels that are null or without a document are left out;
of several labels of one document the largest quality holds. Repeated rows each get their row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import written
from touchline.llm.native import let, neighbours

RISK, DELTA = 0.05, 0.05
WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STRATA_SENT = 10_000  # most strata whose cutoffs are sent to all tasks

#: Cutoffs from lax to strict; a text is rejected from the cutoff on.
RULES = {
    "symbols_per_word": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05),
    "repeated_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeated_lines": (0.9, 0.7, 0.5, 0.3, 0.2, 0.1),
    "capitals_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2),
    "marks_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "characters_per_word": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0),
}


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of `WINDOW` words found twice or more, the first included."""
    def windows(hashes):
        # hashes of 2, 4, 8 words
        def doubled(out, span):
            return let(out, lambda h: neighbours(h, F.size(h), lambda a, b: F.xxhash64(a, b), span))
        return doubled(doubled(doubled(hashes, 1), 2), 4)

    def covered(sorted_windows):
        twice = neighbours(sorted_windows, F.size(sorted_windows), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return let(F.sort_array(F.array_distinct(F.flatten(twice))), lambda at: F.aggregate(
            neighbours(at, F.size(at), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda x, y: x + y))

    def count(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    return F.when(F.size(words) < WINDOW, 0).otherwise(let(windows(F.transform(words, lambda w: F.xxhash64(w))), count)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and the rules' statistics."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    split = read.select("*", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
                        F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("lines"))
    length = F.length("text")
    counted = split.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), (length - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_capitals"),
        (length - F.length(F.regexp_replace("text", r"[^\p{L}\p{N}\s]+", ""))).alias("n_marks"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "n_words").alias("symbols_per_word"), share("n_repeat_words", "n_words").alias("repeated_share"),
        share("n_dup_lines", "n_lines").alias("repeated_lines"), share("n_capitals", "word_chars").alias("capitals_share"),
        share("n_marks", "word_chars").alias("marks_share"), share("word_chars", "n_words").alias("characters_per_word"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p; 1 where k is not below the mean (no cutoff passes there)."""
    odds = math.log(p / (1 - p))
    first = n * math.log1p(-p)
    folded = F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.struct(first.cast("double").alias("t"), F.exp(first).alias("s")),
                         lambda a, i: let(a["t"] + F.log((n - i + 1) / i) + odds, lambda t: F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))),
                         lambda a: a["s"])
    return F.when(k >= n * p, 1.0).when(k == 0, F.exp(first)).otherwise(folded)


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum: n_good and, for each rule, the strictest cutoff that passes (null: none)."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # one trial for each labelled id, by the worst of its rows: copies of a row say nothing new about good documents
    good = measures.join(marked.where("quality = 1"), "doc_id").groupBy("stratum", "doc_id").agg(*[F.max(rule).alias(rule) for rule in RULES])
    counts = good.groupBy("stratum").agg(F.count("*").alias("n_good"), *[
        F.sum((F.col(rule) >= c).cast("long")).alias(f"{rule}_{i}") for rule, cuts in RULES.items() for i, c in enumerate(cuts)])
    strata = measures.select("stratum").distinct().agg(F.count("*").alias("strata"))
    level = F.lit(delta) / (F.col("strata") * len(RULES))
    chosen = []
    for rule, cuts in RULES.items():
        out = F.lit(None).cast("double")
        passed = F.lit(True)
        for i, c in enumerate(cuts):  # later cutoffs hold only if all before them do
            passed = passed & F.col(f"{rule}_{i}_passes")
            out = F.when(passed, F.lit(c)).otherwise(out)
        chosen.append(out.alias(f"cut_{rule}"))
    p = risk / len(RULES)
    tested = counts.crossJoin(F.broadcast(strata)).select("stratum", "n_good", *[  # one row
        (binomial_tail(F.col(f"{rule}_{i}"), F.col("n_good"), p) <= level).alias(f"{rule}_{i}_passes") for rule, cuts in RULES.items() for i in range(len(cuts))])
    return tested.select("stratum", "n_good", *chosen)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the rules that reject."""
    measures = written(measured(docs), "measures")
    table = written(cutoffs(measures, labels), "cutoffs")
    few = table.limit(STRATA_SENT + 1).count() <= STRATA_SENT
    rows = measures.join(F.broadcast(table) if few else table, "stratum", "left")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    hit = F.array_compact(F.array(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                       (~base & (F.size(hit) == 0)).alias("kept"), F.array_join(hit, ",").alias("rejected_by"))
