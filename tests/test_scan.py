"""Segmented scans equal plain loops, whatever the segment size."""
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators.scan import LastBefore, NextAfter, RunningSum, bounded, scan, with_halo

ROWS = [(m, i, random.Random(ord(m) * 1000 + i).randint(0, 4)) for m in ("a", "b") for i in range(150 if m == "a" else 3)]


def expected():
    out = {}
    for m in ("a", "b"):
        rows = [r for r in ROWS if r[0] == m]
        for k, (_, i, v) in enumerate(rows):
            before = [r for r in rows[:k]]
            hit = [r[1] for r in before if r[2] == 0]
            nxt = [r[1] for r in rows[k + 1:] if r[2] == 1]
            upto = [r[1] for r in rows[:k + 1] if r[2] == 2]
            out[(m, i)] = (sum(r[2] for r in before), sum(r[2] for r in before) + v, hit[-1] if hit else None, nxt[0] if nxt else None, upto[-1] if upto else None)
    return out


def specs():
    v = F.col("v")
    return [RunningSum("s", v), RunningSum("si", v, inclusive=True), LastBefore("l", F.col("i"), v == 0), NextAfter("n", F.col("i"), v == 1),
            LastBefore("li", F.col("i"), v == 2, inclusive=True)]


@pytest.mark.parametrize("segment,levels", [(4, 3), (16, 2), (1000, 2)])
def test_segmented_scan(spark, segment, levels):
    df = spark.createDataFrame(ROWS, "m string, i bigint, v bigint").repartition(3)
    got = scan(df, specs(), ["m"], "i", segment, levels).collect()
    assert {(r.m, r.i): (r.s, r.si, r.l, r.n, r.li) for r in got} == expected()


def test_bounded_scan_is_plain(spark):
    df = spark.createDataFrame(ROWS, "m string, i bigint, v bigint").select("m", bounded(F.col("i"), "i", 150), "v")
    out = scan(df, specs(), ["m"], "i")
    assert "_seg" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.m, r.i): (r.s, r.si, r.l, r.n, r.li) for r in out.collect()} == expected()


def test_halo_lag_and_lead(spark):
    from pyspark.sql import Window as W
    df = spark.createDataFrame(ROWS, "m string, i bigint, v bigint")
    h = with_halo(df, back=2, ahead=1, pos="i", segment=8)
    w = W.partitionBy("m", "_seg").orderBy("i")
    got = h.withColumns({"p": F.lag("v", 2).over(w), "n": F.lead("v", 1).over(w)}).where("_own").collect()
    table = {(m, i): v for m, i, v in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        assert r.p == table.get((r.m, r.i - 2)) and r.n == table.get((r.m, r.i + 1))


def test_match_state_does_not_depend_on_the_bound(spark, sf):
    """The same possessions and scores with and without a proven position bound."""
    from touchline.operators import state
    from touchline.sources.feed import match_feed
    feed = match_feed(spark, sf)
    loose = feed.withColumn("index", F.col("index") + F.lit(0))
    assert loose.schema["index"].metadata == {}
    cols = ["eventId", "possession_id", "possession_team", "home_score_before", "away_score_before"]
    a, b = (sorted(map(tuple, state.with_possession(x, score=True).select(cols).collect()), key=lambda r: r[0]) for x in (feed, loose))
    assert a == b
