"""Registry shape, and a cross-section of the queries against their SQL."""
import duckdb
import pytest

import __spark_entry__ as entry
from compare_with_sql import TABLES, rows

SAMPLE = ["league_table", "team_match_stats", "player_match_stats", "possession_view_rule", "synthetic_carries", "windowed_dynamics", "shot_creating_actions",
          "duels_with_context", "transitions_offensive", "territory_entries", "set_piece_summary", "pass_network_nodes", "team_season_baseline", "lineup_phases",
          "shot_features", "model_metrics", "inferred_rounds", "payload_events"]


def test_every_query_is_named_and_covered():
    from touchline.catalog import load_all
    q = load_all()
    assert all(x.covers for x in q.values())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    want, wcols = rows([d[0] for d in cur.description], cur.fetchall())
    assert cols == wcols and got == want
