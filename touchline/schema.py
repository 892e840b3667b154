"""Canonical event table: one row per on-ball event, every column nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_FIELDS = [
    ("league", "string"), ("season", "string"), ("matchId", "string"), ("startDate", "date"),
    ("eventId", "bigint"), ("index", "bigint"), ("teamId", "bigint"), ("teamName", "string"),
    ("opponentName", "string"), ("h_a", "string"), ("playerId", "bigint"), ("playerName", "string"),
    ("minute", "int"), ("second", "int"), ("expandedMinute", "int"), ("period", "string"),
    ("type", "string"), ("outcomeType", "string"), ("situation", "string"),
    ("x", "double"), ("y", "double"), ("endX", "double"), ("endY", "double"),
    ("goalMouthY", "double"), ("goalMouthZ", "double"),
    ("isTouch", "boolean"), ("isShot", "boolean"), ("isGoal", "boolean"), ("goalOwn", "boolean"),
    ("turnover", "boolean"), ("cardType", "string"), ("relatedEventId", "bigint"),
    ("qualifiers", "array<string>"), ("satisfiedTypes", "array<string>"),
    ("xG", "double"), ("xGOT", "double"), ("xA", "double"), ("xPass", "double"),
    ("xT", "double"), ("epv_added", "double"), ("prog_pass", "double"), ("prog_carry", "double"),
    ("is_generated", "boolean"),
]



def event_ddl() -> str:
    """DDL text usable by ``spark.read.schema``."""
    return ", ".join(f"`{n}` {t}" for n, t in _FIELDS)


def conform(df: DataFrame) -> DataFrame:
    """Add absent columns as typed NULLs, cast the rest, drop a trailing ``.0`` of match ids.

    After this step "column absent" and "column all NULL" mean the same thing.
    """
    have = set(df.columns)
    out = []
    for name, kind in _FIELDS:
        if name not in have:
            out.append(F.lit(None).cast(kind).alias(name))
        elif name == "matchId":
            out.append(match_id_text(F.col(name)).alias(name))
        elif kind == "boolean":
            from touchline.functions.core import truthy
            out.append(truthy(F.col(name)).alias(name))
        elif kind.startswith("array"):
            out.append(F.col(f"`{name}`").cast(kind).alias(name))
        else:
            out.append(F.col(f"`{name}`").try_cast(kind).alias(name))
    extra = [F.col(f"`{c}`") for c in df.columns if c not in dict(_FIELDS)]
    return df.select(*out, *extra)


def match_id_text(c):
    """``1903350.0`` and ``1903350`` are the same match."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")
