"""Saved web pages: embedded payloads, reject rules, breadcrumbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Words of pages that hold no match.
BLOCKED = "(?i)access denied|are you a robot|captcha|request blocked"
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
CRUMB = r'(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def script_bodies(pages: DataFrame) -> DataFrame:
    """One row per script tag of each page."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), 1)).alias("script_no", "body"))


def page_payloads(pages: DataFrame, marker: str) -> DataFrame:
    """The first script of each page that holds the marker, and why a page is refused (NULL when it is not)."""
    body = F.get(F.filter(F.regexp_extract_all("html", F.lit(SCRIPT), 1), lambda b: b.contains(marker)), 0)
    out = pages.withColumn("payload", body)
    why = (F.when(F.col("html").rlike(BLOCKED), "blocked").when(~F.lower("html").contains("</html>"), "incomplete").when(F.col("payload").isNull(), "no_payload"))
    return out.select("page_id", "url", "payload", why.alias("refused"))


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """Link texts of each page's navigation, in order."""
    nav = F.regexp_extract("html", r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all(nav, F.lit(CRUMB), 2)).alias("place", "text"))
    return links.select("page_id", "place", F.trim(F.regexp_replace("text", "<[^>]+>", "")).alias("text"))


def json_assignments(pages: DataFrame, name: str) -> DataFrame:
    """A JSON object assigned to a script variable, parsed where it is valid."""
    raw = F.regexp_extract("html", rf"(?is)\b{name}\s*=\s*(\{{.*?\}})\s*[;<]", 1)
    return pages.select("page_id", F.try_parse_json(F.nullif(raw, F.lit(""))).alias("value"))
