"""Name queries over people derived from ``part`` and clubs derived from ``supplier``, against all pairs in SQL."""

from pyspark.sql import functions as F

from touchline.catalog.registry import query
from touchline.plans import people as pp

# People: two words of the part name, a middle word for every fifth, a shared code in the surname, an accent in every seventh.
PEOPLE_SQL = """WITH base AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_brand AS team,
 translate(CAST(p_partkey % 97 AS VARCHAR), '0123456789', 'abcdefghij') AS c1, translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') AS c2 FROM part),
people AS (SELECT *, a || CASE WHEN k % 5 = 0 THEN ' x' || c2 ELSE '' END AS forename, b || CASE WHEN k % 7 = 0 THEN 'é' ELSE '' END || c1 AS surname FROM base),
wanted AS (SELECT DISTINCT CASE k % 9 WHEN 0 THEN upper(forename || ' ' || surname) WHEN 1 THEN surname || '-' || forename WHEN 2 THEN forename || ' ' || surname || ' y' || c2
  WHEN 3 THEN substr(a, 1, 1) || ' ' || surname WHEN 4 THEN surname WHEN 5 THEN forename WHEN 6 THEN a || '  ' || surname WHEN 7 THEN 'z ' || surname || ' ' || forename ELSE 'no such ' || c2 END AS name,
  CASE WHEN k % 2 = 0 THEN team END AS teamName FROM people),"""
KEY = "trim(regexp_replace(lower(strip_accents({})), '[\\s-]+', ' ', 'g'))"


def _people(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words, k = F.split("p_name", " "), F.col("p_partkey")
    code = lambda x: F.translate(x.cast("string"), "0123456789", "abcdefghij")
    base = part.select(k.alias("k"), words[0].alias("a"), words[1].alias("b"), F.col("p_brand").alias("team"), code(k % 97).alias("c1"), code(k).alias("c2"))
    people = base.withColumn("forename", F.concat("a", F.when(F.expr("k % 5 = 0"), F.concat(F.lit(" x"), "c2")).otherwise(""))).withColumn(
        "surname", F.concat("b", F.when(F.expr("k % 7 = 0"), "é").otherwise(""), "c1"))
    forms = [F.upper(F.concat_ws(" ", "forename", "surname")), F.concat_ws("-", "surname", "forename"), F.concat("forename", F.lit(" "), "surname", F.lit(" y"), "c2"),
             F.concat(F.substring("a", 1, 1), F.lit(" "), "surname"), F.col("surname"), F.col("forename"), F.concat("a", F.lit("  "), "surname"),
             F.concat(F.lit("z "), "surname", F.lit(" "), "forename"), F.concat(F.lit("no such "), "c2")]
    wanted = people.select(F.get(F.array(*forms), (F.col("k") % 9).cast("int")).alias("name"), F.when(F.expr("k % 2 = 0"), F.col("team")).alias("teamName"))
    return people, wanted


@query("resolved_people", "J34", PEOPLE_SQL + f"""
full0 AS (SELECT k AS person, {KEY.format("forename || ' ' || surname")} AS f, {KEY.format("surname")} AS sur, {KEY.format("forename")} AS fore FROM people),
fulls AS (SELECT f, min(person) AS person, list_distinct(string_split(f, ' ')) AS t FROM full0 GROUP BY f HAVING min(person) = max(person)),
squad AS (SELECT {KEY.format("team")} AS team, {KEY.format("forename || ' ' || surname")} AS f, list_distinct(string_split({KEY.format("forename || ' ' || surname")}, ' ')) AS t, k AS person FROM people WHERE k % 3 = 0),
w AS (SELECT name, teamName, {KEY.format("teamName")} AS team, {KEY.format("name")} AS f, string_split({KEY.format("name")}, ' ') AS p, list_distinct(string_split({KEY.format("name")}, ' ')) AS t FROM wanted),
hits AS (SELECT name, teamName, 1 AS stage, person FROM w JOIN squad s USING (team) WHERE s.f = w.f
 UNION ALL SELECT name, teamName, 2, person FROM w JOIN squad s USING (team) WHERE list_contains(s.t, w.p[-1])
 UNION ALL SELECT name, teamName, 3, person FROM w JOIN squad s USING (team) WHERE list_has_all(s.t, w.t) OR list_has_all(w.t, s.t)
 UNION ALL SELECT name, teamName, 4, person FROM w JOIN squad s USING (team) WHERE len(list_intersect(s.t, w.t)) >= 2
 UNION ALL SELECT name, teamName, 5, person FROM w JOIN fulls s USING (f)
 UNION ALL SELECT name, teamName, 6, person FROM w JOIN fulls s ON s.f = w.p[1] || ' ' || w.p[2] WHERE len(w.p) >= 3
 UNION ALL SELECT name, teamName, 7, person FROM w JOIN fulls s ON len(list_intersect(s.t, w.t)) >= 2 AND (list_has_all(s.t, w.t) OR list_has_all(w.t, s.t))
 UNION ALL SELECT name, teamName, 8, person FROM w JOIN fulls s ON s.f = array_to_string(w.p[2:], ' ') || ' ' || w.p[1] WHERE len(w.p) >= 2
 UNION ALL SELECT name, teamName, 9, person FROM w JOIN fulls s ON s.f = array_to_string(list_reverse(w.p), ' ') WHERE len(w.p) >= 2
 UNION ALL SELECT name, teamName, 10, person FROM w JOIN full0 s ON s.sur = w.p[-1] AND s.fore[1] = w.p[1][1] WHERE len(w.p) >= 2
 UNION ALL SELECT name, teamName, 11, person FROM w JOIN full0 s ON s.sur = w.p[-1]
 UNION ALL SELECT name, teamName, 12, person FROM w JOIN full0 s ON s.fore = w.f WHERE len(w.p) = 1),
one AS (SELECT name, teamName, stage, min(person) AS person FROM hits GROUP BY ALL HAVING min(person) = max(person))
SELECT w.name, w.teamName, min_by(o.person, o.stage) AS person, min(o.stage) AS stage FROM w LEFT JOIN one o ON o.name = w.name AND o.teamName IS NOT DISTINCT FROM w.teamName GROUP BY 1, 2""")
def resolved_people(spark, sf_dir):
    people, wanted = _people(spark, sf_dir)
    squads = people.where("k % 3 = 0").select(F.col("team").alias("teamName"), F.concat_ws(" ", "forename", "surname").alias("name"), F.col("k").alias("person"))
    return pp.resolve_names(wanted, people.select(F.col("k").alias("person"), "forename", "surname"), squads)


@query("resolved_stats_players", "J35", PEOPLE_SQL + f"""
known AS (SELECT DISTINCT forename || ' ' || surname AS playerName, {KEY.format("forename || ' ' || surname")} AS f FROM people WHERE k % 4 <> 1),
w AS (SELECT DISTINCT name, {KEY.format("name")} AS f FROM wanted),
hits AS (SELECT w.name, k.playerName, CASE WHEN k.f = w.f THEN 1 WHEN k.f[1] = w.f[1] THEN 2 ELSE 3 END AS stage FROM w JOIN known k ON string_split(k.f, ' ')[-1] = string_split(w.f, ' ')[-1])
SELECT w.name, arg_min(h.playerName, (h.stage, h.playerName)) AS playerName, min(h.stage) AS stage FROM w LEFT JOIN hits h USING (name) GROUP BY w.name""")
def resolved_stats_players(spark, sf_dir):
    people, wanted = _people(spark, sf_dir)
    return pp.resolve_stats_players(wanted, people.where("k % 4 <> 1").select(F.concat_ws(" ", "forename", "surname").alias("playerName")))


@query("matched_clubs", "J34", PEOPLE_SQL + """
clubs AS (SELECT min(k) AS id, b || ' ' || a || CASE WHEN k % 3 = 0 THEN ' u' || c1 ELSE '' END AS club FROM people GROUP BY 2),
teams AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN upper(b || '.' || a) WHEN 1 THEN a || ' ' || b WHEN 2 THEN b || ' u' || c1 ELSE 'the ' || a END AS teamName FROM people),
other AS (SELECT DISTINCT 'the ' || a AS teamName, 'small ' || a AS club FROM people WHERE a < 'h'),
w AS (SELECT teamName, o.club IS NOT NULL AS named, trim(regexp_replace(lower(coalesce(o.club, teamName)), '[\\s./-]+', ' ', 'g')) AS f FROM teams LEFT JOIN other o USING (teamName)),
hits AS (SELECT w.teamName, c.id, CASE WHEN named THEN 1 WHEN c.club = w.f THEN 2 ELSE 3 END AS stage, length(c.club) AS n, c.club FROM w JOIN clubs c
 ON c.club = w.f OR (NOT named AND list_has_all(string_split(c.club, ' '), string_split(w.f, ' '))))
SELECT w.teamName, arg_min(h.id, (h.stage, h.n, h.club)) AS club_id, min(h.stage) AS stage FROM w LEFT JOIN hits h USING (teamName) GROUP BY 1""")
def matched_clubs(spark, sf_dir):
    people, _ = _people(spark, sf_dir)
    clubs = people.select(F.col("k").alias("club_id"), F.concat(F.concat_ws(" ", "b", "a"), F.when(F.expr("k % 3 = 0"), F.concat(F.lit(" u"), "c1")).otherwise("")).alias("club"))
    forms = [F.upper(F.concat_ws(".", "b", "a")), F.concat_ws(" ", "a", "b"), F.concat("b", F.lit(" u"), "c1"), F.concat(F.lit("the "), "a")]
    teams = people.select(F.get(F.array(*forms), (F.col("k") % 4).cast("int")).alias("teamName"))
    other = people.where("a < 'h'").select(F.concat(F.lit("the "), "a").alias("teamName"), F.concat(F.lit("small "), "a").alias("club")).distinct()
    return pp.match_clubs(teams, clubs, other)
