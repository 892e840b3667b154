"""Names and clubs by ordered stages: each stage once, ties, nulls, repeated rows."""
import pytest
from pyspark.sql import functions as F

from touchline.plans import people as pp


@pytest.fixture(scope="module")
def known(spark):
    people = spark.createDataFrame([(1, "Hee-Chan", "HWANG"), (2, "José", "Silva"), (3, "João", "Silva"), (4, "Luka", "Modrić"), (5, "Luka", "Modric"), (6, "Ana Maria", "Costa"),
                                    (7, "Florentino", "Luis"), (8, None, "Ronaldinho"), (9, "Pedro", None), (10, "Rui Manuel", "Alves"), (30, "Kim Min", "Lee"), (31, "Min Kim", "Lee"), (40, "Aa Bb", "Cc"), (41, "Bb Cc", "Aa"), (None, "No", "One")], "person int, forename string, surname string")
    squads = spark.createDataFrame([("Porto", "Diogo Costa", 20), ("Porto", "Pepe", 21), ("Porto", "Joao Mario Lopes", 22), ("Porto", "Joao Pedro Lopes", 23), ("Porto", "Mario Rui Vaz", 25), (None, "Pepe", 24)], "teamName string, name string, person int")
    return people, squads


CASES = [("Pepe", "PORTO", 21, 1), ("D. Costa", "Porto", 20, 2), ("Joao Mario", "Porto", 22, 3), ("Mario X Joao", "Porto", 22, 4), ("jose silva", None, 2, 5),
         ("Jose Silva Neto", None, 2, 6), ("Ana Costa", None, 6, 7), ("Costa da Ana Maria", None, 6, 7), ("Hwang Hee-Chan", None, 1, 7), ("Lee Kim Min", None, 30, 8), ("Cc Bb Aa", None, 40, 9), ("Alves Manuel Rui", None, 10, 7), ("R. Alves", None, 10, 10),
         ("X Hwang", None, 1, 11), ("Ronaldinho", None, 8, 5), ("Florentino", None, 7, 12), ("Silva", None, None, None), ("Luka Modric", None, None, None), ("", None, None, None),
         (None, "Porto", None, None), ("Pepe", None, None, None), ("Lopes", "Porto", None, None)]


def test_each_stage_and_the_unique_rule(spark, known):
    wanted = spark.createDataFrame([c[:2] for c in CASES] * 2, "name string, teamName string").withColumn("person", F.lit("clashes"))
    got = {(r.name, r.teamName): (r.person, r.stage) for r in pp.resolve_names(wanted, *known).collect()}
    assert len(got) == len(CASES)
    for name, team, person, stage in CASES:
        assert got[name, team] == (person, stage), (name, team, got[name, team])


def test_empty_tables(spark, known):
    people, squads = known
    wanted = spark.createDataFrame([("Ana", None)], "name string, teamName string")
    assert pp.resolve_names(wanted, people.limit(0), squads.limit(0)).collect()[0].person is None
    assert pp.resolve_names(wanted.limit(0), people, squads).count() == 0


def test_statistics_names_and_clubs(spark):
    players = spark.createDataFrame([("Bruno Silva",), ("Ana Silva",), ("Ana Silva",), ("Pelé",), (None,)], "playerName string")
    wanted = spark.createDataFrame([("BRUNO  SILVA",), ("B Silva",), ("C. Silva",), ("pele",), ("nobody",), (None,)], "name string")
    got = {r.name: (r.playerName, r.stage) for r in pp.resolve_stats_players(wanted, players).collect()}
    assert got == {"BRUNO  SILVA": ("Bruno Silva", 1), "B Silva": ("Bruno Silva", 2), "C. Silva": ("Ana Silva", 3), "pele": ("Pelé", 1), "nobody": (None, None), None: (None, None)}
    clubs = spark.createDataFrame([(1, "Leeds United"), (2, "Leeds United U21"), (3, "AFC Leeds United U21"), (4, "Real Sociedad"), (5, "Leeds United"), (None, "Ghost"), (6, None)], "club_id int, club string")
    teams = spark.createDataFrame([("Leeds",), ("leeds-united",), ("U21 Leeds",), ("Sociedad B",), ("La Real",), ("Gone",), (None,)], "teamName string")
    other = spark.createDataFrame([("La Real", "Real Sociedad"), ("Gone", "No Club")], "teamName string, club string")
    got = {r.teamName: (r.club_id, r.stage) for r in pp.match_clubs(teams, clubs, other).collect()}
    assert got == {"Leeds": (1, 3), "leeds-united": (1, 2), "U21 Leeds": (2, 3), "Sociedad B": (None, None), "La Real": (4, 1), "Gone": (None, None), None: (None, None)}


def test_a_common_surname_does_not_multiply(spark):
    people = spark.range(3000).select(F.col("id").alias("person"), F.concat(F.lit("a"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("forename"), F.lit("silva").alias("surname"))
    keys = pp.known_names(people, spark.createDataFrame([], "teamName string, name string, person bigint"))
    assert keys.where("kind = 'surname'").count() == 1 and keys.where("kind = 'initial'").count() == 1
    assert keys.groupBy("kind", "key").count().where("kind in ('name around', 'name inside')").agg(F.max("count")).first()[0] == 1


def test_common_words_do_not_multiply(spark):
    """Three-word names that share two of them: the join meets one row for each key, not every name with these words."""
    people = spark.range(200).select(F.col("id").alias("person"), F.concat(F.lit("ann x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("forename"), F.lit("silva").alias("surname"))
    squads = people.select(F.lit("porto").alias("teamName"), F.concat_ws(" ", "forename", "surname").alias("name"), "person")
    keys = pp.known_names(people, squads).where("kind not in ('name around', 'squad around')")
    assert keys.groupBy("kind", "team", "key").count().agg(F.max("count")).first()[0] == 1
    wanted = spark.createDataFrame([("silva xb", None), ("silva xbc ann y", None), ("silva ann", "Porto"), ("xb ann", "porto"), ("q silva ann xbc", "Porto")], "name string, teamName string")
    got = {(r.name, r.teamName): (r.person, r.stage) for r in pp.resolve_names(wanted, people, squads).collect()}
    assert got == {("silva xb", None): (1, 7), ("silva xbc ann y", None): (12, 7), ("silva ann", "Porto"): (None, None), ("xb ann", "porto"): (1, 3), ("q silva ann xbc", "Porto"): (12, 2)}


def test_long_names_lie_in_each_other_as_short_ones(spark, monkeypatch):
    """Names of three to nine words, wanted with fewer and with more words in another order, for several bounds on the words whose subsets are keys."""
    words = {n: [f"{w}{n}" for w in "abcdefgh"[:n - 1]] for n in range(3, 10)}
    squads = spark.createDataFrame([("T", " ".join([*w, "z"]), n) for n, w in words.items()], "teamName string, name string, person int")
    people = spark.createDataFrame([(n, " ".join(w), "z") for n, w in words.items()], "person int, forename string, surname string")
    wanted = [(" ".join([*extra, *reversed(w[cut:]), "z"]), n) for n, w in words.items() for extra, cut in (([], 1), (["y"], 0), (["x", "y"], 0))]
    df = spark.createDataFrame([(name, t) for name, _ in wanted for t in ("T", None)], "name string, teamName string")
    for few in (2, 6):
        monkeypatch.setattr(pp, "FEW", few)
        got = {(r.name, r.teamName): (r.person, r.stage) for r in pp.resolve_names(df, people, squads).collect()}
        assert got == {(name, t): (n, 3 if t else 7) for name, n in wanted for t in ("T", None)}
