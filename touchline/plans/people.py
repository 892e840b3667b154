"""Names of people and clubs matched to known ones by ordered stages.

A name is turned into keys, a known name into keys of the same kinds, and one equi-join on (kind, team, key) finds all stages at
once. Known keys are folded before the join to one row for each key, so a common surname never multiplies. Whether one token set
lies in another is an equal key too: the inner set is one of the outer set's subsets, which a name of up to `FEW` tokens gives as keys.
Only where the outer name is longer are known sets kept beside a key of one end (a set that lies in another shares its longest
tokens with it) and compared afterwards. Keys are below 2 ** `FEW` for short names and grow with the square of the words for others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.names import ascii_fold

FEW = 6  # most tokens of a name whose subsets are keys

#: Stages in the order in which they decide.
STAGES = {1: "squad name", 2: "squad surname", 3: "squad tokens", 4: "squad two tokens", 5: "full name", 6: "leading pair", 7: "part of name",
          8: "surname first", 9: "reversed", 10: "surname and initial", 11: "surname", 12: "one word"}


def c(name):
    return F.col(name)


def name_key(x: Column) -> Column:
    """Lower case without accents, words parted by one space; hyphens part words. NULL becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(ascii_fold(x)), r"[\s-]+", " ")), F.lit(""))


def _words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def _join(words: Column) -> Column:
    return F.array_join(words, " ")


def _longest(tokens: Column, n: int) -> Column:
    """The n longest tokens (of equal length the first by name) in order, joined; no entry if there are fewer."""
    ranked = F.slice(F.array_sort(F.transform(tokens, lambda t: F.struct(-F.length(t), t.alias("t")))), 1, n)
    return F.when(F.size(tokens) >= n, F.array(_join(F.array_sort(F.transform(ranked, lambda r: r["t"]))))).otherwise(F.array().cast("array<string>"))


def _pairs(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, lambda a: F.transform(F.filter(tokens, lambda b: b > a), lambda b: F.concat_ws(" ", a, b))))


def _subsets(tokens: Column, least: int) -> Column:
    """Every subset of at least so many of the sorted tokens, joined; none for more than `FEW` tokens."""
    bits = F.filter(F.sequence(F.lit(1), F.pow(F.lit(2), F.least(F.size(tokens), F.lit(FEW))).cast("int") - 1), lambda m: F.bit_count(m) >= least)
    chosen = lambda m: F.filter(tokens, lambda t, i: F.getbit(m, i) == 1)
    return F.when(F.size(tokens).between(max(least, 1), FEW), F.transform(bits, lambda m: _join(chosen(m)))).otherwise(F.array().cast("array<string>"))


def _if(when: Column, keys: Column) -> Column:
    return F.when(when, keys).otherwise(F.array().cast("array<string>"))


def _one(key: Column, when: Column) -> Column:
    return _if(when, F.array(key))


def _keys(*parts) -> Column:
    """One array of (kind, stage, key) from several (kind, stage, array of keys)."""
    def told(kind, stage, keys):
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), F.lit(stage).alias("stage"), k.alias("key")))

    return F.concat(*[told(*part) for part in parts])


#: Kinds of outer names of more than `FEW` tokens, whose token sets are compared after the join: the wanted set in the known one, or the
#: known one in the wanted.
INSIDE, AROUND = ("squad inside", "name inside"), ("squad around", "name around")


def _folded(rows: DataFrame) -> DataFrame:
    """Known keys with the least and the largest person of each; token sets are kept where they are compared."""
    kept = F.when(c("k.kind").isin(*INSIDE, *AROUND), c("known"))
    return (rows.select("person", "team", "known", F.explode("keys").alias("k")).groupBy(c("k.kind").alias("kind"), "team", c("k.key").alias("key"), kept.alias("known"))
            .agg(F.min("person").alias("lo"), F.max("person").alias("hi")))


def known_names(people: DataFrame, squads: DataFrame) -> DataFrame:
    """Keys of all known names. ``people``: person, forename, surname; ``squads``: teamName, name, person.

    A full name of two different persons names nobody; its surname and forename still count.
    """
    p = people.select("person", name_key(c("forename")).alias("fore"), name_key(c("surname")).alias("sur")).where(c("person").isNotNull())
    p = p.withColumn("full", F.trim(F.concat_ws(" ", "fore", "sur")))
    full = p.where("full <> ''").groupBy("full").agg(F.min("person").alias("person"), F.max("person").alias("_hi")).where("person = _hi").select(
        "person", F.lit("").alias("team"), F.array_sort(F.array_distinct(_words(c("full")))).alias("known"), "full")
    long = F.size("known") > FEW
    by_full = full.select("person", "team", "known", _keys(
        ("full", 0, F.array("full")), ("name part", 0, _subsets(c("known"), 2)), ("name set", 0, _one(_join(c("known")), F.size("known").between(2, FEW))),
        ("name inside", 0, _if(long, _pairs(c("known")))), ("name around", 0, _longest(c("known"), 2))).alias("keys"))
    has_both = (c("fore") != "") & (c("sur") != "")
    by_part = p.select("person", F.lit("").alias("team"), F.lit(None).cast("array<string>").alias("known"), _keys(
        ("surname", 0, _one(c("sur"), c("sur") != "")), ("initial", 0, _one(F.concat_ws("|", F.substring("fore", 1, 1), "sur"), has_both)), ("forename", 0, _one(c("fore"), has_both))).alias("keys"))
    s = squads.select("person", name_key(c("teamName")).alias("team"), name_key(c("name")).alias("full")).where("person is not null and full <> '' and team <> ''")
    s = s.withColumn("known", F.array_sort(F.array_distinct(_words(c("full")))))
    by_squad = s.select("person", "team", "known", _keys(
        ("squad full", 0, F.array("full")), ("squad token", 0, c("known")), ("squad part", 0, _subsets(c("known"), 1)), ("squad set", 0, _one(_join(c("known")), ~long)),
        ("squad inside", 0, _if(long, c("known"))), ("squad around", 0, _longest(c("known"), 1)), ("squad pair", 0, _pairs(c("known")))).alias("keys"))
    return _folded(by_full.unionByName(by_part).unionByName(by_squad))


def resolve_names(wanted: DataFrame, people: DataFrame, squads: DataFrame) -> DataFrame:
    """One row for each wanted (name, teamName) with the person and the stage that found them, NULL where none did.

    A stage counts only where it names exactly one person; the first such stage decides. A NULL team skips the squad stages, a NULL
    or empty name has no person. Repeated rows give one row.
    """
    w = wanted.select("name", "teamName").distinct().withColumn("full", name_key(c("name"))).withColumn("team", name_key(c("teamName")))
    w = w.withColumn("parts", _words(c("full"))).withColumn("tokens", F.array_sort(F.array_distinct(c("parts")))).withColumn("n", F.size("parts"))
    last, first, some, two = F.try_element_at("parts", F.lit(-1)), F.get("parts", F.lit(0)), c("n") > 0, c("n") > 1
    squad = some & (c("team") != "")
    in_squad = lambda keys: _if(squad, keys)
    long, whole = F.size("tokens") > FEW, _join(c("tokens"))
    turned = F.concat(F.slice("parts", 2, F.greatest(c("n") - 1, F.lit(1))), F.slice("parts", 1, 1))
    keys = _keys(("squad full", 1, _one(c("full"), squad)), ("squad token", 2, _one(last, squad)), ("squad part", 3, _one(whole, squad & ~long)),
                 ("squad set", 3, in_squad(_subsets(c("tokens"), 1))), ("squad inside", 3, in_squad(_longest(c("tokens"), 1))),
                 ("squad around", 3, in_squad(_if(long, c("tokens")))), ("squad pair", 4, in_squad(_pairs(c("tokens")))), ("full", 5, _one(c("full"), some)),
                 ("full", 6, _one(_join(F.slice("parts", 1, 2)), c("n") > 2)), ("name part", 7, _one(whole, F.size("tokens").between(2, FEW))),
                 ("name set", 7, _subsets(c("tokens"), 2)), ("name inside", 7, _longest(c("tokens"), 2)), ("name around", 7, _if(long, _pairs(c("tokens")))),
                 ("full", 8, _one(_join(turned), two)), ("full", 9, _one(_join(F.reverse("parts")), two)), ("initial", 10, _one(F.concat_ws("|", F.substring(first, 1, 1), last), two)),
                 ("surname", 11, _one(last, some)), ("forename", 12, _one(c("full"), c("n") == 1)))
    w = w.select("name", "teamName", "tokens", "team", F.explode_outer(keys).alias("k")).select(
        "name", "teamName", "tokens", "k.kind", "k.key", "k.stage", F.when(c("k.kind").startswith("squad"), c("team")).otherwise(F.lit("")).alias("team"))
    hit = w.join(known_names(people, squads), ["kind", "team", "key"], "left")
    holds = (F.when(c("kind").isin(*INSIDE), F.size(F.array_except("tokens", "known")) == 0)
             .when(c("kind").isin(*AROUND), F.size(F.array_except("known", "tokens")) == 0).otherwise(F.lit(True)))
    per = hit.groupBy("name", "teamName", "stage").agg(F.min(F.when(holds, c("lo"))).alias("person"), F.max(F.when(holds, c("hi"))).alias("_hi"))
    found = F.when(c("person") == c("_hi"), c("stage"))
    return per.groupBy("name", "teamName").agg(F.min_by("person", found).alias("person"), F.min(found).alias("stage"))


def resolve_stats_players(wanted: DataFrame, players: DataFrame) -> DataFrame:
    """The statistics name for each wanted ``name``: the same name, else one with its last word and first letter, else one with its
    last word; of several the first by name. NULL where no last word fits."""
    p = players.select("playerName").distinct().withColumn("full", name_key(c("playerName"))).where("full <> ''")
    last, first = F.try_element_at(F.split("full", " "), F.lit(-1)), F.substring("full", 1, 1)
    keys = lambda: F.explode_outer(F.when(c("full") != "", F.array(*[F.struct(F.lit(n).alias("stage"), k.alias("key")) for n, k in (
        (1, c("full")), (2, F.concat_ws("|", first, last)), (3, last))]))).alias("k")
    known = p.select("playerName", keys()).groupBy(c("k.stage").alias("stage"), c("k.key").alias("key")).agg(F.min("playerName").alias("playerName"))
    w = wanted.select("name").distinct().withColumn("full", name_key(c("name"))).select("name", keys()).select("name", "k.stage", "k.key")
    hit = w.join(known, ["stage", "key"], "left")
    found = F.when(c("playerName").isNotNull(), c("stage"))
    return hit.groupBy("name").agg(F.min_by("playerName", found).alias("playerName"), F.min(found).alias("stage"))


def match_clubs(teams: DataFrame, clubs: DataFrame, other_names: DataFrame | None = None) -> DataFrame:
    """A club for each ``teamName``: another name where one is given (teamName, club), else the same name, else the shortest club name
    that holds all its words (of equal length the first by name). Of clubs with one name the least id holds.

    Close spellings are not matched. Stage 1 is another name, which then decides even if no club has it; 2 the same name; 3 words inside.
    """
    club = lambda x: F.trim(F.regexp_replace(F.lower(ascii_fold(x)), r"[\s./-]+", " "))
    known = clubs.select(club(c("club")).alias("full"), "club_id").where("full <> '' and club_id is not null").groupBy("full").agg(F.min("club_id").alias("club_id"))
    known = known.withColumn("known", F.array_distinct(_words(c("full"))))
    known = known.select("full", "club_id", "known", F.explode(_keys(("same", 0, F.array("full")), ("inside", 0, c("known")))).alias("k")).select("full", "club_id", "known", "k.kind", "k.key")
    t = teams.select("teamName").distinct()
    t = t.join(other_names.groupBy("teamName").agg(F.min("club").alias("other")), "teamName", "left") if other_names is not None else t.withColumn("other", F.lit(None).cast("string"))
    t = t.withColumn("full_w", F.coalesce(club(F.coalesce("other", "teamName")), F.lit(""))).withColumn("tokens", F.array_distinct(_words(c("full_w"))))
    keys = _keys(("same", 2, _one(c("full_w"), c("full_w") != "")), ("inside", 3, F.when(c("other").isNull(), _longest(c("tokens"), 1)).otherwise(F.array().cast("array<string>"))))
    t = t.select("teamName", "tokens", "other", F.explode_outer(keys).alias("k")).select("teamName", "tokens", "other", "k.kind", "k.key", "k.stage")
    hit = t.join(known, ["kind", "key"], "left")
    fits = c("club_id").isNotNull() & (F.size(F.array_except("tokens", "known")) == 0)
    order = F.when(fits, F.struct(F.when(c("other").isNotNull(), 1).otherwise(c("stage")).alias("stage"), F.length("full"), c("full")))
    return hit.groupBy("teamName").agg(F.min_by("club_id", order).alias("club_id"), F.min(order)["stage"].alias("stage"))
