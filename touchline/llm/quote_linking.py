"""Chat formatting by quotation linking, in JVM functions only.

Lines that begin with '>' marks are quotes; the number of marks is their level. Lines of one level in a row are a passage. A
quoted passage, and each of its lines, is normalised (lower case, single blanks) and hashed; so are the own (unquoted)
passages and lines of every message. A quoted passage of any level is joined to the latest earlier message of its
conversation whose own text holds it. The lowest level that finds a message decides: the reply goes to the message that
most quoted characters of that level lead to (then the latest). Replies
form threads; a conversation in reply order goes by thread (its first turn), then turn. Quotes that are linked or not are
left out of the formatted text.

Each row of the table gives one row: nothing is collected by conversation, so a conversation may be of any length. Rows
with the same conversation and turn share links. Null text counts as empty. Rows whose conversation or turn is null link
with nothing and are their own thread. Role null is formatted as 'unknown'. Marks of the template in a text are broken up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import written
from touchline.llm.native import let, neighbours

QUOTE = r"^[ \t]*((?:>[ \t]*)*)"
PREFIX = 64  # characters of the own text that deal rows to tasks when places are counted


def _lines(text: Column) -> Column:
    """array<struct<level, body>>"""
    def one(line):
        marks = F.regexp_extract(line, QUOTE, 1)
        level = F.length(marks) - F.length(F.translate(marks, ">", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(line, QUOTE, "")).otherwise(line).alias("body"))
    return F.transform(F.split(text, "\r?\n"), one)


def _passages(lines: Column) -> Column:
    """array<struct<level, bodies>>: lines of one level in a row."""
    def cut(starts, all_lines):
        return F.transform(starts, lambda s: F.struct(
            F.element_at(all_lines, s["at"])["level"].alias("level"),
            F.transform(F.slice(all_lines, s["at"], s["size"]), lambda x: x["body"]).alias("bodies")))

    def starts(all_lines):
        n = F.size(all_lines)
        changes = F.filter(F.transform(neighbours(all_lines, n, lambda a, b: a["level"] != b["level"]), lambda c, i: F.when(c, i + 2)), lambda c: c.isNotNull())
        edges = F.concat(F.array(F.lit(1)), F.coalesce(changes, F.array().cast("array<int>")), F.array(n + 1))
        return let(edges, lambda e: neighbours(e, F.size(e), lambda a, b: F.struct(a.alias("at"), (b - a).alias("size"))))

    return let(lines, lambda x: cut(starts(x), x))


def _plain(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def _units(passage: Column) -> Column:
    """Normalised texts by which a passage is found: whole, and line by line if it has several."""
    return F.array_distinct(F.filter(F.concat(F.array(_plain(F.array_join(passage["bodies"], " "))), F.transform(passage["bodies"], _plain)), lambda x: x != ""))


def parsed(messages: DataFrame) -> DataFrame:
    """The rows with their passages, own text and deepest quote level."""
    base = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = base.withColumn("passages", _passages(_lines(F.col("text"))))
    own = F.trim(F.array_join(F.flatten(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["bodies"])), "\n"))
    return cut.select("conv_id", "turn", "role", "text", "passages", own.alias("own_text"),
                      F.array_max(F.transform("passages", lambda p: p["level"])).cast("int").alias("quote_level"),
                      F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("n_quotes"))


def replies(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of messages whose quotes are found in an earlier message."""
    keyed = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    unit = lambda wanted: keyed.select("conv_id", "turn", F.explode(F.filter("passages", wanted)).alias("p")).select(
        "conv_id", "turn", F.col("p")["level"].alias("level"), F.explode(_units(F.col("p"))).alias("unit")).select(
        "conv_id", "turn", "level", F.sha2("unit", 256).alias("mark"), F.length("unit").alias("size"))
    # A mark leads to the same message at each level of a row, so its lowest level is enough.
    quoted = unit(lambda p: p["level"] > 0).groupBy("conv_id", "turn", "mark", "size").agg(F.min("level").alias("level"))
    asked = quoted.select("conv_id", "mark").distinct()
    own = unit(lambda p: p["level"] == 0).drop("level").join(asked, ["conv_id", "mark"], "left_semi").distinct()
    nothing = F.lit(None).cast("long")
    both = own.withColumn("source", F.col("turn")).withColumn("level", nothing).unionByName(quoted.withColumn("source", nothing))
    before = Window.partitionBy("conv_id", "mark").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("at", F.max("source").over(before)).where(F.col("source").isNull() & F.col("at").isNotNull())
    weight = found.groupBy("conv_id", "turn", "level", "at").agg(F.sum("size").alias("weight"))
    return weight.groupBy("conv_id", "turn").agg(F.max_by("at", F.struct(-F.col("level"), "weight", "at")).alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread): the first message reached by replies, by pointer doubling; rounds grow
    with the logarithm of the deepest thread."""
    now = written(links.withColumn("thread", F.col("reply_to")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        step = written(now.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", "reply_to", F.coalesce("above", "thread").alias("thread"),
                                                                         F.col("above").isNotNull().alias("moved")), "threads")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with their place in the conversation: by thread, turn, role, own text, null first.

    Rows are dealt to tasks by ranges of these columns and sorted there, so a conversation may lie in many tasks, whether it
    is one thread or has no turns. A row's place is the number of rows its conversation has in earlier tasks and its own
    number in its task. Texts are formatted after they are dealt. Ranges look at the beginning of the text only, which keeps the order and what the driver samples small."""
    key = ["conv_id", "thread", "turn", "role"]
    dealt = rows.repartitionByRange(*key, F.substring("own_text", 1, PREFIX)).sortWithinPartitions(*key, "own_text")
    safe = F.regexp_replace("own_text", r"<\|", "< |")
    chat = F.concat(F.lit("<|"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.lit("|>\n"), safe, F.lit("\n<|end|>\n"))
    numbered = written(dealt.select(*key, "reply_to", "quote_level", "n_quotes", chat.alias("chat")).withColumn("number", F.monotonically_increasing_id())
                       .withColumn("part", F.shiftright("number", 33)), "placed")
    counts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    earlier = counts.select(F.col("conv_id").alias("c2"), F.col("part").alias("p2"), "first", (F.sum("n").over(
        Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("earlier"))
    return (numbered.join(earlier, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")))
            .withColumn("place", F.col("earlier") + F.col("number") - F.col("first")))


def formatted(messages: DataFrame) -> DataFrame:
    """One row per row: conv_id, turn, role, reply_to, thread, place (in reply order, from 0), quote_level, n_quotes, chat."""
    rows = parsed(messages)
    tied = threads(replies(rows)).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply_to", "thread")
    joined = (rows.join(tied, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
              .withColumn("thread", F.coalesce("thread", "turn")))
    return _placed(joined).select("conv_id", "turn", "role", "reply_to", "thread", "place", "quote_level", "n_quotes", "chat")
