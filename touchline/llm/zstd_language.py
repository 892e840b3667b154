"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of training texts. A text is cut into blocks, each block is
compressed with each language's dictionary, and the language with the smallest sum wins; blocks are
compressed on their own, so that a long text does not become its own dictionary. Case, digits and marks say little about the
language: texts and dictionaries are in lower case with letters only, one blank between words. The score is the margin to the second, as a
share of the second's size, from 0 to 1; a prediction with a margin below `MARGIN` is marked rejected.

Training: of documents with a language and a text whose crc32(doc_id as text) mod 4 is not 2, for each language the `TEXTS`
of least hashed id, `PIECE` characters of each at most (the bound of what is learned from), from a place that a second hash of
the id gives, so every part of long texts is learned from; prediction reads whole texts
and nothing but the text. Repeated rows count as often as they stand there. The `LANGUAGES` of most training rows are learned, of equal ones the
first by name, which bounds what reaches the driver and the tasks. Of equal sums the language with more training texts wins, then the first by name. Null text, or text without a letter, is `und` with score 0. So is
every text if there is nothing to learn from. With one language the score is 1. Rows without a doc_id are not held out and not learned from.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import arrow_rows

LANGUAGES = 64
TEXTS = 256
PIECE = 1500
BLOCK = 2048
LEVEL = 9
MARGIN = 0.01
UNKNOWN = "und"


OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).encode()


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, texts: int = TEXTS, piece: int = PIECE, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionary content of at most `languages` languages, those with most training texts first: at most texts * piece characters each."""
    rows = docs.select(F.col("doc_id"), "lang", F.col("text").cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0) & ~held_out())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "piece")
    places = F.greatest(F.length("text") - piece, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("doc_id", F.lit("place")), places) + 1).cast("int")
    # the window keeps the first rows of each task before anything is shuffled
    first = (rows.where(F.col("lang").isin(list(counts))).select("lang", "doc_id", F.substring("text", start, F.lit(piece)).alias("piece"))
             .withColumn("n", F.row_number().over(order)).where(F.col("n") <= texts))
    content: dict = {lang: [] for lang in counts}
    for r in first.orderBy("lang", "n").collect():
        content[r["lang"]].append(r["piece"])
    return {str(lang): plain(" ".join(reversed(pieces))) for lang, pieces in content.items()}


class Judge:
    """Compressors of all languages; made once in each task."""

    def __init__(self, content: dict[str, bytes]):
        self.languages = list(content)
        self.compressors = []
        for data in content.values():
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, list[int]]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, []
        data = plain(text)
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.languages[best], 1.0 if second is None else (second - sizes[best]) / second, sizes


def predict(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def rows(source):
        judge = Judge(shared.value)
        for ident, held, text in source:
            language, score, _ = judge(text)
            yield ident, held, language, score, language == UNKNOWN or score < margin

    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")),
                      "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", rows)


def identified(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
