"""Names: folding, tokens, similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Letters that do not decompose, with their plain forms.
_WHOLE = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T"}
_WIDE = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D"}


def _latin_letters() -> dict[str, str]:
    """Accented letters of the Latin blocks and the plain letter each decomposes to."""
    found = dict(_WHOLE)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            found[chr(code)] = plain
    return found


_LETTERS = _latin_letters()
# Words that do not tell clubs apart.
CLUB_WORDS = ["fc", "cf", "afc", "sc", "ac", "club", "the", "de"]


def ascii_fold(c: Column) -> Column:
    """Latin letters without accents, combining marks dropped; NULL stays NULL. Plain text, most of it, is passed as it is."""
    plain = F.translate(F.regexp_replace(c, "[\\u0300-\\u036f]", ""), "".join(_LETTERS), "".join(_LETTERS.values()))
    for letter, pair in _WIDE.items():
        plain = F.replace(plain, F.lit(letter), F.lit(pair))
    return F.when(c.rlike("[^\\x00-\\x7f]"), plain).otherwise(c)


def normal_name(c: Column) -> Column:
    """Lower case, no accents, single spaces."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(c)), r"[^a-z0-9]+", " "))


def name_tokens(c: Column, drop=tuple(CLUB_WORDS)) -> Column:
    """Sorted distinct words of a normal name without filler words."""
    words = F.array_distinct(F.filter(F.split(normal_name(c), " "), lambda w: w != ""))
    return F.array_sort(F.array_except(words, F.array(*[F.lit(w) for w in drop])))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


@F.pandas_udf(T.DoubleType())
def ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings (0-1)."""
    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length: stays inside the JVM."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))


def literal_qualifiers(c: Column) -> Column:
    """Qualifier names out of Python-literal text: a list of dicts with a type (a word, or a dict with a display name), or of words."""
    typed = F.regexp_extract_all(c, F.lit(r"""["']type["']\s*:\s*(?:\{[^{}]*?["']displayName["']\s*:\s*)?["']([^"']*)["']"""), F.lit(1))
    words = F.regexp_extract_all(c, F.lit(r"""["']([^"']*)["']"""), F.lit(1))
    return F.when(c.rlike(r"^\s*[\[({]"), F.when(c.rlike(r"""["']type["']\s*:"""), typed).otherwise(words))


def qualifier_names(c: Column) -> Column:
    """Names from JSON text where it parses, else from literal text."""
    parsed = F.from_json(c, "array<struct<type:string,value:string>>", {"allowSingleQuotes": "false"})
    named = F.transform(parsed, lambda q: q["type"])
    good = parsed.isNotNull() & F.coalesce(F.forall(named, lambda n: n.isNotNull()), F.lit(False))
    return F.when(good, named).otherwise(literal_qualifiers(c))
