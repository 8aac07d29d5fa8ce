"""Text functions: Column in, Column out, all inside the JVM unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
ALNUM = r"[\p{L}\p{N}]+"
# Fixed value: the ASCII punctuation marks in their order, and the two angle quotes.
_PUNCT = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~«»]"
#: White space after a full stop or question mark, unless an abbreviation, an initial or a "Mr."-like title stands before it.
SENTENCE_BREAK = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` evaluated once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an underscore separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(ALNUM), F.lit(0))


def join_numbers(text: Column) -> Column:
    """Drop white space between two digits; matches don't overlap, so ``1 2 3 4`` gives ``12 34``."""
    return F.regexp_replace(text, r"([0-9])\s+([0-9])", "$1$2")


def remove_entities(text: Column) -> Column:
    return F.regexp_replace(text, "&[0-9a-z_A-Z]+;", " ")  # fixed value


def strip_punct(text: Column) -> Column:
    return F.regexp_replace(text, _PUNCT, " ")


def normalise(text: Column) -> Column:
    """Numbers joined, entities dropped, punctuation blanked, lower case: in this order."""
    return F.lower(strip_punct(remove_entities(join_numbers(text))))


def split_dump(text: Column) -> Column:
    """Tokens of a text dump: split at white space and ``. , - _ ?``; empty ones may come at the ends."""
    return F.split(F.lower(text), r"[\s.,\-_?]+", -1)


def sentences(text: Column) -> Column:
    """Sentences of a text, in order."""
    return F.split(text, SENTENCE_BREAK, -1)


def sentence_words(sentence: Column, stop: list[str] | None = None, stem: Callable[[Column], Column] | None = None) -> Column:
    """Words of a sentence as they stand, without stop words (tested before stemming, by case), then stemmed; duplicates stay."""
    found = F.regexp_extract_all(sentence, F.lit(WORD), F.lit(0))
    if stop:
        found = F.filter(found, lambda w: ~w.isin(stop))
    return F.transform(found, stem) if stem else found


def space_tokens(text: Column) -> Column:
    """Split at single spaces, trailing white space cut, empty tokens dropped."""
    return F.filter(F.transform(F.split(text, " ", -1), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def short_tokens(text: Column, limit: int = 11) -> Column:
    """:func:`space_tokens` of fewer than ``limit`` bytes."""
    return F.filter(space_tokens(text), lambda x: F.octet_length(x) < limit)


def squeezed_text(text: Column) -> Column:
    """Line breaks to spaces, only Latin and Russian letters (without yo), digits and spaces kept, runs of spaces made one."""
    flat = F.regexp_replace(text, r"[(\r\n|\r|\n)]+", " ")  # fixed values, here and below
    return F.regexp_replace(F.regexp_replace(flat, "[^0-9a-zA-Zа-яА-Я ]+", ""), " +", " ")


def lemmas(tokens: Column, lemmatise: Callable[[str], str]) -> Column:
    """Lemma of every token by a pluggable Python function, called once per distinct token of an Arrow batch."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(t: str) -> str:
            if t not in known:
                known[t] = lemmatise(t)
            return known[t]

        return batch.map(lambda ts: None if ts is None else [one(t) for t in ts])

    return run(tokens)


def decoded(binary: Column, charset: str = "UTF-8") -> Column:
    return F.decode(binary, charset)
