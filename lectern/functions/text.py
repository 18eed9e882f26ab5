"""Text measures as Column expressions. Word characters are Unicode letters, digits and the underscore everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"(?U)\s+"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` uses it, inner lambdas included."""
    return F.transform(F.array(value), f)[0]


def tokens(text: Column) -> Column:
    """Runs of word characters of the lower-case text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def stripped(text: Column) -> Column:
    """``text`` without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Stripped, non-blank parts between runs of . ! ?"""
    return F.filter(F.transform(F.split(text, "[.!?]+"), stripped), lambda s: s != "")


def raw_sentences(text: Column, longer_than: int = 10) -> Column:
    """Parts between runs of . ! ? as they stand, of more than so many characters."""
    return F.filter(F.split(text, "[.!?]+"), lambda s: F.length(s) > longer_than)


def space_words(text: Column) -> Column:
    """Parts between runs of white space; blank text has none."""
    bare = stripped(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of ``phrase`` as a substring."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("long")


def occurrences_of_any(text: Column, phrases: list[str]) -> Column:
    total = F.lit(0).cast("long")
    for p in phrases:
        total = total + occurrences(text, p)
    return total


def syllables(word: Column) -> Column:
    """Vowel groups of a lower-case word, less one for a final e, at least one."""
    groups = F.size(F.regexp_extract_all(word, F.lit("[aeiouy]+"), F.lit(0)))
    return F.greatest(F.lit(1), groups - F.when(word.endswith("e"), 1).otherwise(0))


def collapsed(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def first_words(text: Column, n: int = 512) -> Column:
    return F.array_join(F.slice(space_words(text), 1, n), " ")


def search_tokens(*texts: Column) -> Column:
    """The distinct tokens of several texts, for containment search."""
    return F.array_distinct(tokens(F.concat_ws(" ", *texts)))


def word_mark(pattern: str) -> str:
    """A regular expression that finds ``pattern`` between characters that are not word characters."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({pattern})($|[^\p{{L}}\p{{N}}_])"


def statistics(text: Column) -> dict[str, Column]:
    """Counts, averages and flags of a text."""
    words, sents = F.size(space_words(text)), F.size(sentences(text))
    paragraphs = F.size(F.filter(F.split(text, "\n\n"), lambda p: stripped(p) != ""))
    per = words / F.nullif(sents, F.lit(0))
    return {
        "n_chars": F.length(text),
        "n_words": words,
        "n_sentences": sents,
        "n_paragraphs": paragraphs,
        "words_per_sentence": F.round(F.coalesce(per, F.lit(0.0)), 6),
        "is_substantial": words > 500,
        "is_short": words < 100,
        "complexity_level": F.when(F.coalesce(per, F.lit(0.0)) < 15, "simple").when(F.coalesce(per, F.lit(0.0)) < 25, "moderate").otherwise("complex"),
    }
