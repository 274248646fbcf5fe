"""Text expressions. All are plain column expressions and see the whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import bind


def trim_all(text: Column) -> Column:
    """Trim every kind of white space; Spark's trim takes blanks only."""
    return F.regexp_replace(text, r"^\s++|(?<!\s)\s++$", "")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    return squash(F.lower(text))


def truncate_text(text: Column, length: int) -> Column:
    return F.when(F.length(text) <= length, text).otherwise(
        F.concat(F.substring(text, 1, length - 3), F.lit("..."))
    )


def words_of(text: Column) -> Column:
    """Lower-case words after every non-word character became a blank."""
    return F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+")


def text_similarity(left: Column, right: Column) -> Column:
    """Share of common words among all words of two texts (Jaccard on word sets)."""
    words = F.struct(
        F.array_distinct(F.split(F.lower(left), r"\s+")).alias("a"),
        F.array_distinct(F.split(F.lower(right), r"\s+")).alias("b"),
    )

    def share(w: Column) -> Column:
        common = F.size(F.array_intersect(w["a"], w["b"]))
        return common.cast("double") / (F.size(w["a"]) + F.size(w["b"]) - common)

    return bind(words, share)


def split_list(text: Column, separator: str = "[|]") -> Column:
    """A separated string as an array; null and empty give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda x: x != "")


def join_list(values: Column, separator: str = "|") -> Column:
    return F.array_join(values, separator)


def decode_json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def title_case_words(text: Column) -> Column:
    """Upper-case the first letter of every word and leave the rest."""
    words = F.split(text, " ")
    upped = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.array_join(upped, " ")


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
