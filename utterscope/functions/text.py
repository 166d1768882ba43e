"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
_BETWEEN_WORDS = r"[^\p{IsAlphabetic}\p{N}]+"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end; the built-in trim only knows the blank."""
    return F.regexp_replace(text, _EDGES, "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and numbers; null stays null."""
    return F.filter(F.split(F.lower(text), _BETWEEN_WORDS), lambda w: w != "")


def normalized(text: Column) -> Column:
    """The words, joined by single blanks."""
    return F.array_join(words(text), " ")


def file_stem(timestamp: Column) -> Column:
    """A timestamp as part of a file name."""
    return F.translate(timestamp, ":.", "--")
