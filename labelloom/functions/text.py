"""Tokens, n-grams, answer parsing and request texts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word pattern (runs of two or more letters, digits, underscores),
# the marker for an answer that names no single class, and the texts around
# class definitions and messages in a request.
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"
INVALID = "INVALID"
CLASS_LINE = "- {label}: {description}"
BEFORE_MESSAGE = "Customer message:\n"
AFTER_MESSAGE = "\n\nClass:"


def words(text: Column) -> Column:
    """Lower-case word tokens of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1))


def parsed_answer(answer: Column, labels: Sequence[str]) -> Column:
    """One class from a free-text answer, or ``INVALID``.

    Labels consist of ``A-Z`` and ``_`` only, so a label stands as a whole word
    exactly when it is one of the pieces between all other characters.
    """
    valid = F.array(*[F.lit(label) for label in labels])
    cleaned = F.upper(F.trim(answer, F.lit(" \t\n\r\f\v")))
    named = F.array_intersect(F.split(F.regexp_replace(cleaned, "[^A-Z_]", " "), " +"), valid)
    return (
        F.when(F.array_contains(valid, cleaned), cleaned)
        .when(F.size(named) == 1, F.get(named, F.lit(0)))
        .otherwise(F.lit(INVALID))
    )


def class_list_text(classes: Sequence[tuple[str, str]]) -> Column:
    """``- label: description`` lines in definition order."""
    return F.lit("\n".join(CLASS_LINE.format(label=label, description=text) for label, text in classes))


def system_message(task: str, classes: Sequence[tuple[str, str]]) -> Column:
    """Instructions and class list, equal for every request of a run."""
    return F.concat(F.lit(task + "\n\n"), class_list_text(classes), F.lit("\n"))


def user_message(text: Column) -> Column:
    """The text to classify, framed for a chat model."""
    return F.concat(F.lit(BEFORE_MESSAGE), text, F.lit(AFTER_MESSAGE))
