"""Text functions as columns; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Python's str methods.
SPACE = r"(?U)[\s\x1c-\x1f]+"
# Fenced blocks (the last one may lack its end), inline code and list items.
FENCE = r"(?s)```[^\n`]*\n(.*?)(?:```|\z)"
INLINE = "`([^`\n]+)`"
LIST_ITEM = r"(?dmU)^\s*(?:[-*•]\s+|\d+[.)]\s+)"


def normalized(text: Column) -> Column:
    """Stripped, lower-cased, runs of white space as one space; null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "), "^ | $", "")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the normalised parts, one a line; a null part counts as empty."""
    return F.sha2(F.concat_ws("\n", *[normalized(p) for p in parts]), 256)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it, be it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(words: Column, size: int = 4) -> Column:
    """Distinct runs of ``size`` words; fewer words are one shingle, none give none."""

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(each))

    return let(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets without repeats; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def code_blocks(text: Column) -> Column:
    """Contents of fenced blocks that are not blank, an unterminated last one included."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FENCE), F.lit(1)), lambda b: b.rlike(r"(?U)[^\s\x1c-\x1f]"))


def inline_code(text: Column) -> Column:
    """Contents of single back quotes outside fences."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), FENCE, " "), F.lit(INLINE), F.lit(1))


def prose(text: Column) -> Column:
    """The text without code, fenced or inline."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), FENCE, " "), INLINE, " ")


def questions_in(plain: Column) -> Column:
    """Question marks of a prose, a run of them as one."""
    return F.regexp_count(plain, F.lit(r"\?+"))


def items_in(plain: Column) -> Column:
    """Lines of a prose that begin with a bullet or a number."""
    return F.regexp_count(plain, F.lit(LIST_ITEM))


def words_in(plain: Column) -> Column:
    """Words of a prose."""
    return F.size(F.filter(F.split(plain, SPACE), lambda w: w != ""))


def question_count(text: Column) -> Column:
    """Question marks outside code, a run of them as one."""
    return questions_in(prose(text))


def list_item_count(text: Column) -> Column:
    """Lines outside code that begin with a bullet or a number."""
    return items_in(prose(text))


def word_count(text: Column) -> Column:
    """Words outside code."""
    return words_in(prose(text))


def code_without_comments(code: Column) -> Column:
    """Line comments, block comments and white space removed, lower-cased."""
    plain = F.regexp_replace(F.coalesce(code, F.lit("")), r"(?d)(?:#|//)[^\n]*", "")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"(?s)/\*.*?\*/", ""), SPACE, ""))


def trailing_index(key: Column) -> Column:
    """The number after the last underscore at the end of an id, null if there is none."""
    return F.regexp_extract(key, r"_([0-9]+)$", 1).try_cast("int")


def grade(label: Column) -> Column:
    """A grader's spelling of yes or no as a boolean; anything else is null."""
    text = F.lower(F.trim(label))
    return F.when(text.isin("1", "true", "yes", "y", "pass", "passed", "t"), True).when(text.isin("0", "false", "no", "n", "fail", "failed"), False)


def unit_interval(value: Column) -> Column:
    """A number, or its spelling, clamped to 0..1; null if it is none."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def code_words(code: Column) -> Column:
    """Distinct lower-cased identifiers and numbers outside line comments."""
    plain = F.regexp_replace(F.coalesce(code, F.lit("")), r"(?d)(?:#|//)[^\n]*", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[0-9]+)"), F.lit(1)), F.lower))


def length(text: Column) -> Column:
    """Code points; null has none."""
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def is_blank(text: Column) -> Column:
    """Whether a text is null or white space only."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")
