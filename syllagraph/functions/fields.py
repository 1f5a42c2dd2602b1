"""Scalar functions: cleaning, keys, degrees, bands, labels, number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is trimmed from both ends of a field, in any mixture: white space, quotes, byte-order marks, zero-width blanks.
EDGE = r'[\s"\x{FEFF}\x{200B}]+'


def clean_field(c: Column) -> Column:
    """Trimmed field; its interior stays."""
    return F.regexp_replace(c, rf"(?U)^{EDGE}|{EDGE}$", "")


def split_fields(line: Column) -> Column:
    """Cleaned fields of a line, cut at every comma: quotes don't protect one."""
    return F.transform(F.split(line, ","), clean_field)


def field_at(fields: Column, header: Column, name: str) -> Column:
    """The field below the first header of that name in any case; null without one. header: lower-case names."""
    at = F.array_position(header, name.lower())
    return F.when(at > 0, F.get(fields, at.cast("int") - 1))


def natural_key(prefix: Column, number: Column) -> Column:
    return F.concat(prefix, number)


def normalize_course_key(c: Column) -> Column:
    """Text before the first bracket: its first two words joined, its one word, or empty."""
    words = F.split(F.trim(F.split_part(c, F.lit("("), F.lit(1))), r"\s+")
    return F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit("")))


def split_ids(c: Column) -> Column:
    """Trimmed items of a list written with semicolons, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def degree_id(degree_type: Column, name: Column) -> Column:
    return F.concat_ws(" ", degree_type, name)


def is_quarter(system_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(system_type, F.lit(""))), F.lit("quarter"))


def scale_of(quarter: Column) -> Column:
    """Complexity counts two thirds in a quarter system."""
    return F.when(quarter, F.lit(2.0) / 3.0).otherwise(F.lit(1.0))


def scaled(complexity: Column, quarter: Column) -> Column:
    """Scaled complexity of a course, rounded half up to a tenth before any sum."""
    return F.round(complexity * scale_of(quarter), 1)


def csv_order(course_id: Column) -> Column:
    """Sort value of a course id: an unsigned number, else 0."""
    return F.coalesce(F.when(course_id.rlike(r"^\+?[0-9]+$"), course_id.try_cast("bigint")), F.lit(0))


def number_text(c: Column) -> Column:
    """A whole number without, another with its fraction."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def complexity_band(complexity: Column) -> Column:
    return F.when(complexity <= 5, "low").when(complexity <= 15, "medium").otherwise("high")


def short_name(name: Column) -> Column:
    """A name over 20 characters keeps 17 and an ellipsis."""
    return F.when(F.length(name) > 20, F.concat(F.substring(name, 1, 17), F.lit("..."))).otherwise(name)


def node_label(key: Column, name: Column, complexity: Column) -> Column:
    return F.concat_ws("<br/>", key, short_name(name), F.concat(F.lit("C:"), complexity.cast("string")))


def node_id(key: Column) -> Column:
    """Every character that is no letter or digit becomes a low line."""
    return F.regexp_replace(key, r"(?U)[^\p{IsAlphabetic}\p{N}]", "_")


def step_members(step: Column) -> Column:
    """The courses of a path step: (A+B) or A."""
    return F.split(F.regexp_replace(step, r"^\(|\)$", ""), r"\+")


def years_of(terms: Column, quarter: Column) -> Column:
    return F.ceil(terms / F.when(quarter, 3).otherwise(2)).cast("bigint")
