"""Tolerant date expressions: anything unreadable becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark.functions.text import bind, strip

# Month abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date of three number texts, null when any part is not a calendar value."""

    def number(part: Column) -> Column:
        return bind(strip(part), lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("int")))

    def date(parts: Column) -> Column:
        y, m, d = parts["y"], parts["m"], parts["d"]
        in_range = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31)
        return F.when(in_range, F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))

    return bind(F.struct(number(year).alias("y"), number(month).alias("m"), number(day).alias("d")), date)


def parse_partial_date(value: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` (further parts ignored) to a date."""
    one = F.lit("1")
    return bind(
        F.split(strip(value), "-"),
        lambda parts: date_from_parts(F.get(parts, 0), F.coalesce(F.get(parts, 1), one), F.coalesce(F.get(parts, 2), one)),
    )


def parse_registry_date(value: Column) -> Column:
    """Date of a VARIANT that is either a bare text or a ``{date: ...}`` object."""
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(
        kind.startswith("OBJECT"), F.try_variant_get(value, "$.date", "string")
    )
    return parse_partial_date(text)


def month_number(value: Column) -> Column:
    """Number clamped to 1..12, else month name by its first three letters, else 1."""
    text = strip(value)
    named = F.array_position(
        F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(text, 1, 3))
    ).cast("int")
    digits = F.coalesce(text.try_cast("int"), F.lit(12))  # longer than an int: clamps to 12
    return F.when(text.rlike("^[0-9]+$"), F.least(F.greatest(digits, F.lit(1)), F.lit(12))).otherwise(
        F.greatest(named, F.lit(1))
    )


def article_date(node: Column) -> Column:
    """(date, year) of one date node with Year, Month, Day and MedlineDate texts."""
    leading = F.regexp_extract(F.coalesce(node["medline_date"], F.lit("")), "^([0-9]{4})", 1)
    year = F.coalesce(F.nullif(node["year"], F.lit("")), F.nullif(leading, F.lit("")))
    month = month_number(F.coalesce(F.nullif(node["month"], F.lit("")), F.lit("1")))
    day = F.coalesce(F.nullif(node["day"], F.lit("")), F.lit("1"))
    return F.when(
        year.isNotNull(),
        F.struct(
            date_from_parts(year, month.cast("string"), day).alias("date"),
            strip(year).try_cast("int").alias("year"),
        ),
    )
