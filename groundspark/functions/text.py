"""Scalar text expressions: hashing, identifiers, sentences, citations, display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark import settings

# Patterns and delimiters that decide results.
CLOSE_TAG = "</retrieved_chunk>"
OPEN_TAG = "<retrieved_chunk"
ZERO_WIDTH_SPACE = chr(0x200B)
ELLIPSIS = chr(0x2026)
# Code points that count as blank when stripping or splitting.
BLANK_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
BLANKS = "".join(chr(point) for point in BLANK_POINTS)
BLANK_CLASS = f"[{BLANKS}]"
NCT_PATTERN = r"(?U)\bNCT\d{8}\b"
CITATION_GROUP = rf"\[([0-9]+(?:{BLANK_CLASS}*,{BLANK_CLASS}*[0-9]+)*)\]"
SENTENCE_END = rf"(?<=[.!?]){BLANK_CLASS}+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where lambdas use it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def canonical_json(value: Column) -> Column:
    """Compact, key-sorted, ASCII-only JSON text of a VARIANT value."""

    def escape(piece: Column) -> Column:
        point = F.ascii(piece)
        high = F.lit(0xD800) + F.shiftright(point - 0x10000, 10)
        low = F.lit(0xDC00) + point.bitwiseAND(0x3FF)
        unit = "\\u%04x"
        return (
            F.when(piece.rlike("^[ -~]"), piece)
            .when(point > 0xFFFF, F.format_string(unit + unit, high, low))
            .otherwise(F.format_string(unit, point))
        )

    def ascii_only(plain: Column) -> Column:
        pieces = F.regexp_extract_all(plain, F.lit("([^ -~]|[ -~]+)"), F.lit(1))
        return F.when(plain.rlike("[^ -~]"), F.array_join(F.transform(pieces, escape), "")).otherwise(plain)

    return bind(F.to_json(value), ascii_only)


def extract_nct_ids(text: Column) -> Column:
    """Registry numbers named in ``text``, first-seen order, without repeats."""
    found = F.regexp_extract_all(text, F.lit(NCT_PATTERN), F.lit(0))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def sanitize_chunk_text(text: Column) -> Column:
    """Make literal block delimiters inside evidence inert."""
    closed = F.replace(
        text, F.lit(CLOSE_TAG), F.lit(f"<{ZERO_WIDTH_SPACE}retrieved_chunk{ZERO_WIDTH_SPACE}>")
    )
    return F.replace(closed, F.lit(OPEN_TAG), F.lit(f"<{ZERO_WIDTH_SPACE}retrieved_chunk"))


def citation_indices(text: Column) -> Column:
    """Distinct cited numbers in first-seen order; leading zeros do not matter.

    A number too long for a bigint becomes -1, which no evidence block has.
    """
    groups = F.regexp_extract_all(text, F.lit(CITATION_GROUP), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    return F.array_distinct(
        F.transform(numbers, lambda n: F.coalesce(strip(n).try_cast("bigint"), F.lit(-1)))
    )


def split_sentences(text: Column) -> Column:
    pieces = F.transform(F.split(strip(text), SENTENCE_END), strip)
    return F.filter(pieces, lambda s: s != "")


def uncited_sentences(text: Column, min_length: int = settings.MIN_CITABLE_LENGTH) -> Column:
    return F.filter(
        split_sentences(text),
        lambda s: (F.char_length(s) >= min_length) & ~F.rlike(s, F.lit(CITATION_GROUP)),
    )


def source_label(source_type: Column, identifier: Column) -> Column:
    return F.when(source_type == "publication", F.concat(F.lit("PMID "), identifier)).otherwise(identifier)


def source_type_name(source_type: Column) -> Column:
    return F.when(source_type == "publication", "Publication").otherwise("Registered trial")


def fixed_point(value: Column, places: int) -> Column:
    """``value`` with so many decimals (at most 4), by its binary value and halves to even, as C's printf.

    Java's formatter rounds the shortest decimal that reads as the value, halves up. Values
    are cut in two parts whose products with 10^places are exact; those that are negative
    or of 2^17 and more keep Java's rounding.
    """
    scale, grid = float(10**places), float(1 << 26)
    high = F.floor(value * grid) / grid
    whole = F.floor(high * scale)
    over_half = (high * scale - whole - 0.5) + (value - high) * scale
    units = whole + F.when((over_half > 0) | ((over_half == 0) & (whole % 2 == 1)), 1).otherwise(0)
    base = F.lit(10**places)
    shown = F.concat(F.floor(units / base).cast("string"), F.lit("."), F.lpad((units % base).cast("string"), places, "0"))
    return F.when((value >= 0) & (value < 1 << 17), shown).otherwise(F.format_string(f"%.{places}f", value))


def format_score(score: Column) -> Column:
    return fixed_point(score, 4)


def truncate_excerpt(text: Column, max_length: int) -> Column:
    """Cut at the last blank before ``max_length`` and add an ellipsis."""

    def shorten(trimmed: Column) -> Column:
        cut = F.substring(trimmed, 1, max_length)
        tail = F.instr(F.reverse(cut), " ")  # 1-based distance of the last blank from the end
        kept = F.char_length(cut) - tail
        safe = F.when((tail > 0) & (kept > 0), F.substring(cut, F.lit(1), kept)).otherwise(cut)
        return F.when(F.char_length(trimmed) <= max_length, trimmed).otherwise(
            F.concat(F.rtrim(safe, F.lit(BLANKS)), F.lit(ELLIPSIS))
        )

    return bind(strip(text), shorten)


def answer_segments(text: Column) -> Column:
    """Ordered plain and marker pieces: array of (text, citation_indices or null)."""
    none = F.lit(None).cast("array<bigint>")
    markers = F.regexp_extract_all(text, F.lit(CITATION_GROUP), F.lit(0))

    def with_marker(plain: Column, marker: Column) -> Column:
        inner = F.substring(marker, F.lit(2), F.char_length(marker) - 2)
        numbers = F.transform(F.split(inner, ","), lambda n: strip(n).try_cast("bigint"))
        return F.array(
            F.struct(plain.alias("text"), none.alias("citation_indices")),
            F.struct(marker.alias("text"), numbers.alias("citation_indices")),
        )

    pieces = F.flatten(F.zip_with(F.split(text, CITATION_GROUP), markers, with_marker))
    return F.filter(pieces, lambda piece: F.coalesce(piece["text"], F.lit("")) != "")


def comparison_problem(first: Column, second: Column) -> Column:
    """Code of the first broken rule of a comparison request, null when fine."""
    a, b = strip(F.coalesce(first, F.lit(""))), strip(F.coalesce(second, F.lit("")))
    shape = r"(?i)^NCT[0-9]{8}$"
    return (
        F.when((a == "") | (b == ""), "missing_id")
        .when(~a.rlike(shape) | ~b.rlike(shape), "malformed_id")
        .when(F.upper(a) == F.upper(b), "same_trial")
    )
