"""Text helpers: numbers as text, stripping, literal lookups."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from clientele.functions.numeric import half_even


def whole_text(x: Column) -> Column:
    """A number without decimals, ties to even."""
    return half_even(x).cast("bigint").cast("string")


def percent_text(x: Column) -> Column:
    """A fraction as whole percent: 0.915 gives ``92%``."""
    return F.concat(whole_text(x * 100.0), F.lit("%"))


def fixed_text(x: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, ties to even (Java's formatter goes half up)."""
    return F.format_string(f"%.{digits}f", half_even(x, digits))


def money_text(x: Column) -> Column:
    """Whole dollars with thousands separators."""
    return F.concat(F.lit("$"), F.format_number(half_even(x), 0))


def short_money(x: Column) -> Column:
    """Dollars as a report shows them: $1.83M, $76.1K, $950."""
    return (
        F.when(x >= 1e6, F.concat(F.lit("$"), fixed_text(x / 1e6, 2), F.lit("M")))
        .when(x >= 1e3, F.concat(F.lit("$"), fixed_text(x / 1e3, 1), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), whole_text(x)))
    )


def strip_text(x: Column) -> Column:
    """Remove blank characters of any kind from both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def first_word(x: Column) -> Column:
    """First blank-separated word, null where there is none."""
    return F.nullif(F.regexp_extract(x, r"(\S+)", 1), F.lit(""))


def discount_code(pct: Column, customer_id: Column) -> Column:
    """Coupon text made of the percentage and the last four characters of the id."""
    return F.concat(F.lit("SAVE"), pct.cast("string"), F.lit("-"), F.upper(F.right(customer_id, F.lit(4))))


def literal_map(mapping: Mapping, key: Column) -> Column:
    """Look ``key`` up in a small constant map; null where it is missing."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)
