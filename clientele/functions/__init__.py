"""Column helpers shared by the operators."""

from clientele.functions.numeric import clamp, half_even, stable_sum
from clientele.functions.text import (
    discount_code,
    first_word,
    fixed_text,
    literal_map,
    money_text,
    percent_text,
    short_money,
    strip_text,
    whole_text,
)
from clientele.functions.time import as_timestamp, days_before, hours_before, whole_days

__all__ = [
    "as_timestamp", "clamp", "days_before", "discount_code", "first_word", "fixed_text",
    "half_even", "hours_before", "literal_map", "money_text", "percent_text", "short_money",
    "stable_sum", "strip_text", "whole_days", "whole_text",
]
