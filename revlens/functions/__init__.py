"""Column expressions shared by the operators (all JVM-side built-ins)."""

from revlens.functions.text import trim_spaces, trim_lower, snake, replace_literal, varchar
from revlens.functions.dates import (parse_date, month_start, day_ceiling, as_timestamp_ntz)
from revlens.functions.numbers import to_money

__all__ = [
    "trim_spaces", "trim_lower", "snake", "replace_literal", "varchar",
    "parse_date", "month_start", "day_ceiling", "as_timestamp_ntz",
    "to_money",
]
