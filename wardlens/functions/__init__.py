from wardlens.functions.columns import (
    in_range,
    in_set,
    percent_text,
    period_label,
    period_start,
    sir_value,
    total,
)

__all__ = [
    "in_range",
    "in_set",
    "percent_text",
    "period_label",
    "period_start",
    "sir_value",
    "total",
]
