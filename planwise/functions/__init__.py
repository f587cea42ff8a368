from planwise.functions.exprs import (
    any_missing,
    format_value,
    guard,
    missing_label,
    sort_key,
    time_bucket,
    week_label,
)

__all__ = ["any_missing", "format_value", "guard", "missing_label", "sort_key", "time_bucket", "week_label"]
