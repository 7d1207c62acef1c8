"""Column expressions: every function maps columns to a column."""

from flowtide.functions.columns import (
    binary_target,
    class_code,
    class_name,
    decide,
    hash_key,
    hash_unit,
    inf_to_null,
    micros,
    normalize_label,
    parse_timestamp,
    predict_class,
    severity,
    tumbling_floor,
    zero_if_missing,
)

__all__ = [
    "binary_target", "class_code", "class_name", "decide", "hash_key", "hash_unit", "inf_to_null",
    "micros", "normalize_label", "parse_timestamp", "predict_class", "severity", "tumbling_floor",
    "zero_if_missing",
]
