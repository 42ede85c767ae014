"""Column expressions, all built from ``pyspark.sql.functions`` (JVM-side)."""

from cartlens.functions.strings import (
    jvm_split,
    jvm_string_hash,
    jvm_trim,
    parse_basket_line,
    items_to_text,
)
from cartlens.functions.metrics import f1_from_means, safe_ratio

__all__ = [
    "jvm_trim",
    "jvm_split",
    "jvm_string_hash",
    "parse_basket_line",
    "items_to_text",
    "safe_ratio",
    "f1_from_means",
]
