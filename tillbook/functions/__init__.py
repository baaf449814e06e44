"""Column-expression helpers (all built-in Spark functions, JVM side)."""

from tillbook.functions.nested import date_text, ordered_collect, to_json_text

__all__ = ["date_text", "ordered_collect", "to_json_text"]
