"""Field and record rules as column expressions.

Each rule yields a reason code (string) or NULL; a record's reasons are the
non-NULL codes in a fixed order. Codes ending in a conflict class
(``:duplicate``, ``:unknown``, ``:same_wallet``) are conflicts; every other
code marks the record invalid. Invalid is decided before conflict.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.params import MAX_PAGE_LIMIT

# The strict date layout and the accepted priority levels.
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
PRIORITY_MIN, PRIORITY_MAX = 0, 2
CONFLICT_SUFFIXES = (":duplicate", ":unknown", ":same_wallet")


def strict_date(text: Column) -> Column:
    """'YYYY-MM-DD' text -> DATE, NULL unless it is a real calendar date."""
    return F.when(text.rlike(DATE_PATTERN), F.try_to_date(text, "yyyy-MM-dd"))


def int_text(text: Column) -> Column:
    """V-INT-STR: text -> 32-bit int, NULL if it is none or out of range."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("int"))


def page_limit(text: Column) -> Column:
    """A page's limit: the most, unless the text is a number from 0 to it."""
    n = int_text(text)
    return F.when(n.between(0, MAX_PAGE_LIMIT), n).otherwise(F.lit(MAX_PAGE_LIMIT))


def page_offset(text: Column) -> Column:
    return F.greatest(F.coalesce(int_text(text), F.lit(0)), F.lit(0))


def bool_text(text: Column) -> Column:
    """V-BOOL: ``true`` or ``false``, NULL (no filter) for anything else."""
    return F.when(text.isin("true", "false"), text == "true")


def missing(field: str, value: Column, corrupt: Column) -> Column:
    """Required field absent (and not already reported as mistyped)."""
    return F.when(value.isNull() & ~corrupt, F.lit(f"{field}:missing"))


def non_negative(field: str, value: Column) -> Column:
    return F.when(value < 0, F.lit(f"{field}:negative"))


def positive(field: str, value: Column) -> Column:
    return F.when(value < 1, F.lit(f"{field}:not_positive"))


def priority_range(field: str, value: Column) -> Column:
    return F.when(~value.between(PRIORITY_MIN, PRIORITY_MAX), F.lit(f"{field}:range"))


def date_rule(field: str, text: Column) -> Column:
    """Required date: missing, or present but not a calendar date."""
    return F.when(strict_date(text).isNull(), F.lit(f"{field}:invalid"))


def positive_vector(field: str, values: Column) -> Column:
    """Every element >= 1 (an empty list is fine); NULL elements fail."""
    return F.when(values.isNotNull() & ~F.coalesce(F.forall(values, lambda x: x >= 1), F.lit(False)),
                  F.lit(f"{field}:not_positive"))


def distinct_vector(field: str, values: Column) -> Column:
    return F.when(F.size(values) != F.size(F.array_distinct(values)), F.lit(f"{field}:duplicate"))


def json_type(mistyped: Column) -> Column:
    """A field of another type (fraction, over-range or quoted number, a string
    field that holds none), text after the request, or no object at all."""
    return F.when(mistyped, F.lit("json:type"))


def reasons(readable: Column, mistyped: Column, *codes: Column) -> Column:
    """Codes that hold; a record that can't be read has its type code alone."""
    found = F.filter(F.array(json_type(mistyped), *codes), lambda x: x.isNotNull())
    return F.when(readable, found).otherwise(F.array(F.lit("json:type")))


def status(reason_list: Column) -> Column:
    def is_conflict(x):
        cond = F.lit(False)
        for suffix in CONFLICT_SUFFIXES:
            cond = cond | x.endswith(suffix)
        return cond

    return (F.when(F.size(reason_list) == 0, F.lit("ok"))
            .when(F.exists(reason_list, lambda x: ~is_conflict(x)), F.lit("invalid"))
            .otherwise(F.lit("conflict")))
