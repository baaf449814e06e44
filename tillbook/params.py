"""Query parameters and their lenient / strict parsing rules.

These run on the driver over a handful of request values (never over data):
they decide which predicates and page bounds the DataFrame plan gets.
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass

# Page size cap and the integer range of a 32-bit id/amount.
MAX_PAGE_LIMIT = 100
INT32_MIN, INT32_MAX = -(2**31), 2**31 - 1

_INT_TEXT = re.compile(r"[+-]?[0-9]+")
_DATE_TEXT = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def parse_int_text(value) -> int | None:
    """Text -> 32-bit int; anything unparsable or out of range -> None."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, int):
        return value if INT32_MIN <= value <= INT32_MAX else None
    text = str(value)
    if not _INT_TEXT.fullmatch(text):
        return None
    number = int(text)
    return number if INT32_MIN <= number <= INT32_MAX else None


def parse_date_strict(value) -> _dt.date:
    """Required ``YYYY-MM-DD`` calendar date; raises ValueError otherwise."""
    if isinstance(value, _dt.date):
        return value
    if not isinstance(value, str) or not _DATE_TEXT.fullmatch(value):
        raise ValueError(f"invalid date: {value!r}")
    year, month, day = (int(part) for part in value.split("-"))
    return _dt.date(year, month, day)


def parse_date_lenient(value) -> _dt.date | None:
    """Optional date: invalid or missing text means 'no bound'."""
    try:
        return parse_date_strict(value)
    except (ValueError, TypeError):
        return None


def parse_bool_lenient(value) -> bool | None:
    """``true``/``false`` (or a bool); anything else means 'no filter'."""
    if isinstance(value, bool):
        return value
    if value in ("true", "false"):
        return value == "true"
    return None


@dataclass(frozen=True)
class Page:
    """Page bounds. Limit defaults to 100 and is reset to 100 outside 0..100;
    offset defaults to 0 and negative offsets become 0."""

    limit: int = MAX_PAGE_LIMIT
    offset: int = 0

    def __post_init__(self):
        if not 0 <= self.limit <= MAX_PAGE_LIMIT or self.offset < 0:
            raise ValueError(f"a page has 0 to {MAX_PAGE_LIMIT} rows from offset 0 on")

    @classmethod
    def parse(cls, limit=None, offset=None) -> "Page":
        raw_limit = parse_int_text(limit)
        raw_offset = parse_int_text(offset)
        lim = MAX_PAGE_LIMIT if raw_limit is None else raw_limit
        if lim < 0 or lim > MAX_PAGE_LIMIT:
            lim = MAX_PAGE_LIMIT
        off = 0 if raw_offset is None or raw_offset < 0 else raw_offset
        return cls(lim, off)


@dataclass(frozen=True)
class DateRange:
    """Inclusive optional bounds; ``None`` means unbounded on that side."""

    start: _dt.date | None = None
    end: _dt.date | None = None

    @classmethod
    def parse(cls, start=None, end=None) -> "DateRange":
        return cls(parse_date_lenient(start), parse_date_lenient(end))


@dataclass(frozen=True)
class TagFilter:
    important: bool | None = None

    @classmethod
    def parse(cls, important=None) -> "TagFilter":
        return cls(parse_bool_lenient(important))


@dataclass(frozen=True)
class SummaryParams:
    """Inclusive date range plus category ids whose expenses are left out.

    ``start > end`` is accepted and simply selects nothing.
    """

    start: _dt.date
    end: _dt.date
    exclude_category_ids: tuple[int, ...] = ()

    def __post_init__(self):
        ids = tuple(self.exclude_category_ids)
        if any(isinstance(i, bool) or not isinstance(i, int) or i < 1 for i in ids):
            raise ValueError("Value must be positive")
        object.__setattr__(self, "exclude_category_ids", ids)

    @classmethod
    def parse(cls, doc: dict) -> "SummaryParams":
        """Strict request decoding: both dates and the id list are required."""
        for key in ("startDate", "endDate", "excludeCategoryIds"):
            if key not in doc or doc[key] is None:
                raise ValueError(f"missing field `{key}`")
        ids = doc["excludeCategoryIds"]
        if not isinstance(ids, list):
            raise ValueError("excludeCategoryIds must be a list")
        for value in ids:
            if parse_int_text(value) is None or isinstance(value, str):
                raise ValueError("excludeCategoryIds must hold 32-bit integers")
        return cls(parse_date_strict(doc["startDate"]), parse_date_strict(doc["endDate"]), tuple(ids))
