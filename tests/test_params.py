"""Parameter rules (paging, optional dates, booleans, summary request)."""

import datetime as dt

import pytest

from tillbook.params import DateRange, Page, SummaryParams, TagFilter, parse_date_strict


@pytest.mark.parametrize("limit,offset,expect", [
    ("50", "10", (50, 10)),
    (None, None, (100, 0)),
    ("-5", "-3", (100, 0)),
    ("110", "110", (100, 110)),
    ("101", "-1", (100, 0)),
    ("null", "null", (100, 0)),
    ("0", "0", (0, 0)),
    ("+7", "2", (7, 2)),
    ("99999999999", "1", (100, 1)),
])
def test_page_rules(limit, offset, expect):
    p = Page.parse(limit, offset)
    assert (p.limit, p.offset) == expect


@pytest.mark.parametrize("text", ["2025-04-31", "2025-13-01", "2025-12-32", "2025/04/01", "2025-4-1", None, "20250401"])
def test_strict_date_rejects(text):
    with pytest.raises((ValueError, TypeError)):
        parse_date_strict(text)


def test_optional_dates_become_no_bound():
    assert DateRange.parse("2025/03/01", "2025-04-32") == DateRange(None, None)
    assert DateRange.parse("2025-03-01", None) == DateRange(dt.date(2025, 3, 1), None)


@pytest.mark.parametrize("value,expect", [("true", True), ("false", False), ("invalid", None), (None, None), ("1", None)])
def test_important_flag(value, expect):
    assert TagFilter.parse(value).important is expect


def test_summary_request():
    ok = SummaryParams.parse({"startDate": "2025-01-01", "endDate": "2025-01-31", "excludeCategoryIds": []})
    assert ok.exclude_category_ids == ()
    for ids in ([1, 0, 3], [1, -5, 3]):
        with pytest.raises(ValueError):
            SummaryParams.parse({"startDate": "2025-01-01", "endDate": "2025-01-31", "excludeCategoryIds": ids})
    with pytest.raises(ValueError):
        SummaryParams.parse({"startDate": "2025-01-01", "excludeCategoryIds": []})
    with pytest.raises(ValueError):
        SummaryParams.parse({"startDate": "2025-04-32", "endDate": "2025-05-01", "excludeCategoryIds": []})
