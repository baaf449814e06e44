"""tillbook: personal-finance ledger analytics on Spark DataFrames.

Tables (wallets, categories, tags, expenses, incomes, transfers) are typed
DataFrames; every listing, enriched view, summary, validation and change
set is a declarative DataFrame plan left to Catalyst and AQE.
"""

from tillbook.ledger import Ledger
from tillbook.params import DateRange, Page, SummaryParams, TagFilter

__all__ = ["Ledger", "DateRange", "Page", "SummaryParams", "TagFilter"]
