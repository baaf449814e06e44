"""Declared schemas of the ledger tables and the JSON input documents.

The ledger has a fixed schema (eight tables); nothing is ever inferred.
"""

from pyspark.sql import types as T

INT = T.IntegerType()
STR = T.StringType()
TS = T.TimestampType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


WALLET = T.StructType([_f("id", INT, False), _f("name", STR, False)])
PARENT_CATEGORY = T.StructType([_f("id", INT, False), _f("name", STR, False)])
CATEGORY = T.StructType([_f("id", INT, False), _f("parent_category_id", INT, False), _f("name", STR, False)])
TAG = T.StructType([_f("id", INT, False), _f("name", STR, False), _f("is_important", T.BooleanType(), False)])
EXPENSE = T.StructType([
    _f("id", INT, False), _f("category_id", INT, False), _f("wallet_id", INT, False),
    _f("amount", INT, False), _f("date", T.DateType(), False), _f("priority", INT, False),
    _f("description", STR), _f("created_at", TS), _f("updated_at", TS),
])
EXPENSE_TAG = T.StructType([
    _f("expense_id", INT, False), _f("tag_id", INT, False), _f("created_at", TS), _f("updated_at", TS),
])
INCOME = T.StructType([
    _f("id", INT, False), _f("amount", INT, False), _f("wallet_id", INT, False),
    _f("date", T.DateType(), False), _f("description", STR), _f("created_at", TS), _f("updated_at", TS),
])
WALLET_TRANSFER = T.StructType([
    _f("id", INT, False), _f("amount", INT, False), _f("source_wallet_id", INT, False),
    _f("target_wallet_id", INT, False), _f("date", T.DateType(), False), _f("description", STR),
    _f("created_at", TS), _f("updated_at", TS),
])

TABLES = {
    "wallet": WALLET,
    "parent_category": PARENT_CATEGORY,
    "category": CATEGORY,
    "tag": TAG,
    "expense": EXPENSE,
    "expense_tag": EXPENSE_TAG,
    "income": INCOME,
    "wallet_transfer": WALLET_TRANSFER,
}
DIMENSIONS = ("wallet", "parent_category", "category", "tag")
FACTS = ("expense", "expense_tag", "income", "wallet_transfer")

# Input documents (camelCase keys, as sent by clients). Elements are parsed
# one by one so that a malformed element cannot hide its neighbours.
EXPENSE_ELEMENT = T.StructType([
    _f("amount", INT), _f("date", STR), _f("description", STR), _f("priority", INT),
    _f("categoryId", INT), _f("walletId", INT), _f("tagIds", T.ArrayType(INT)),
])
INCOME_ELEMENT = T.StructType([
    _f("amount", INT), _f("date", STR), _f("description", STR), _f("walletId", INT),
])
TRANSFER_REQUEST = T.StructType([
    _f("sourceWalletId", INT), _f("targetWalletId", INT), _f("amount", INT), _f("fee", INT),
    _f("date", STR), _f("description", STR),
])
SUMMARY_REQUEST = T.StructType([
    _f("startDate", STR), _f("endDate", STR), _f("excludeCategoryIds", T.ArrayType(INT)),
])
