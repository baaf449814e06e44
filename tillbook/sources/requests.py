"""Request and change sets derived from the driver's tables.

These feed the registered validation / ingest / update / delete queries so
that their work grows with the data. Each derivation is deterministic and
plants rule violations at fixed residues of a key (a negative amount, an
impossible date, an unknown wallet ...), so every rule is exercised on the
whole table. Documents are rendered to JSON text, as a client would send them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.functions.nested import date_text
from tillbook.sources.fixtures import read_driver_table

# Ids that no wallet and no tag has at any scale.
UNKNOWN_WALLET = 26
UNKNOWN_TAG = 2_000_000_000
# Elements per request document.
EXPENSE_BATCH_SIZE = 20
INCOME_BATCH_SIZE = 20


def _hit(key, modulus: int, residue: int):
    return key % modulus == residue


def expense_request_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expense element per order: (batch_id, pos, element JSON text)."""
    o = read_driver_table(spark, sf_dir, "orders")
    li = read_driver_table(spark, sf_dir, "lineitem")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    batch = lambda key: (key / EXPENSE_BATCH_SIZE).cast("long").alias("batch_id")
    # tags per order: distinct (part + 1), ascending; [] when no lines. Lines and orders are dealt by
    # batch, which their documents are grouped by later, so no element is shuffled
    lines = li.filter(F.col("l_orderkey").isNotNull()).select(
        batch(F.col("l_orderkey")), F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") + 1).cast("int").alias("t"))
    tags = (lines.repartition("batch_id").groupBy("batch_id", "o_orderkey").agg(F.array_sort(F.collect_set("t")).alias("tags"))
            .groupBy("batch_id").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "tags"))).alias("tags")))
    base = F.floor("o_totalprice").cast("int")
    priority = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0)
                .when(F.col("o_orderpriority") == "3-MEDIUM", 1).otherwise(2))
    tag_ids = F.coalesce(F.col("tags")[k], F.array().cast("array<int>"))
    tag_ids = F.when(_hit(k, 401, 17) & (F.size(tag_ids) > 0), F.concat(tag_ids, F.slice(tag_ids, 1, 1))) \
        .otherwise(tag_ids)
    tag_ids = F.when(_hit(k, 457, 21), F.concat(tag_ids, F.array(F.lit(UNKNOWN_TAG)))).otherwise(tag_ids)
    fields = {
        "amount": F.when(_hit(k, 101, 3), -base).otherwise(base),
        "date": F.when(_hit(k, 211, 5), F.lit("1996-02-30")).otherwise(date_text(F.col("o_orderdate").cast("date"))),
        "description": F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("order "), F.col("o_orderstatus"))),
        "priority": F.when(_hit(k, 307, 7), F.lit(3)).otherwise(priority),
        "categoryId": F.when(_hit(k, 419, 13), F.lit(26)).otherwise(c % 25 + 1).cast("int"),
        "walletId": F.when(_hit(k, 431, 19), F.lit(UNKNOWN_WALLET)).otherwise(c % 25 + 1).cast("int"),
        "tagIds": tag_ids,
    }
    normal = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    # mistyped variants: amount sent as a JSON string, description as a number
    quoted_amount = F.to_json(F.struct(*[(v.cast("string") if n == "amount" else v).alias(n) for n, v in fields.items()]))
    numeric_desc = F.to_json(F.struct(*[(k.cast("int") if n == "description" else v).alias(n) for n, v in fields.items()]))
    element = (F.when(_hit(k, 509, 8), quoted_amount).when(_hit(k, 613, 9), numeric_desc).otherwise(normal))
    return (o.withColumn("batch_id", batch(k)).join(tags, "batch_id", "left")
            .select("batch_id", (k % EXPENSE_BATCH_SIZE).cast("int").alias("pos"), element.alias("element")))


def _documents(elements: DataFrame, key: str) -> DataFrame:
    """Group elements into request documents; a group holds at most one
    batch (<= batch size elements), so collect_list is bounded."""
    docs = elements.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "element"))).alias("items"))
    body = F.concat(F.lit(f'{{"{key}":['), F.array_join(F.transform("items", lambda x: x["element"]), ","), F.lit("]}"))
    # every 97th document is malformed as a whole: no array, strings for objects, text after it, a key twice
    quoted = F.concat(F.lit(f'{{"{key}":["'), F.array_join(F.transform("items", lambda x: F.replace(
        F.replace(x["element"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))), '","'), F.lit('"]}'))
    fault = F.col("batch_id") % 4
    bad = (F.when(fault == 0, F.lit(f'{{"{key}":"not a list"}}')).when(fault == 1, quoted)
           .when(fault == 2, F.concat(body, F.lit("]"))).otherwise(F.concat(F.lit(f'{{"{key}":[],'), F.substring(body, F.lit(2), F.length(body)))))
    return docs.select("batch_id", F.when(F.col("batch_id") % 97 == 42, bad).otherwise(body).alias("value"))


def expense_request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, value): ``{"expenses":[...]}`` documents."""
    return _documents(expense_request_elements(spark, sf_dir), "expenses")


def income_request_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_driver_table(spark, sf_dir, "events")
    k = F.col("event_id")
    date = F.date_add(F.lit("1995-01-01").cast("date"), (k % 2400).cast("int"))
    fields = {
        "amount": F.ceil("value").cast("int"),
        "date": F.when(_hit(k, 223, 11), F.lit("1996-13-01")).otherwise(date_text(date)),
        "description": F.col("event_type"),
        "walletId": F.when(_hit(k, 229, 3), F.lit(UNKNOWN_WALLET)).otherwise(F.col("user_id") % 25 + 1).cast("int"),
    }
    element = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    return ev.select((k / INCOME_BATCH_SIZE).cast("long").alias("batch_id"),
                     (k % INCOME_BATCH_SIZE).cast("int").alias("pos"), element.alias("element"))


def income_request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(income_request_elements(spark, sf_dir), "incomes")


def transfer_request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, value): one JSON transfer request per customer row
    (FIXTURES.md transfer_request); a NULL description is left out."""
    from tillbook.sources.fixtures import transfer_request

    t = transfer_request(spark, sf_dir)
    doc = F.to_json(F.struct(
        F.col("source_wallet_id").alias("sourceWalletId"), F.col("target_wallet_id").alias("targetWalletId"),
        "amount", "fee", date_text("date").alias("date"), "description"))
    # some have text after the document
    return t.select("request_id", F.when(_hit(F.col("request_id"), 113, 6), F.concat(doc, F.lit(" {}"))).otherwise(doc).alias("value"))


def expense_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expense change set (one per customer): id, element JSON text.
    Ids past the last expense are unknown; some descriptions are cleared."""
    cu = read_driver_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    fields = {
        "amount": F.floor("c_acctbal").cast("int"),
        "date": date_text(F.date_add(F.lit("1995-01-01").cast("date"), (k % 2400).cast("int"))),
        "description": F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")),
        "priority": (k % 3).cast("int"),
        "categoryId": (F.col("c_nationkey") % 24 + 1).cast("int"),
        "walletId": (k % 25 + 1).cast("int"),
        "tagIds": F.array((k + 1).cast("int"), F.when(k % 20 == 0, k + 1).otherwise(F.floor(k / 2) + 1).cast("int")),
    }
    element = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    return cu.select((k * 11 + 1).cast("int").alias("id"), element.alias("value"))


def income_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read_driver_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    fields = {
        "amount": F.floor("c_acctbal").cast("int"),
        "date": date_text(F.date_add(F.lit("1995-01-01").cast("date"), (k % 2400).cast("int"))),
        "description": F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")),
        "walletId": (k % 25 + 1).cast("int"),
    }
    element = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    return cu.select((k * 7 + 1).cast("int").alias("id"), element.alias("value"))


def expense_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read_driver_table(spark, sf_dir, "customer")
    return cu.select((F.col("c_custkey") * 13 + 2).cast("int").alias("id"))


def income_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read_driver_table(spark, sf_dir, "customer")
    return cu.select((F.col("c_custkey") * 9 + 4).cast("int").alias("id"))


def summary_request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, value): one JSON summary request per customer. Ranges reach
    beyond the ledger on both sides, some end before they start, some exclude
    one category twice; impossible dates, ids under 1, a missing list and text
    after the document are planted."""
    cu = read_driver_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    start = F.date_add(F.lit("1994-06-01").cast("date"), (k * 37 % 2900).cast("int"))
    end = F.date_add(start, (k * 11 % 1300 - 40).cast("int"))
    ids = F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 24 + 1, k * 5 % 24 + 1, k * 5 % 24 + 1))
    fields = {
        "startDate": F.when(_hit(k, 127, 9), F.lit("1996-02-30")).otherwise(date_text(start)),
        "endDate": date_text(end),
        "excludeCategoryIds": F.when(_hit(k, 131, 12), F.lit(None)).when(_hit(k, 137, 20), F.array(F.lit(0).cast("bigint"))).otherwise(ids),
    }
    doc = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    return cu.select((k + 1).cast("int").alias("request_id"), F.when(_hit(k, 139, 30), F.concat(doc, F.lit("]"))).otherwise(doc).alias("value"))


def parameter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, limit, offset, from, important): raw texts of listing
    parameters, one row per customer; numbers with signs, out of range or
    broken, dates in other layouts or that don't exist, words for booleans."""
    cu = read_driver_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    t = k.cast("string")

    def pick(*texts):
        """One of the texts by the key's residue."""
        out = F.lit(None).cast("string")
        for i, x in enumerate(texts):
            out = F.when(k % len(texts) == i, x).otherwise(out)
        return out

    lit = F.lit
    day = F.date_add(lit("1995-01-01").cast("date"), (k % 2400).cast("int"))
    limit = pick(t, lit(None).cast("string"), lit("-5"), lit("101"), lit("100"), lit("0"), lit("+7"), lit("null"), lit(""), lit("99999999999"), lit(" 5"),
                 lit("5.0"), lit("1e1"), lit("5\n"))
    offset = pick(t, F.concat(lit("-"), t), lit("+12"), lit("2147483647"), lit("2147483648"), lit(None).cast("string"), lit("ten"), lit("--1"), lit("007"))
    first = pick(date_text(day), F.date_format(day, "yyyy/MM/dd"), F.date_format(day, "yyyyMMdd"), lit("1996-02-30"), lit("1996-02-29"), lit("1996-2-9"),
                 lit(None).cast("string"), lit("0001-01-01"), lit("1996-13-01"), lit("1996-02-29 "), lit("today"))
    important = pick(lit("true"), lit("false"), lit("TRUE"), lit("1"), lit(""), lit(None).cast("string"), lit("yes"))
    return cu.select((k + 1).cast("int").alias("request_id"), limit.alias("limit"), offset.alias("offset"), first.alias("from"), important.alias("important"))
