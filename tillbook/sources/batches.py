"""JSON request sources: expense batches, income batches, transfer and summary requests.

A request document is one JSON text. It becomes a VARIANT in one parse: as the
first of two elements of an array whose second is a hash of the text, so that
text after the document, which would have to close the array with its own
hash, is seen in the same parse. Batches (``{"expenses": [...]}``,
``{"incomes": [...]}``) are cut into one row per element, still as VARIANT,
and every field is taken from there with its type checked. Nothing is
inferred; schemas are declared in ``tillbook.schemas``.

Only documents that this parse refuses are looked at again: a VARIANT can't
repeat a key, but one element that does so must not hide its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook import schemas

#: VARIANT types that a JSON integer and a list of them have.
INTEGER = "BIGINT"
INTEGERS = ("ARRAY<BIGINT>", "ARRAY<VOID>")
ABSENT = "VOID"
INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def _in_array(value, schema: str):
    """The struct ``value`` holds, or NULL unless it is one element of an array."""
    found = F.from_json(F.concat(F.lit("["), value, F.lit("]")), f"ARRAY<{schema}>")
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def _in_object(value, schema: str):
    """The struct ``value`` holds, or NULL unless it is one field of an object."""
    return F.from_json(F.concat(F.lit('{"d":'), value, F.lit("}")), f"d {schema}")["d"]


def _with_document(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` plus the VARIANT of the text, NULL if it is broken, repeats a key or has text after it."""
    mark, both = F.xxhash64(value), F.col("_both")
    rows = rows.withColumn("_both", F.try_parse_json(F.concat(F.lit("["), F.col(value), F.lit(","), mark.cast("string"), F.lit("]"))))
    alone = F.try_variant_get(both, "$[1]", "bigint").eqNullSafe(mark) & F.try_variant_get(both, "$[2]", "variant").isNull()
    return rows.withColumn(name, F.when(alone, F.try_variant_get(both, "$[0]", "variant"))).drop("_both")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<x:variant>").isNotNull()


def _typed(rows: DataFrame, v: str, schema: T.StructType, readable: Column, wrong: Column | None = None) -> DataFrame:
    """``rows`` plus ``e``: the fields of the VARIANT ``v`` by ``schema`` (NULL
    where the type is another one), ``_readable`` (as given), ``_corrupt``
    (a number field of another type, or ``wrong``) and ``_mistyped`` (that, or
    any field of another type). Integers must be whole, unquoted and fit 32 bits."""
    names = [f.name for f in schema.fields]
    kinds, values = {n: F.col(f"_k_{n}") for n in names}, {n: F.col(f"_v_{n}") for n in names}
    at = lambda n, kind: F.try_variant_get(F.col(v), f"$.{n}", kind)
    rows = rows.withColumns({f"_k_{n}": F.schema_of_variant(at(n, "variant")) for n in names})
    taken, number = {}, []
    for f in schema.fields:
        kind = kinds[f.name]
        if isinstance(f.dataType, T.StringType):
            value = F.when(kind == "STRING", at(f.name, "string"))
        elif isinstance(f.dataType, T.ArrayType):
            fits = F.forall(at(f.name, "array<bigint>"), lambda x: x.isNull() | x.between(INT_MIN, INT_MAX))
            value = F.when(kind.isin(*INTEGERS) & fits, at(f.name, "array<int>"))
        else:
            value = F.when(kind == INTEGER, at(f.name, "int"))
        taken[f"_v_{f.name}"] = value
        number.append(not isinstance(f.dataType, T.StringType))
    rows = rows.withColumns(taken)
    bad = lambda n: F.coalesce((kinds[n] != ABSENT) & values[n].isNull(), F.lit(False))
    some = lambda which: F.array_contains(F.array(F.lit(False), *[bad(n) for n in which]), True)
    corrupt = some([n for n, x in zip(names, number) if x]) | ~readable
    if wrong is not None:
        corrupt = corrupt | wrong
    rows = rows.withColumn("_corrupt", corrupt)
    e = F.struct(*[values[n].alias(n) for n in names], readable.alias("_readable"), F.col("_corrupt"),
                 (F.col("_corrupt") | some([n for n, x in zip(names, number) if not x])).alias("_mistyped"))
    return rows.withColumn("e", e).drop(*[c for n in names for c in (f"_k_{n}", f"_v_{n}")], "_corrupt")


def parse_requests(rows: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """(key, value) -> key, e: requests that are one JSON object each. With
    text after it a request is corrupt, though its fields are still read."""
    rows = _with_document(rows.select(key, "value"), "value", "_doc")
    # lazily: only a refused text is parsed again, up to the end of its first value
    rows = rows.withColumn("_v", F.coalesce(F.col("_doc"), F.try_parse_json("value")))
    return _typed(rows, "_v", schema, F.coalesce(_is_object(F.col("_v")), F.lit(False)), F.col("_doc").isNull()).select(key, "e")


def read_documents(spark: SparkSession, path: str, key: str = "batch_id") -> DataFrame:
    """JSON Lines files -> (key, value): one request document per line.
    ``key`` (``batch_id`` for expense / income batches, ``request_id`` for
    transfer requests) is the row's ``monotonically_increasing_id`` straight
    after the file scan, which is stable for a given set of input files
    (file splits are deterministic)."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias(key), "value")


def explode_batches(docs: DataFrame, array_key: str, element_schema: T.StructType) -> DataFrame:
    """(batch_id, value) -> batch_id, doc_ok, pos, e (fields by ``element_schema``, see ``_typed``).

    One row per element. A document that is not a JSON object holding an
    ``array_key`` array of objects, names a key twice or is followed by more
    text yields a single marker row (doc_ok false, pos NULL), so the whole
    batch can be rejected; an empty array yields no row. An element that
    repeats a key is not readable, its neighbours are.
    """
    value = F.col("value")
    rows = _with_document(docs.select("batch_id", "value"), "value", "_doc")
    # for refused documents only: elements as texts, each parsed by itself
    keys = F.json_object_keys("value")
    texts = _in_array(value, f"STRUCT<`{array_key}` ARRAY<STRING>>")[array_key]
    objects = _in_object(value, f"STRUCT<`{array_key}` ARRAY<STRUCT<`{element_schema.fields[0].name}` STRING>>>")[array_key]
    whole = objects.isNotNull() & (F.size(keys) == F.size(F.array_distinct(keys)))
    again = F.when(F.col("_doc").isNull() & whole, F.transform(texts, F.try_parse_json))
    listed = F.try_variant_get(F.col("_doc"), f"$.{array_key}", "array<variant>")
    rows = rows.select("batch_id", F.when(F.col("_doc").isNotNull(), listed).otherwise(again).alias("items"),
                       F.col("_doc").isNull().alias("_again"))
    good = F.col("_again") | F.forall("items", _is_object)
    rows = rows.select("batch_id", F.when(good, F.col("items")).alias("items"))
    rows = rows.select("batch_id", F.col("items").isNotNull().alias("doc_ok"), F.posexplode_outer("items").alias("pos", "_v"))
    rows = rows.filter(~F.col("doc_ok") | F.col("pos").isNotNull())
    return _typed(rows, "_v", element_schema, F.col("_v").isNotNull()).select("batch_id", "doc_ok", "pos", "e")  # elements are objects, or NULL


def expense_elements(docs: DataFrame):
    return explode_batches(docs, "expenses", schemas.EXPENSE_ELEMENT)


def income_elements(docs: DataFrame):
    return explode_batches(docs, "incomes", schemas.INCOME_ELEMENT)


def transfer_requests(docs: DataFrame) -> DataFrame:
    """(request_id, value) -> request_id, e (transfer request)."""
    return parse_requests(docs, "request_id", schemas.TRANSFER_REQUEST)


def summary_requests(docs: DataFrame) -> DataFrame:
    """(request_id, value) -> request_id, e (summary request)."""
    return parse_requests(docs, "request_id", schemas.SUMMARY_REQUEST)
