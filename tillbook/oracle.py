"""DuckDB oracle SQL for every registered query.

Each string starts with the fixture mapping of FIXTURES.md §4 as CTEs over the
driver's tables, then states the query the way the ledger's SQL states it
(CTE by CTE), independently of how the Spark side plans it. Sums are cast to
BIGINT, nested values are compared as JSON text.
"""

from __future__ import annotations

FIXTURE_CTES = """
parent_category AS (
  SELECT CAST(r_regionkey + 1 AS INT) AS id, r_name AS name FROM region
  UNION ALL SELECT 6 AS id, 'EMPTY' AS name
),
category AS (
  SELECT CAST(n_nationkey + 1 AS INT) AS id, CAST(n_regionkey + 1 AS INT) AS parent_category_id,
         CASE WHEN n_nationkey % 2 = 0 THEN CONCAT('nation_', CAST(n_nationkey % 20 AS STRING))
              ELSE CONCAT('NATION_', CAST(n_nationkey % 20 AS STRING)) END AS name
  FROM nation
),
wallet AS (
  SELECT CAST(n_nationkey + 1 AS INT) AS id, CASE WHEN n_nationkey >= 23 THEN 'Shared' ELSE n_name END AS name FROM nation
),
tag AS (
  SELECT CAST(p_partkey + 1 AS INT) AS id, p_name AS name, p_size > 25 AS is_important FROM part
),
expense AS (
  SELECT CAST(o_orderkey + 1 AS INT) AS id, CAST(o_custkey % 24 + 1 AS INT) AS category_id,
         CAST(o_custkey % 25 + 1 AS INT) AS wallet_id,
         CASE WHEN o_custkey % 24 = 14 THEN 0 ELSE CAST(FLOOR(o_totalprice) AS INT) END AS amount,
         CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 0 WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 2 END AS priority,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CONCAT('order ', o_orderstatus) END AS description
  FROM orders
),
expense_tag AS (
  SELECT DISTINCT CAST(l_orderkey + 1 AS INT) AS expense_id, CAST(l_partkey + 1 AS INT) AS tag_id FROM lineitem
),
income AS (
  SELECT CAST(event_id + 1 AS INT) AS id, CAST(GREATEST(CEIL(value), 1) AS INT) AS amount,
         CAST(user_id % 25 + 1 AS INT) AS wallet_id,
         DATE '1995-01-01' + CAST(event_id % 2400 AS INT) AS date, event_type AS description
  FROM events
),
transfer_request AS (
  SELECT CAST(c_custkey + 1 AS INT) AS request_id, CAST(c_custkey % 25 + 1 AS INT) AS source_wallet_id,
         CAST((c_custkey * 3 + 4) % 25 + 1 AS INT) AS target_wallet_id, CAST(FLOOR(c_acctbal) AS INT) AS amount,
         CAST(c_custkey % 4 AS INT) AS fee, DATE '1995-01-01' + CAST(c_custkey % 2400 AS INT) AS date,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS description
  FROM customer
)"""

# Standard summary parameters (FIXTURES.md): year 1996, categories 5 and 10 excluded.
YEAR_1996 = ("1996-01-01", "1996-12-31", "5, 10")
ALL_TIME = ("1900-01-01", "2100-12-31", "NULL")


def _summary_tables(first: str, last: str, excluded: str) -> str:
    """One aggregate for each (category, priority) and each (wallet, unit amount); every rollup is made from those."""
    return f""",
spent AS (
  SELECT category_id, priority, SUM(amount)::BIGINT AS total FROM expense
  WHERE date BETWEEN DATE '{first}' AND DATE '{last}' AND COALESCE(category_id NOT IN ({excluded}), TRUE)
    AND category_id IN (SELECT id FROM category)
  GROUP BY ALL
),
earned AS (
  SELECT wallet_id, amount AS unit, SUM(amount)::BIGINT AS total FROM income
  WHERE date BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY ALL
),
by_name AS (
  SELECT p.id AS parent_id, p.name AS parent, c.name, SUM(total)::BIGINT AS amount
  FROM category c, parent_category p, spent WHERE c.parent_category_id = p.id AND category_id = c.id GROUP BY ALL
),
by_parent AS (
  SELECT parent_id AS id, parent AS name, SUM(amount)::BIGINT AS amount,
         list({{'name': by_name.name, 'amount': by_name.amount}} ORDER BY amount DESC, by_name.name) AS categories
  FROM by_name WHERE amount > 0 GROUP BY ALL
),
by_level AS (SELECT priority AS level, SUM(total)::BIGINT AS amount FROM spent GROUP BY ALL),
by_wallet AS (SELECT id AS wallet_id, name, SUM(total)::BIGINT AS amount FROM wallet JOIN earned ON id = wallet_id GROUP BY ALL)"""


def _with(body: str, summary: tuple[str, str, str] | None = None) -> str:
    return "WITH " + FIXTURE_CTES + (_summary_tables(*summary) if summary else "") + "\n" + body


ORACLE: dict[str, str] = {}

ORACLE["sum_total"] = _with("""
SELECT COALESCE((SELECT SUM(total) FROM spent), 0)::BIGINT AS expense_amount,
       COALESCE((SELECT SUM(total) FROM earned), 0)::BIGINT AS income_amount
""", YEAR_1996)
ORACLE["sum_category"] = _with("SELECT parent_id, name, amount FROM by_name", YEAR_1996)
ORACLE["sum_parent"] = _with("SELECT id, name, amount, to_json(categories)::VARCHAR AS categories FROM by_parent", YEAR_1996)
ORACLE["sum_priority"] = _with("FROM by_level", YEAR_1996)
ORACLE["sum_wallet"] = _with("FROM by_wallet", YEAR_1996)
ORACLE["sum_wallet_compat"] = _with("""
SELECT name, SUM(total)::BIGINT AS amount FROM earned JOIN wallet ON wallet_id = id GROUP BY name, unit
""", YEAR_1996)

_DOCUMENT = """
SELECT
  to_json({'amount': (SELECT COALESCE(SUM(total), 0)::BIGINT FROM spent), 'groupSummary': {
    'parentCategories': (SELECT COALESCE(list({'name': name, 'amount': amount, 'categories': categories}
                                              ORDER BY amount DESC, name, id), []) FROM by_parent),
    'priorities': (SELECT COALESCE(list({'level': level, 'amount': amount} ORDER BY amount DESC, level), []) FROM by_level)
  }})::VARCHAR AS expense,
  to_json({'amount': (SELECT COALESCE(SUM(total), 0)::BIGINT FROM earned), 'groupSummary': {
    'wallets': (SELECT COALESCE(list({'name': name, 'amount': amount} ORDER BY amount DESC, name, wallet_id), []) FROM by_wallet)
  }})::VARCHAR AS income
"""
ORACLE["sum_doc"] = _with(_DOCUMENT, YEAR_1996)
ORACLE["sum_doc_all"] = _with(_DOCUMENT, ALL_TIME)

# ---- listings -------------------------------------------------------------

ORACLE["exp_index"] = _with("""
SELECT id, amount, strftime(date, '%Y-%m-%d') AS date, description FROM expense
WHERE date >= DATE '1995-01-01' AND date <= DATE '1996-12-31'
ORDER BY id LIMIT 100 OFFSET 20
""")

ORACLE["exp_index_deep"] = _with("""
SELECT id, amount, strftime(date, '%Y-%m-%d') AS date, description FROM expense
ORDER BY id LIMIT 100 OFFSET 10000
""")

ORACLE["exp_index_keyset"] = _with("""
SELECT id, amount, strftime(date, '%Y-%m-%d') AS date, description FROM expense
WHERE id > 7000 ORDER BY id LIMIT 100
""")

ORACLE["inc_index"] = _with("""
SELECT id, amount, strftime(date, '%Y-%m-%d') AS date, description FROM income
WHERE date >= DATE '1996-01-01'
ORDER BY id LIMIT 100 OFFSET 50
""")

ORACLE["cat_list"] = _with("""
SELECT id, name, pos FROM (
  SELECT id, name, ROW_NUMBER() OVER (ORDER BY LOWER(name), name, id) - 1 AS pos FROM category
) WHERE pos >= 5 AND pos < 15
""")

ORACLE["wallet_list"] = _with("""
SELECT id, name, pos FROM (
  SELECT id, name, ROW_NUMBER() OVER (ORDER BY LOWER(name), name, id) - 1 AS pos FROM wallet
) WHERE pos >= 3 AND pos < 8
""")

ORACLE["tag_list"] = _with("""
SELECT id, name, is_important, pos FROM (
  SELECT id, name, is_important,
         ROW_NUMBER() OVER (ORDER BY CASE WHEN is_important IS TRUE THEN 0 ELSE 1 END, LOWER(name), name, id) - 1 AS pos
  FROM tag
) WHERE pos >= 10 AND pos < 30
""")

ORACLE["tag_list_important"] = _with("""
SELECT id, name, is_important, pos FROM (
  SELECT id, name, is_important, ROW_NUMBER() OVER (ORDER BY LOWER(name), name, id) - 1 AS pos
  FROM tag WHERE is_important = TRUE
) WHERE pos < 100
""")

ORACLE["parent_tree"] = _with("""
SELECT pc.id, pc.name,
       COALESCE(CAST(to_json((SELECT list(struct_pack(id := c.id, name := c.name) ORDER BY LOWER(c.name), c.name, c.id)
                              FROM category c WHERE c.parent_category_id = pc.id)) AS VARCHAR), '[]') AS categories,
       pc.pos
FROM (SELECT id, name, ROW_NUMBER() OVER (ORDER BY name, id) - 1 AS pos FROM parent_category) pc
WHERE pc.pos >= 1 AND pc.pos < 5
""")

# the tag list of each expense first, then names looked up for every expense
_EXPENSE_DETAIL = """
SELECT x.id, x.amount, strftime(x.date, '%Y-%m-%d') AS date, x.description, x.priority,
       to_json({'id': x.category_id, 'name': (SELECT name FROM category WHERE id = x.category_id)})::VARCHAR AS category,
       to_json({'id': x.wallet_id, 'name': (SELECT name FROM wallet WHERE id = x.wallet_id)})::VARCHAR AS wallet,
       COALESCE(labels, '[]') AS tags
FROM expense x LEFT JOIN (
  SELECT expense_id, to_json(list({'id': tag.id, 'name': tag.name, 'isImportant': is_important}
                                  ORDER BY is_important DESC, tag.name, tag.id))::VARCHAR AS labels
  FROM expense_tag JOIN tag ON tag_id = tag.id GROUP BY expense_id
) ON expense_id = x.id
"""
ORACLE["exp_detail"] = _with(_EXPENSE_DETAIL)
ORACLE["exp_latest"] = _with(_EXPENSE_DETAIL + "WHERE x.id = (SELECT MAX(id) FROM expense)\n")

_INCOME_DETAIL = """
SELECT i.id, i.amount, strftime(i.date, '%Y-%m-%d') AS date, i.description,
       CAST(to_json(struct_pack(id := w.id, name := w.name)) AS VARCHAR) AS wallet
FROM income i JOIN wallet w ON i.wallet_id = w.id
"""
ORACLE["inc_detail"] = _with(_INCOME_DETAIL)
ORACLE["inc_latest"] = _with(_INCOME_DETAIL + "ORDER BY i.id DESC LIMIT 1\n")

# ---- validation, ingest, transfers, updates, deletes ----------------------
# The request sets are restated from their source columns (no JSON): which
# rows carry which defect follows the residues documented in
# tillbook/sources/requests.py.

REQUEST_CTES = """,
exp_tags AS (
  SELECT l_orderkey AS o_orderkey, list_sort(list(DISTINCT CAST(l_partkey + 1 AS INT))) AS tags
  FROM lineitem GROUP BY l_orderkey
),
exp_req0 AS (
  SELECT CAST(o.o_orderkey // 20 AS BIGINT) AS batch_id, CAST(o.o_orderkey % 20 AS INT) AS pos, o.o_orderkey AS k,
         CAST(FLOOR(o.o_totalprice) AS INT) * (CASE WHEN o.o_orderkey % 101 = 3 THEN -1 ELSE 1 END) AS amount0,
         CASE WHEN o.o_orderkey % 211 = 5 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS date,
         CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CONCAT('order ', o.o_orderstatus) END AS description0,
         CASE WHEN o.o_orderkey % 307 = 7 THEN 3
              WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 0 WHEN o.o_orderpriority = '3-MEDIUM' THEN 1 ELSE 2 END AS priority,
         CAST(CASE WHEN o.o_orderkey % 419 = 13 THEN 26 ELSE o.o_custkey % 25 + 1 END AS INT) AS category_id,
         CAST(CASE WHEN o.o_orderkey % 431 = 19 THEN 26 ELSE o.o_custkey % 25 + 1 END AS INT) AS wallet_id,
         COALESCE(t.tags, []::INT[]) AS tags0
  FROM orders o LEFT JOIN exp_tags t ON t.o_orderkey = o.o_orderkey
),
exp_req AS (
  SELECT batch_id, pos, k, date, priority, category_id, wallet_id,
         CASE WHEN k % 509 = 8 THEN NULL ELSE amount0 END AS amount,
         CASE WHEN k % 613 = 9 AND k % 509 <> 8 THEN CAST(CAST(k AS INT) AS VARCHAR) ELSE description0 END AS description,
         (k % 509 = 8 OR k % 613 = 9) AS type_err,
         CASE WHEN k % 457 = 21 THEN list_concat(t1, [2000000000]) ELSE t1 END AS tag_ids
  FROM (SELECT *, CASE WHEN k % 401 = 17 AND len(tags0) > 0 THEN list_concat(tags0, [tags0[1]]) ELSE tags0 END AS t1
        FROM exp_req0)
),
exp_chk0 AS (
  SELECT r.*, concat_ws(';',
      CASE WHEN type_err THEN 'json:type' END,
      CASE WHEN amount < 0 THEN 'amount:negative' END,
      CASE WHEN date IS NULL THEN 'date:invalid' END,
      CASE WHEN priority NOT BETWEEN 0 AND 2 THEN 'priority:range' END,
      CASE WHEN len(tag_ids) <> len(list_distinct(tag_ids)) THEN 'tagIds:duplicate' END,
      CASE WHEN category_id NOT IN (SELECT id FROM category) THEN 'categoryId:unknown' END,
      CASE WHEN wallet_id NOT IN (SELECT id FROM wallet) THEN 'walletId:unknown' END,
      CASE WHEN (SELECT count(*) FROM unnest(r.tag_ids) AS u(x) WHERE u.x NOT IN (SELECT id FROM tag)) > 0
           THEN 'tagIds:unknown' END
    ) AS reasons
  FROM exp_req r WHERE batch_id % 97 <> 42
),
exp_chk AS (
  SELECT *, CASE WHEN reasons = '' THEN 'ok'
                 WHEN replace(regexp_replace(reasons, '[A-Za-z]+:(duplicate|unknown|same_wallet)', '', 'g'), ';', '') <> ''
                 THEN 'invalid' ELSE 'conflict' END AS status
  FROM exp_chk0
),
exp_bad_batches AS (
  SELECT DISTINCT batch_id FROM exp_chk WHERE status <> 'ok'
  UNION SELECT DISTINCT batch_id FROM exp_req WHERE batch_id % 97 = 42
),
exp_validated AS (
  SELECT batch_id, pos, status, reasons, batch_id NOT IN (SELECT batch_id FROM exp_bad_batches) AS batch_ok,
         amount, date, description, priority, category_id, wallet_id, tag_ids
  FROM exp_chk
  UNION ALL
  SELECT DISTINCT batch_id, CAST(NULL AS INT), 'invalid', 'document:invalid', FALSE,
         NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM exp_req WHERE batch_id % 97 = 42
),
exp_inserted AS (
  SELECT CAST((SELECT MAX(id) FROM expense) + ROW_NUMBER() OVER (ORDER BY batch_id, pos) AS INT) AS id,
         category_id, wallet_id, amount, date, priority, description, tag_ids
  FROM exp_validated WHERE status = 'ok' AND batch_ok
),
inc_req AS (
  SELECT CAST(event_id // 20 AS BIGINT) AS batch_id, CAST(event_id % 20 AS INT) AS pos,
         CAST(CEIL(value) AS INT) AS amount,
         CASE WHEN event_id % 223 = 11 THEN NULL ELSE DATE '1995-01-01' + CAST(event_id % 2400 AS INT) END AS date,
         event_type AS description,
         CAST(CASE WHEN event_id % 229 = 3 THEN 26 ELSE user_id % 25 + 1 END AS INT) AS wallet_id
  FROM events
),
inc_chk AS (
  SELECT *, CASE WHEN reasons = '' THEN 'ok' WHEN reasons = 'walletId:unknown' THEN 'conflict' ELSE 'invalid' END AS status
  FROM (SELECT r.*, concat_ws(';',
      CASE WHEN amount IS NULL THEN 'amount:missing' END,
      CASE WHEN amount < 1 THEN 'amount:not_positive' END,
      CASE WHEN date IS NULL THEN 'date:invalid' END,
      CASE WHEN wallet_id NOT IN (SELECT id FROM wallet) THEN 'walletId:unknown' END) AS reasons
    FROM inc_req r WHERE batch_id % 97 <> 42)
),
inc_validated AS (
  SELECT batch_id, pos, status, reasons,
         batch_id NOT IN (SELECT batch_id FROM inc_chk WHERE status <> 'ok') AS batch_ok,
         amount, date, description, wallet_id
  FROM inc_chk
  UNION ALL
  SELECT DISTINCT batch_id, CAST(NULL AS INT), 'invalid', 'document:invalid', FALSE, NULL, NULL, NULL, NULL
  FROM inc_req WHERE batch_id % 97 = 42
),
tr_chk AS (
  SELECT *, CASE WHEN reasons = '' THEN 'ok'
                 WHEN replace(regexp_replace(reasons, '[A-Za-z]+:(duplicate|unknown|same_wallet)', '', 'g'), ';', '') <> ''
                 THEN 'invalid' ELSE 'conflict' END AS status
  FROM (SELECT t.*, concat_ws(';',
      CASE WHEN request_id % 113 = 6 THEN 'json:type' END,
      CASE WHEN source_wallet_id < 1 THEN 'sourceWalletId:not_positive' END,
      CASE WHEN target_wallet_id < 1 THEN 'targetWalletId:not_positive' END,
      CASE WHEN amount IS NULL THEN 'amount:missing' END,
      CASE WHEN amount < 0 THEN 'amount:negative' END,
      CASE WHEN fee < 0 THEN 'fee:negative' END,
      CASE WHEN source_wallet_id = target_wallet_id THEN 'wallet:same_wallet' END,
      CASE WHEN source_wallet_id NOT IN (SELECT id FROM wallet) THEN 'sourceWalletId:unknown' END,
      CASE WHEN target_wallet_id NOT IN (SELECT id FROM wallet) THEN 'targetWalletId:unknown' END,
      CASE WHEN fee > 0 AND 25 NOT IN (SELECT id FROM category) THEN 'feeCategory:unknown' END) AS reasons
    FROM transfer_request t)
),
exp_chg AS (
  SELECT CAST(c_custkey * 11 + 1 AS INT) AS id, CAST(FLOOR(c_acctbal) AS INT) AS amount,
         DATE '1995-01-01' + CAST(c_custkey % 2400 AS INT) AS date,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS description,
         CAST(c_custkey % 3 AS INT) AS priority, CAST(c_nationkey % 24 + 1 AS INT) AS category_id,
         CAST(c_custkey % 25 + 1 AS INT) AS wallet_id,
         [CAST(c_custkey + 1 AS INT), CAST(CASE WHEN c_custkey % 20 = 0 THEN c_custkey ELSE c_custkey // 2 END + 1 AS INT)] AS tag_ids
  FROM customer
),
exp_chg_out AS (
  SELECT *, CASE WHEN amount < 0 THEN 'invalid'
                 WHEN len(tag_ids) <> len(list_distinct(tag_ids)) THEN 'conflict'
                 WHEN id NOT IN (SELECT id FROM expense) THEN 'not_found' ELSE 'ok' END AS status
  FROM exp_chg
),
inc_chg AS (
  SELECT CAST(c_custkey * 7 + 1 AS INT) AS id, CAST(FLOOR(c_acctbal) AS INT) AS amount,
         DATE '1995-01-01' + CAST(c_custkey % 2400 AS INT) AS date,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS description,
         CAST(c_custkey % 25 + 1 AS INT) AS wallet_id
  FROM customer
),
inc_chg_out AS (
  SELECT *, CASE WHEN amount < 1 THEN 'invalid'
                 WHEN id NOT IN (SELECT id FROM income) THEN 'not_found' ELSE 'ok' END AS status
  FROM inc_chg
),
exp_del AS (SELECT CAST(c_custkey * 13 + 2 AS INT) AS id FROM customer),
inc_del AS (SELECT CAST(c_custkey * 9 + 4 AS INT) AS id FROM customer)"""


def _req(body: str) -> str:
    return "WITH " + FIXTURE_CTES + REQUEST_CTES + "\n" + body


ORACLE["validate_expenses"] = _req("SELECT batch_id, pos, status, reasons, batch_ok FROM exp_validated")
ORACLE["validate_incomes"] = _req("SELECT batch_id, pos, status, reasons, batch_ok FROM inc_validated")
ORACLE["validate_transfers"] = _req("SELECT request_id, status, reasons FROM tr_chk")
ORACLE["fk_check"] = _req("""
SELECT batch_id, pos, reason FROM (
  SELECT batch_id, pos, UNNEST(string_split(reasons, ';')) AS reason FROM exp_chk
) WHERE reason LIKE '%:unknown'
""")
ORACLE["exp_insert"] = _req("SELECT id, category_id, wallet_id, amount, date, priority, description FROM exp_inserted")
ORACLE["exp_insert_tags"] = _req("SELECT id AS expense_id, UNNEST(tag_ids) AS tag_id FROM exp_inserted")
ORACLE["inc_insert"] = _req("""
SELECT CAST((SELECT MAX(id) FROM income) + ROW_NUMBER() OVER (ORDER BY batch_id, pos) AS INT) AS id,
       amount, wallet_id, date, description
FROM inc_validated WHERE status = 'ok' AND batch_ok
""")
ORACLE["transfer_rows"] = _req("""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY request_id) AS INT) AS id, amount, source_wallet_id, target_wallet_id,
       date, description, request_id
FROM tr_chk WHERE status = 'ok'
""")
ORACLE["transfer_fees"] = _req("""
SELECT CAST((SELECT MAX(id) FROM expense) + ROW_NUMBER() OVER (ORDER BY request_id) AS INT) AS id,
       CAST(25 AS INT) AS category_id, source_wallet_id AS wallet_id, fee AS amount, date,
       CAST(2 AS INT) AS priority, 'Wallet transfer fee: ' || description AS description, request_id
FROM tr_chk WHERE status = 'ok' AND fee <> 0
""")
ORACLE["exp_update"] = _req("""
SELECT e.id,
       CASE WHEN a.id IS NULL THEN e.category_id ELSE a.category_id END AS category_id,
       CASE WHEN a.id IS NULL THEN e.wallet_id ELSE a.wallet_id END AS wallet_id,
       CASE WHEN a.id IS NULL THEN e.amount ELSE a.amount END AS amount,
       CASE WHEN a.id IS NULL THEN e.date ELSE a.date END AS date,
       CASE WHEN a.id IS NULL THEN e.priority ELSE a.priority END AS priority,
       CASE WHEN a.id IS NULL THEN e.description ELSE a.description END AS description
FROM expense e LEFT JOIN (SELECT * FROM exp_chg_out WHERE status = 'ok') a ON e.id = a.id
""")
ORACLE["exp_update_tags"] = _req("""
SELECT expense_id, tag_id FROM expense_tag
WHERE expense_id NOT IN (SELECT id FROM exp_chg_out WHERE status = 'ok')
UNION ALL
SELECT id AS expense_id, UNNEST(tag_ids) AS tag_id FROM exp_chg_out WHERE status = 'ok'
""")
ORACLE["exp_update_outcome"] = _req("SELECT id, status FROM exp_chg_out")
ORACLE["inc_update"] = _req("""
SELECT i.id,
       CASE WHEN a.id IS NULL THEN i.amount ELSE a.amount END AS amount,
       CASE WHEN a.id IS NULL THEN i.wallet_id ELSE a.wallet_id END AS wallet_id,
       CASE WHEN a.id IS NULL THEN i.date ELSE a.date END AS date,
       CASE WHEN a.id IS NULL THEN i.description ELSE a.description END AS description
FROM income i LEFT JOIN (SELECT * FROM inc_chg_out WHERE status = 'ok') a ON i.id = a.id
""")
ORACLE["inc_update_outcome"] = _req("SELECT id, status FROM inc_chg_out")
ORACLE["exp_delete"] = _req("""
SELECT id, category_id, wallet_id, amount, date, priority, description FROM expense
WHERE id NOT IN (SELECT id FROM exp_del)
""")
ORACLE["exp_delete_tags"] = _req("""
SELECT expense_id, tag_id FROM expense_tag WHERE expense_id NOT IN (SELECT id FROM exp_del)
""")
ORACLE["exp_delete_outcome"] = _req("""
SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM expense) THEN 'ok' ELSE 'not_found' END AS status FROM exp_del
""")
ORACLE["inc_delete"] = _req("""
SELECT id, amount, wallet_id, date, description FROM income WHERE id NOT IN (SELECT id FROM inc_del)
""")

ORACLE["inc_delete_outcome"] = _req("""
SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM income) THEN 'ok' ELSE 'not_found' END AS status FROM inc_del
""")

# ---- detail for given ids, quarantine, stamps, sinks ----------------------

ORACLE["exp_detail_ids"] = _with(_EXPENSE_DETAIL + "WHERE x.id IN (SELECT c_custkey * 13 + 2 FROM customer)\n")
ORACLE["inc_detail_ids"] = _with(_INCOME_DETAIL + "WHERE i.id IN (SELECT c_custkey * 9 + 4 FROM customer)\n")
ORACLE["validate_expenses_quarantine"] = _req("""
SELECT batch_id, pos, status, reasons, reasons <> 'document:invalid' AS batch_ok FROM exp_validated
""")
ORACLE["transfer_rows_again"] = _req("""
SELECT CAST(COUNT(*) OVER () + ROW_NUMBER() OVER (ORDER BY request_id) AS INT) AS id, amount, source_wallet_id, target_wallet_id,
       date, description, request_id
FROM tr_chk WHERE status = 'ok'
""")
ORACLE["exp_update_stamps"] = _req("""
SELECT id, TRUE AS created_kept, id IN (SELECT id FROM exp_chg_out WHERE status = 'ok') AS stamped FROM expense
""")
ORACLE["sink_append"] = _req("""
SELECT id, amount, wallet_id, date, description FROM income
UNION ALL
SELECT CAST((SELECT MAX(id) FROM income) + ROW_NUMBER() OVER (ORDER BY batch_id, pos) AS INT) AS id,
       amount, wallet_id, date, description
FROM inc_validated WHERE status = 'ok' AND batch_ok
""")
ORACLE["sink_snapshot"] = _req("""
SELECT e.id, coalesce(c.category_id, e.category_id) AS category_id, coalesce(c.wallet_id, e.wallet_id) AS wallet_id,
       coalesce(c.amount, e.amount) AS amount, coalesce(c.date, e.date) AS date, coalesce(c.priority, e.priority) AS priority,
       CASE WHEN c.id IS NULL THEN e.description ELSE c.description END AS description
FROM expense e LEFT JOIN (SELECT * FROM exp_chg_out WHERE status = 'ok') c USING (id) WHERE e.id NOT IN (SELECT id FROM exp_del)
""")
ORACLE["sink_snapshot_tags"] = _req("""
SELECT * FROM (
  SELECT expense_id, tag_id FROM expense_tag WHERE expense_id NOT IN (SELECT id FROM exp_chg_out WHERE status = 'ok')
  UNION ALL SELECT id, UNNEST(tag_ids) FROM exp_chg_out WHERE status = 'ok'
) WHERE expense_id NOT IN (SELECT id FROM exp_del)
""")
ORACLE["sink_doc"] = _with("""
SELECT '{"expense":' || expense || ',"income":' || income || '}' AS value FROM (""" + _DOCUMENT + ")\n", YEAR_1996)

# ---- chart feeds ----------------------------------------------------------

ORACLE["chart_bar"] = _with("""
SELECT 'parent_category' AS series, 'parent:' || CAST(id AS VARCHAR) AS key, name AS label, amount FROM by_parent
UNION ALL
SELECT 'priority', 'priority:' || CAST(level AS VARCHAR), CAST(level AS VARCHAR), amount FROM by_level
UNION ALL
SELECT 'wallet', 'wallet:' || CAST(wallet_id AS VARCHAR), name, amount FROM by_wallet
""", YEAR_1996)

ORACLE["chart_sunburst"] = _with("""
SELECT 1 AS level, 'parent:' || CAST(id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS parent_key, name, amount
FROM by_parent
UNION ALL
SELECT 2, 'category:' || CAST(parent_id AS VARCHAR) || ':' || name, 'parent:' || CAST(parent_id AS VARCHAR), name, amount
FROM by_name WHERE amount > 0
""", YEAR_1996)

ORACLE["chart_sankey"] = _with("""
SELECT 'wallet:' || CAST(wallet_id AS VARCHAR) AS source, 'income' AS target, name AS source_label,
       'Income' AS target_label, amount
FROM by_wallet
UNION ALL
SELECT 'income', 'parent:' || CAST(id AS VARCHAR), 'Income', name, amount FROM by_parent
UNION ALL
SELECT 'parent:' || CAST(cs.parent_id AS VARCHAR), 'category:' || CAST(cs.parent_id AS VARCHAR) || ':' || cs.name,
       cs.parent, cs.name, cs.amount
FROM by_name cs WHERE cs.amount > 0
""", YEAR_1996)

# ---- summaries of many requests, recomputed from the rows for each request ----

_SUM_REQUESTS = """,
sum_req AS (
  SELECT request_id, first, first + CAST(k * 11 % 1300 - 40 AS INT) AS last, excluded,
         concat_ws(';', CASE WHEN k % 139 = 30 THEN 'json:type' END, CASE WHEN k % 127 = 9 THEN 'startDate:invalid' END,
                        CASE WHEN k % 131 = 12 AND k % 139 <> 30 THEN 'excludeCategoryIds:missing' END,
                        CASE WHEN k % 137 = 20 AND k % 131 <> 12 THEN 'excludeCategoryIds:not_positive' END) AS reasons
  FROM (SELECT c_custkey AS k, CAST(c_custkey + 1 AS INT) AS request_id, DATE '1994-06-01' + CAST(c_custkey * 37 % 2900 AS INT) AS first,
               CASE WHEN c_custkey % 3 = 0 THEN [] ELSE [c_custkey % 24 + 1, c_custkey * 5 % 24 + 1] END AS excluded FROM customer)
),
sum_ok AS (SELECT * FROM sum_req WHERE reasons = '')"""

_MOVED = """,
exp_more AS (
  SELECT id, category_id, amount, date, priority FROM expense
  UNION ALL SELECT id, category_id, amount, date, priority FROM exp_inserted
),
exp_moved AS (
  SELECT e.id, coalesce(c.category_id, e.category_id) AS category_id, coalesce(c.amount, e.amount) AS amount,
         coalesce(c.date, e.date) AS date, coalesce(c.priority, e.priority) AS priority
  FROM exp_more e LEFT JOIN (SELECT * FROM exp_chg WHERE amount >= 0 AND len(tag_ids) = len(list_distinct(tag_ids))) c USING (id)
  WHERE e.id NOT IN (SELECT id FROM exp_del)
),
inc_more AS (
  SELECT id, amount, wallet_id, date FROM income
  UNION ALL SELECT (SELECT max(id) FROM income) + row_number() OVER (ORDER BY batch_id, pos), amount, wallet_id, date
            FROM inc_validated WHERE status = 'ok' AND batch_ok
),
inc_moved AS (
  SELECT i.id, coalesce(c.amount, i.amount) AS amount, coalesce(c.wallet_id, i.wallet_id) AS wallet_id, coalesce(c.date, i.date) AS date
  FROM inc_more i LEFT JOIN (SELECT * FROM inc_chg WHERE amount >= 1) c USING (id)
  WHERE i.id NOT IN (SELECT id FROM inc_del)
)"""


def _request_parts(expense: str, income: str) -> str:
    """Lists of each answered request, straight from its rows."""
    return f""",
r_spent AS (
  SELECT request_id, category_id, priority, SUM(amount)::BIGINT AS total
  FROM sum_ok JOIN {expense} e ON e.date BETWEEN first AND last AND NOT list_contains(excluded, category_id)
  WHERE category_id IN (SELECT id FROM category) GROUP BY ALL
),
r_earned AS (
  SELECT request_id, wallet_id, SUM(amount)::BIGINT AS total FROM sum_ok JOIN {income} i ON i.date BETWEEN first AND last GROUP BY ALL
),
r_named AS (
  SELECT request_id, p.id AS parent_id, p.name AS parent, c.name, SUM(total)::BIGINT AS amount
  FROM r_spent JOIN category c ON c.id = category_id JOIN parent_category p ON p.id = c.parent_category_id GROUP BY ALL
),
r_parent AS (
  SELECT request_id, parent_id AS id, parent AS name, SUM(amount)::BIGINT AS amount,
         list({{'name': r_named.name, 'amount': r_named.amount}} ORDER BY amount DESC, r_named.name) AS categories
  FROM r_named WHERE amount > 0 GROUP BY ALL
),
r_parents AS (
  SELECT request_id, list({{'name': name, 'amount': amount, 'categories': categories}} ORDER BY amount DESC, name, id) AS parents
  FROM r_parent GROUP BY request_id
),
r_levels AS (
  SELECT request_id, SUM(amount)::BIGINT AS spent, list({{'level': level, 'amount': amount}} ORDER BY amount DESC, level) AS levels
  FROM (SELECT request_id, priority AS level, SUM(total)::BIGINT AS amount FROM r_spent GROUP BY ALL) GROUP BY request_id
),
r_wallets AS (
  SELECT request_id, SUM(total)::BIGINT AS earned, list({{'name': name, 'amount': total}} ORDER BY total DESC, name, id) AS wallets
  FROM r_earned JOIN wallet ON id = wallet_id GROUP BY request_id
)"""


_REQUEST_DOCUMENTS = """
SELECT request_id,
       to_json({'amount': COALESCE(spent, 0), 'groupSummary': {'parentCategories': COALESCE(parents, []), 'priorities': COALESCE(levels, [])}})::VARCHAR
         AS expense,
       to_json({'amount': COALESCE(earned, 0), 'groupSummary': {'wallets': COALESCE(wallets, [])}})::VARCHAR AS income
FROM sum_ok LEFT JOIN r_levels USING (request_id) LEFT JOIN r_parents USING (request_id) LEFT JOIN r_wallets USING (request_id)
"""

ORACLE["validate_summaries"] = "WITH " + FIXTURE_CTES + _SUM_REQUESTS + """
SELECT request_id, CASE WHEN reasons = '' THEN 'ok' ELSE 'invalid' END AS status, reasons FROM sum_req
"""
ORACLE["sum_requests"] = "WITH " + FIXTURE_CTES + _SUM_REQUESTS + _request_parts("expense", "income") + _REQUEST_DOCUMENTS
ORACLE["sum_total_requests"] = "WITH " + FIXTURE_CTES + _SUM_REQUESTS + """
SELECT request_id,
       COALESCE((SELECT SUM(amount) FROM expense WHERE date BETWEEN first AND last AND NOT list_contains(excluded, category_id)
                                                   AND category_id IN (SELECT id FROM category)), 0)::BIGINT AS expense_amount,
       COALESCE((SELECT SUM(amount) FROM income WHERE date BETWEEN first AND last), 0)::BIGINT AS income_amount
FROM sum_ok
"""
ORACLE["cube_expense_moved"] = "WITH " + FIXTURE_CTES + REQUEST_CTES + _MOVED + """
SELECT date, category_id, priority, SUM(amount)::BIGINT AS amount, COUNT(*) AS n FROM exp_moved GROUP BY ALL
"""
ORACLE["cube_income_moved"] = "WITH " + FIXTURE_CTES + REQUEST_CTES + _MOVED + """
SELECT date, wallet_id, SUM(amount)::BIGINT AS amount, COUNT(*) AS n FROM inc_moved GROUP BY ALL
"""
ORACLE["sum_requests_moved"] = ("WITH " + FIXTURE_CTES + REQUEST_CTES + _MOVED + _SUM_REQUESTS
                                + _request_parts("exp_moved", "inc_moved") + _REQUEST_DOCUMENTS)

# ---- collated lists, co-located detail, lenient parameters, far pages ------

for _name in ("cat_list", "wallet_list", "tag_list"):
    ORACLE[f"{_name}_collated"] = ORACLE[_name].replace("LOWER(name)", "name COLLATE NOCASE.NOACCENT")
ORACLE["exp_detail_bucketed"] = ORACLE["exp_detail"]
ORACLE["exp_index_far"] = ORACLE["exp_index_deep"].replace("OFFSET 10000", "OFFSET 100000")
ORACLE["params_lenient"] = r"""
WITH raw AS (
  SELECT CAST(c_custkey + 1 AS INT) AS request_id,
    [c_custkey::VARCHAR, NULL, '-5', '101', '100', '0', '+7', 'null', '', '99999999999', ' 5', '5.0', '1e1', '5' || chr(10)][c_custkey % 14 + 1] AS lim,
    [c_custkey::VARCHAR, '-' || c_custkey, '+12', '2147483647', '2147483648', NULL, 'ten', '--1', '007'][c_custkey % 9 + 1] AS off,
    [strftime(d, '%Y-%m-%d'), strftime(d, '%Y/%m/%d'), strftime(d, '%Y%m%d'), '1996-02-30', '1996-02-29', '1996-2-9', NULL, '0001-01-01', '1996-13-01',
     '1996-02-29 ', 'today'][c_custkey % 11 + 1] AS first,
    ['true', 'false', 'TRUE', '1', '', NULL, 'yes'][c_custkey % 7 + 1] AS flag
  FROM (SELECT *, DATE '1995-01-01' + CAST(c_custkey % 2400 AS INT) AS d FROM customer)
),
num AS (
  SELECT *, CASE WHEN regexp_full_match(lim, '[+-]?[0-9]+') THEN TRY_CAST(ltrim(lim, '+') AS BIGINT) END AS l,
         CASE WHEN regexp_full_match(off, '[+-]?[0-9]+') THEN TRY_CAST(ltrim(off, '+') AS BIGINT) END AS o
  FROM raw
)
SELECT request_id, CAST(CASE WHEN l BETWEEN 0 AND 100 THEN l ELSE 100 END AS INT) AS page_limit,
       CAST(CASE WHEN o BETWEEN 0 AND 2147483647 THEN o ELSE 0 END AS INT) AS page_offset,
       CASE WHEN regexp_full_match(first, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(first AS DATE) END AS first_day,
       CASE flag WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS important
FROM num
"""
