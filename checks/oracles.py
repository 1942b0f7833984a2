"""The same queries in SQL, over the same test tables, for DuckDB.

Written from the meaning of each query, not from its Spark plan: current state by ranking, as-of joins
as range joins, upserts as anti joins.
"""

from __future__ import annotations

from checks.queries import AS_OF, PERIOD

_T0 = 1704067200000
_DAY = 86400000

_AUDIT = f"""
    CASE WHEN seq > 0 OR k % 13 <> 0 THEN ts END AS updated_at,
    CASE WHEN seq > 0 THEN CAST(seq AS BIGINT) END AS updated_by,
    {_T0} + k AS created_at, k % 10 AS created_by,
    op = 'd' AS cdc_deleted, op AS cdc_op, ts AS cdc_source_ts_ms, CAST(seq AS BIGINT) AS seq
"""


def _versions(*parts: tuple[int, str, str, str, str]) -> str:
    """(seq, op, table, condition, extra column) as one relation of versions with their times."""
    return " UNION ALL ".join(
        f"SELECT *, {seq} AS seq, '{op}' AS op, CAST({_T0 + seq * _DAY} AS BIGINT) + k AS ts, {extra} "
        f"FROM {table} WHERE {condition}"
        for seq, op, table, condition, extra in parts
    )


_ACT0 = "CASE WHEN k % 11 <> 0 THEN TRUE END"
_LAST_ACT = f"CASE WHEN k % 3 = 0 THEN FALSE ELSE {_ACT0} END"
_CUSTOMERS = f"""
c_base AS (SELECT c_custkey AS k, c_name, c_mktsegment FROM customer),
c_versions AS ({_versions(
    (0, "r", "c_base", "TRUE", f"{_ACT0} AS act"),
    (1, "u", "c_base", "k % 3 = 0", "FALSE AS act"),
    (2, "d", "c_base", "k % 50 = 0", f"{_LAST_ACT} AS act"),
    (3, "c", "c_base", "k % 100 = 0", "TRUE AS act"),
)}),
customers_log AS (
  SELECT k AS customer_id, c_name AS customer_name, act AS is_active,
    CASE WHEN k % 7 <> 0 THEN c_mktsegment END AS customer_address, {_AUDIT}
  FROM c_versions)"""

_PRODUCTS = f"""
p_base AS (SELECT p_partkey AS k, p_name, p_brand, CAST(p_retailprice AS DECIMAL(10,2)) AS price
           FROM part),
p_priced AS (SELECT *, CAST(price AS DOUBLE) AS p0,
    CAST(CAST(price * CAST('1.1' AS DECIMAL(2,1)) AS DECIMAL(10,2)) AS DOUBLE) AS p1 FROM p_base),
p_versions AS ({_versions(
    (0, "r", "p_priced", "TRUE", "p0 AS p"),
    (1, "u", "p_priced", "k % 4 = 0", "p1 AS p"),
    (2, "d", "p_priced", "k % 97 = 0", "CASE WHEN k % 4 = 0 THEN p1 ELSE p0 END AS p"),
)}),
products_log AS (
  SELECT k AS product_id, p_name AS product_name, p_brand AS barcode, p AS unity_price,
    CASE WHEN k % 17 <> 0 THEN k % 5 <> 0 END AS is_active, {_AUDIT}
  FROM p_versions)"""

_FINAL = """CASE o_orderstatus
      WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'CANCELLED' ELSE 'COMPLETED' END
      WHEN 'P' THEN CASE WHEN o_orderkey % 5 < 2 THEN 'REPROCESSING' ELSE 'PROCESSING' END
      ELSE 'PENDING' END"""

_ORDERS = f"""
o_base AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus AS st,
    date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 10592 AS d, {_FINAL} AS fin
  FROM orders),
o_versions AS ({_versions(
    (0, "c", "o_base", "TRUE", "'PENDING' AS s"),
    (1, "u", "o_base", "st IN ('F', 'P')", "fin AS s"),
    (2, "d", "o_base", "k % 101 = 0", "fin AS s"),
)}),
orders_log AS (
  SELECT k AS order_id, CASE WHEN k % 401 = 0 THEN -1 ELSE d END AS order_date,
    CASE WHEN k % 23 <> 0 THEN d + 10 END AS delivery_date,
    CASE WHEN k % 307 <> 0 THEN o_custkey END AS customer_id,
    CASE WHEN k % 211 <> 0 THEN s END AS status, {_AUDIT}
  FROM o_versions)"""

_ITEMS = """
order_items_log AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
    l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
    epoch_ms(l_shipdate) AS updated_at, l_suppkey AS updated_by, epoch_ms(l_shipdate) AS created_at,
    CASE WHEN (l_orderkey * 10 + l_linenumber) % 13 <> 0
         THEN (l_orderkey * 10 + l_linenumber) % 10 END AS created_by,
    l_returnflag = 'R' AS cdc_deleted,
    CASE l_returnflag WHEN 'N' THEN 'c' WHEN 'A' THEN 'u' ELSE 'd' END AS cdc_op,
    epoch_ms(l_shipdate) AS cdc_source_ts_ms, l_partkey AS seq
  FROM lineitem)"""

_LOG = {"customers": _CUSTOMERS, "products": _PRODUCTS, "orders": _ORDERS, "order_items": _ITEMS}
_KEY = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
}


def _ts(column: str) -> str:
    return f"make_timestamp({column} * 1000)"


_STAGED_AUDIT = f"""
    {_ts('updated_at')} AS updated_at, updated_by, {_ts('created_at')} AS created_at, created_by,
    CAST(cdc_deleted AS INTEGER) AS cdc_deleted, cdc_op, cdc_source_ts_ms"""
_ACTIVE = "CAST(COALESCE(is_active, TRUE) AS INTEGER) AS is_active"


def _day(column: str) -> str:
    return f"CASE WHEN {column} >= 0 THEN DATE '1970-01-01' + CAST({column} AS INTEGER) END AS {column}"


_STAGED = {
    "customers": f"customer_id, customer_name, {_ACTIVE}, customer_address, {_STAGED_AUDIT}",
    "products": f"product_id, product_name, barcode, unity_price, {_ACTIVE}, {_STAGED_AUDIT}",
    "orders": f"""order_id, {_day('order_date')}, {_day('delivery_date')}, customer_id, status,
    {_STAGED_AUDIT}""",
    "order_items": f"order_item_id, order_id, product_id, quantity, {_STAGED_AUDIT}",
}


def _staged(e: str) -> str:
    """CTEs up to ``stg_<entity>``."""
    return f"{_LOG[e]}, stg_{e} AS (SELECT {_STAGED[e]}, seq FROM {e}_log)"


def _current(e: str) -> str:
    """CTEs up to ``cur_<entity>``."""
    return f"""{_staged(e)},
ranked_{e} AS (SELECT *, row_number() OVER (
    PARTITION BY {_KEY[e]} ORDER BY cdc_source_ts_ms DESC, seq DESC) AS rn FROM stg_{e}),
cur_{e} AS (SELECT * EXCLUDE (rn, seq) FROM ranked_{e} WHERE rn = 1 AND cdc_deleted = 0)"""


_END = "TIMESTAMP '9999-12-31 23:59:59.999'"


def _scd2(e: str) -> str:
    """CTEs up to ``scd2_<entity>``."""
    return f"""{_staged(e)},
led_{e} AS (SELECT *, lead(cdc_source_ts_ms) OVER (
    PARTITION BY {_KEY[e]} ORDER BY cdc_source_ts_ms, seq) AS nxt FROM stg_{e}),
scd2_{e} AS (SELECT * EXCLUDE (nxt, seq), {_ts('cdc_source_ts_ms')} AS valid_from,
    COALESCE({_ts('nxt')}, {_END}) AS valid_to, CAST(nxt IS NULL AS INTEGER) AS is_current
  FROM led_{e})"""


def _with(ctes: str | list[str], select: str) -> str:
    joined = ctes if isinstance(ctes, str) else ",".join(ctes)
    return f"WITH {joined}\n{select}"


_E = list(_LOG)
ORACLES: dict[str, str] = {}

for _e in _E:
    ORACLES[f"stage_{_e}"] = _with(_staged(_e), f"SELECT * EXCLUDE (seq) FROM stg_{_e}")
    ORACLES[f"current_{_e}"] = _with(_current(_e), f"SELECT * FROM cur_{_e}")
    ORACLES[f"scd2_{_e}"] = _with(_scd2(_e), f"SELECT * FROM scd2_{_e}")
ORACLES["scd2_order_items_sliced"] = ORACLES["scd2_order_items"]

for _name in ("current_orders_rownum", "late_event_order", "stream_current_orders", "stored_orders_merged_twice"):
    ORACLES[_name] = ORACLES["current_orders"]

# --- decode ------------------------------------------------------------------------------------------

ORACLES["cdc_unwrap"] = _with(_ITEMS, "SELECT * FROM order_items_log")
ORACLES["cdc_quarantine"] = _with(
    _ORDERS,
    """SELECT 'operations.orders' AS topic, seq AS "offset",
       '{"order_id": ' || CAST(order_id AS VARCHAR) AS value
       FROM orders_log WHERE order_id % 997 = 0""",
)
ORACLES["cdc_snapshot_union"] = _with(
    _PRODUCTS,
    f"""SELECT * FROM products_log WHERE cdc_op <> 'r'
UNION ALL
SELECT k, p_name, p_brand, p0, CASE WHEN k % 17 <> 0 THEN k % 5 <> 0 END,
  NULL, NULL, {_T0} + k, k % 10, FALSE, 'r', {_T0}, -1
FROM p_priced""",
)

# --- current state and history -----------------------------------------------------------------------

ORACLES["current_reinsert"] = _with(
    _current("customers"),
    """SELECT * FROM cur_customers WHERE customer_id IN (
         SELECT customer_id FROM customers_log WHERE cdc_op = 'd')""",
)
ORACLES["history_append_count"] = _with(
    [_LOG[e] for e in _E],
    " UNION ALL ".join(
        f"SELECT '{e}' AS entity, count(*) AS history_rows FROM {e}_log" for e in _E
    ),
)
ORACLES["dq_history_counts"] = ORACLES["history_append_count"]
ORACLES["history_dedup"] = _with(_staged("orders"), "SELECT DISTINCT * FROM stg_orders")
ORACLES["scd2_asof_customers"] = _with(
    _scd2("customers"),
    f"""SELECT * EXCLUDE (valid_to, is_current) FROM scd2_customers
        WHERE valid_from <= {_ts(str(AS_OF))} AND {_ts(str(AS_OF))} < valid_to""",
)
ORACLES["scd2_asof_join_orders"] = _with(
    [_staged("orders"), _scd2("customers")],
    f"""SELECT o.order_id, o.status, o.customer_id, o.cdc_source_ts_ms AS at_ms,
          c.customer_name AS customers_customer_name, c.is_active AS customers_is_active,
          c.cdc_deleted AS customers_cdc_deleted,
          c.cdc_source_ts_ms AS customers_cdc_source_ts_ms
        FROM stg_orders o LEFT JOIN scd2_customers c
          ON o.customer_id = c.customer_id
         AND {_ts('o.cdc_source_ts_ms')} >= c.valid_from
         AND {_ts('o.cdc_source_ts_ms')} < c.valid_to""",
)
ORACLES["scd2_active_in_period"] = _with(
    _scd2("customers"),
    f"""SELECT customer_id, customer_name FROM scd2_customers
        WHERE is_current = 1 AND is_active = 1 AND cdc_deleted = 0 AND customer_id IN (
          SELECT customer_id FROM scd2_customers
          WHERE is_active = 1 AND cdc_deleted = 0 AND valid_from < valid_to
            AND valid_from < {_ts(str(PERIOD[1]))} AND valid_to > {_ts(str(PERIOD[0]))})""",
)
ORACLES["audit_op_counts"] = _with(
    [_LOG[e] for e in _E],
    " UNION ALL ".join(
        f"""SELECT '{e}' AS entity, {_KEY[e]} AS key,
            count(*) FILTER (cdc_op = 'r') AS n_r, count(*) FILTER (cdc_op = 'c') AS n_c,
            count(*) FILTER (cdc_op = 'u') AS n_u, count(*) FILTER (cdc_op = 'd') AS n_d
            FROM {e}_log GROUP BY {_KEY[e]}"""
        for e in _E
    ),
)

# --- dimensions and calendar -------------------------------------------------------------------------

_DIM_DATE = """
days AS (SELECT CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS d FROM range(1825) t(i)),
dim_date AS (
  SELECT d AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
    CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
    CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(day(d) AS INTEGER) AS day_of_month,
    CAST(isodow(d) AS INTEGER) AS day_of_week, CAST(day(d) AS VARCHAR) AS day_name,
    dayname(d) AS weekday_name, CASE WHEN isodow(d) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend
  FROM days)"""
_STATUS = """
dim_order_status(status, status_group, is_terminal, display_order) AS (
  VALUES ('PENDING', 'open', 0, 1), ('PROCESSING', 'open', 0, 2), ('REPROCESSING', 'open', 0, 3),
         ('COMPLETED', 'terminal', 1, 4), ('CANCELLED', 'terminal', 1, 5))"""
_IS_OPEN = "IN (SELECT status FROM dim_order_status WHERE is_terminal = 0)"

ORACLES["dim_date"] = _with(
    [_current("orders"), _DIM_DATE],
    """SELECT d.*, (SELECT count(*) FROM cur_orders o WHERE o.delivery_date = d.date_key)
         AS order_count FROM dim_date d""",
)
ORACLES["dim_order_status"] = _with(
    [_current("orders"), _STATUS],
    """SELECT o.status, s.status_group, s.is_terminal, s.display_order, o.order_count
       FROM (SELECT status, count(*) AS order_count FROM cur_orders GROUP BY status) o
       LEFT JOIN dim_order_status s ON o.status = s.status""",
)
for _name, _by in (
    ("calendar_weekend_split", "is_weekend"),
    ("calendar_monthly", "year, month"),
    ("calendar_quarterly", "year, quarter"),
):
    ORACLES[_name] = _with(
        [_current("orders"), _DIM_DATE],
        f"""SELECT {_by}, count(*) AS order_count
            FROM cur_orders LEFT JOIN dim_date ON delivery_date = date_key GROUP BY {_by}""",
    )

# --- marts and reports -------------------------------------------------------------------------------

_MART_DATE_STATUS = """
mart AS (SELECT delivery_date, status, count(*) AS order_count FROM cur_orders
  WHERE delivery_date IS NOT NULL AND status IS NOT NULL GROUP BY delivery_date, status)"""
_MART_DATES = f"""
mart AS (SELECT delivery_date, count(*) AS order_count,
    count(DISTINCT customer_id) AS unique_customers
  FROM cur_orders WHERE status {_IS_OPEN} AND delivery_date IS NOT NULL GROUP BY delivery_date)"""
_MART_PRODUCTS = f"""
mart AS (SELECT i.product_id, COALESCE(p.product_name, '') AS product_name, o.status,
    CAST(sum(i.quantity) AS BIGINT) AS pending_quantity
  FROM cur_order_items i JOIN cur_orders o ON i.order_id = o.order_id
    LEFT JOIN cur_products p ON i.product_id = p.product_id
  WHERE o.status {_IS_OPEN} AND i.product_id IS NOT NULL
  GROUP BY i.product_id, p.product_name, o.status)"""
_MART_CUSTOMERS = f"""
mart AS (SELECT o.customer_id, COALESCE(c.customer_name, '') AS customer_name, o.status,
    count(*) AS order_count
  FROM cur_orders o LEFT JOIN cur_customers c ON o.customer_id = c.customer_id
  WHERE o.status {_IS_OPEN} AND o.customer_id IS NOT NULL
  GROUP BY o.customer_id, c.customer_name, o.status)"""

_BY_DATE_STATUS = [_current("orders"), _STATUS, _MART_DATE_STATUS]
_BY_DATE = [_current("orders"), _STATUS, _MART_DATES]
_BY_PRODUCT = [
    _current("orders"), _current("order_items"), _current("products"), _STATUS, _MART_PRODUCTS
]
_BY_CUSTOMER = [_current("orders"), _current("customers"), _STATUS, _MART_CUSTOMERS]

ORACLES["mart_orders_by_date_status"] = _with(_BY_DATE_STATUS, "SELECT * FROM mart")
ORACLES["mart_top_delivery_dates"] = _with(_BY_DATE, "SELECT * FROM mart")
ORACLES["mart_top_delivery_dates_approx"] = _with(_BY_DATE, "SELECT *, 1 AS within_bound FROM mart")
ORACLES["mart_pending_items_by_product"] = _with(_BY_PRODUCT, "SELECT * FROM mart")
ORACLES["mart_top_customers_open"] = _with(_BY_CUSTOMER, "SELECT * FROM mart")
ORACLES["distinct_mart_statuses"] = _with(_BY_DATE_STATUS, "SELECT DISTINCT status FROM mart")
ORACLES["report_orders_all"] = _with(
    _BY_DATE_STATUS, "SELECT * FROM mart ORDER BY delivery_date, status"
)
ORACLES["report_orders_open"] = _with(
    _BY_DATE_STATUS, f"SELECT * FROM mart WHERE status {_IS_OPEN} ORDER BY delivery_date, status"
)
ORACLES["report_top_delivery_dates"] = _with(
    _BY_DATE, "SELECT * FROM mart ORDER BY order_count DESC, delivery_date LIMIT 3"
)
for _name, _where in (("pending", "WHERE status = 'PENDING'"), ("open", "")):
    ORACLES[f"report_items_by_product_{_name}"] = _with(
        _BY_PRODUCT,
        f"""SELECT product_id, product_name,
              CAST(sum(pending_quantity) AS BIGINT) AS pending_quantity
            FROM mart {_where} GROUP BY product_id, product_name
            ORDER BY pending_quantity DESC, product_id""",
    )
    ORACLES[f"report_top_customers_{_name}"] = _with(
        _BY_CUSTOMER,
        f"""SELECT customer_id, customer_name, CAST(sum(order_count) AS BIGINT) AS order_count
            FROM mart {_where} GROUP BY customer_id, customer_name
            ORDER BY order_count DESC, customer_id LIMIT 3""",
    )

# --- batch path --------------------------------------------------------------------------------------


def _source(name: str, settled: bool) -> str:
    """CTE ``<name>``: the operational orders, first as placed, then with their final status."""
    later = " + INTERVAL 1 DAY" if settled else ""
    status = _FINAL if settled else "'PENDING'"
    creator = (
        "CAST(99 AS BIGINT)" if settled else "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 10 END"
    )
    return f"""{name} AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN o_custkey % 50 = 0 THEN -o_custkey ELSE o_custkey END AS customer_id,
    CAST(o_orderdate AS DATE) + 10592 AS order_date,
    CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) + 10602 END AS delivery_date,
    {status} AS status, o_orderdate{later} AS created_at, o_orderdate AS updated_at,
    {creator} AS created_by,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 10 END AS updated_by
  FROM orders)"""


_PARENTS = """
src_customers AS (SELECT c_custkey AS customer_id, c_name AS customer_name,
    c_custkey % 3 <> 0 AS is_active, c_mktsegment AS customer_address
  FROM customer),
src_products AS (SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS barcode,
    CAST(p_retailprice AS DECIMAL(10,2)) AS unity_price FROM part)"""


def _items(name: str, settled: bool) -> str:
    later = " + INTERVAL 1 DAY" if settled else ""
    creator = "CAST(99 AS BIGINT)" if settled else "created_by"
    return f"""{name} AS (
  SELECT order_item_id, order_id,
    CASE WHEN product_id % 97 = 0 THEN -product_id ELSE product_id END AS product_id,
    quantity, created_at{later} AS created_at, updated_at,
    {creator} AS created_by, updated_by FROM cur_order_items)"""


_SINCE = "TIMESTAMP '1998-01-01'"
_UNTIL = "TIMESTAMP '2000-01-01'"


def _user(column: str) -> str:
    return f"COALESCE(CAST({column} AS VARCHAR), '-1')"


def _analytic_orders(name: str, orders: str) -> str:
    return f"""{name} AS (
  SELECT o.order_id, o.customer_id, COALESCE(c.customer_name, 'Unknown') AS customer_name,
    CAST(o.order_date AS TIMESTAMP) AS order_date,
    CAST(o.delivery_date AS TIMESTAMP) AS delivery_date, o.status,
    CAST(COALESCE(t.n, 0) AS BIGINT) AS total_items,
    CAST(COALESCE(t.amount, 0) AS DECIMAL(20,2)) AS total_amount, o.created_at, o.updated_at,
    {_user('o.created_by')} AS created_by, {_user('o.updated_by')} AS updated_by
  FROM {orders} o LEFT JOIN src_customers c ON o.customer_id = c.customer_id
  LEFT JOIN (SELECT i.order_id, sum(i.quantity) AS n, sum(i.quantity * p.unity_price) AS amount
    FROM src_items i LEFT JOIN src_products p ON i.product_id = p.product_id
    GROUP BY i.order_id) t ON o.order_id = t.order_id)"""


def _analytic_items(name: str, orders: str, items: str) -> str:
    return f"""{name} AS (
  SELECT i.order_item_id AS id, i.order_id, i.product_id,
    COALESCE(p.product_name, 'Unknown') AS product_name, CAST(i.quantity AS BIGINT) AS quantity,
    CAST(COALESCE(p.unity_price, 0) AS DECIMAL(20,2)) AS price, o.status AS order_status,
    CAST(o.delivery_date AS TIMESTAMP) AS delivery_date, i.created_at, i.updated_at,
    COALESCE(CAST(i.created_by AS VARCHAR), 'None') AS created_by,
    COALESCE(CAST(i.updated_by AS VARCHAR), 'None') AS updated_by
  FROM {items} i JOIN {orders} o ON i.order_id = o.order_id
  LEFT JOIN src_products p ON i.product_id = p.product_id)"""


_BATCH = [
    _current("order_items"),
    _source("src_orders", True),
    _items("src_items", True),
    _PARENTS,
    f"changed AS (SELECT * FROM src_orders WHERE updated_at > {_SINCE})",
    "changed_items AS (SELECT * FROM src_items WHERE order_id IN (SELECT order_id FROM changed))",
]
_FIRST = [
    _source("src_orders0", False),
    _items("src_items0", False),
    f"early AS (SELECT * FROM src_orders0 WHERE updated_at <= {_UNTIL})",
]

ORACLES["batch_extract_orders"] = _with(_BATCH, "SELECT * FROM changed")
ORACLES["batch_extract_items"] = _with(_BATCH, "SELECT * FROM changed_items")
ORACLES["batch_extract_customers"] = _with(
    _BATCH,
    "SELECT * FROM src_customers WHERE customer_id IN (SELECT customer_id FROM changed)",
)
ORACLES["batch_extract_products"] = _with(
    _BATCH,
    "SELECT * FROM src_products WHERE product_id IN (SELECT product_id FROM changed_items)",
)
ORACLES["batch_next_watermark"] = _with(_BATCH, "SELECT max(updated_at) AS watermark FROM changed")
ORACLES["batch_transform_orders"] = _with(
    [*_BATCH, _analytic_orders("ao", "changed")], "SELECT * FROM ao"
)
ORACLES["batch_transform_items"] = _with(
    [*_BATCH, _analytic_items("ai", "changed", "src_items")], "SELECT * FROM ai"
)


def _upserted(key: str, keep: str) -> str:
    """Rows only in one side as they are; rows in both from the batch, but for the kept columns."""
    return f"""SELECT n.* REPLACE ({keep}) FROM new_rows n JOIN old_rows o ON n.{key} = o.{key}
UNION ALL SELECT * FROM new_rows WHERE {key} NOT IN (SELECT {key} FROM old_rows)
UNION ALL SELECT * FROM old_rows WHERE {key} NOT IN (SELECT {key} FROM new_rows)"""


_KEEP_ORDER = "o.created_at AS created_at, o.created_by AS created_by"
ORACLES["batch_upsert_orders"] = _with(
    [*_BATCH, *_FIRST, _analytic_orders("old_rows", "early"), _analytic_orders("new_rows", "changed")],
    _upserted("order_id", _KEEP_ORDER),
)
ORACLES["batch_upsert_items"] = _with(
    [
        *_BATCH,
        *_FIRST,
        _analytic_items("old_rows", "early", "src_items0"),
        _analytic_items("new_rows", "changed", "src_items"),
    ],
    _upserted("id", "o.created_at AS created_at"),
)
ORACLES["batch_run_orders"] = _with(
    [
        *_BATCH,
        *_FIRST,
        "again AS (SELECT * FROM src_orders WHERE updated_at >= (SELECT max(updated_at) FROM early))",
        _analytic_orders("old_rows", "early"),
        _analytic_orders("new_rows", "again"),
    ],
    _upserted("order_id", _KEEP_ORDER),
)

_ANALYTIC_ORDERS = [*_BATCH, _analytic_orders("ao", "src_orders")]
_ANALYTIC_ITEMS = [*_BATCH, _analytic_items("ai", "src_orders", "src_items")]
_OPEN_DATED = "FROM ao WHERE status <> 'COMPLETED' AND delivery_date IS NOT NULL"

_R1 = f"""SELECT CAST(delivery_date AS DATE) AS delivery_date, status, count(*) AS order_count
    {_OPEN_DATED} GROUP BY 1, 2 ORDER BY 1, 2"""
_R2 = f"""SELECT CAST(delivery_date AS DATE) AS delivery_date, count(*) AS order_count,
      count(DISTINCT customer_id) AS unique_customers
    {_OPEN_DATED} GROUP BY 1 ORDER BY order_count DESC, 1 LIMIT 3"""
_R3 = """SELECT product_id, product_name, CAST(sum(quantity) AS BIGINT) AS pending_items
    FROM ai WHERE order_status = 'PENDING' GROUP BY 1, 2 ORDER BY pending_items DESC, product_id"""
_R4 = """SELECT customer_id, customer_name, count(*) AS pending_order_count,
      CAST(sum(total_amount) AS DECIMAL(30,2)) AS total_pending_amount
    FROM ao WHERE status = 'PENDING' GROUP BY 1, 2
    ORDER BY pending_order_count DESC, customer_id LIMIT 3"""
ORACLES["batch_open_orders_by_date_status"] = _with(_ANALYTIC_ORDERS, _R1)
ORACLES["batch_top_delivery_dates"] = _with(_ANALYTIC_ORDERS, _R2)
ORACLES["batch_pending_items_by_product"] = _with(_ANALYTIC_ITEMS, _R3)
ORACLES["batch_top_customers_pending"] = _with(_ANALYTIC_ORDERS, _R4)
_REPORT_COLUMNS = {
    "open_orders_by_date_status": (_R1, ("delivery_date", "status", "order_count")),
    "top_delivery_dates": (_R2, ("delivery_date", "order_count", "unique_customers")),
    "pending_items_by_product": (_R3, ("product_id", "product_name", "pending_items")),
    "top_customers_with_pending_orders": (_R4, ("customer_id", "customer_name", "pending_order_count", "total_pending_amount")),
}
ORACLES["export_reports"] = _with(
    [*_ANALYTIC_ORDERS, _analytic_items("ai", "src_orders", "src_items")],
    " UNION ALL ".join(
        f"SELECT '{name}' AS report, '{'|'.join(columns)}' AS header, "
        + " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
        + f" AS line FROM ({sql})"
        for name, (sql, columns) in _REPORT_COLUMNS.items()
    ),
)

# --- streaming and quality -----------------------------------------------------------------------------

_ALL_CURRENT = [_current(e) for e in _E]
ORACLES["dq_live_counts"] = _with(
    _ALL_CURRENT,
    " UNION ALL ".join(f"SELECT '{e}' AS entity, count(*) AS live_rows FROM cur_{e}" for e in _E),
)
ORACLES["stream_fanout_counts"] = _with(
    _ALL_CURRENT,
    " UNION ALL ".join(
        f"""SELECT '{e}' AS entity, (SELECT count(*) FROM stg_{e}) AS history_rows,
            (SELECT count(*) FROM cur_{e}) AS live_rows"""
        for e in _E
    ),
)
ORACLES["stream_replay_idempotent"] = ORACLES["stream_fanout_counts"]
ORACLES["dq_history_ge_current"] = _with(
    [_LOG[e] for e in _E],
    " UNION ALL ".join(
        f"""SELECT '{e}' AS entity, count(*) AS history_rows,
            count(DISTINCT {_KEY[e]}) AS state_rows,
            CAST(count(*) >= count(DISTINCT {_KEY[e]}) AS INTEGER) AS covered FROM {e}_log"""
        for e in _E
    ),
)
_ALL_SCD2 = [_scd2(e) for e in _E]
ORACLES["dq_scd2_no_current"] = _with(
    _ALL_SCD2,
    " UNION ALL ".join(
        f"""SELECT '{e}' AS entity, count(*) AS bad_keys FROM (
            SELECT {_KEY[e]} FROM scd2_{e} GROUP BY {_KEY[e]} HAVING sum(is_current) = 0)"""
        for e in _E
    ),
)
ORACLES["dq_scd2_bad_interval"] = _with(
    _ALL_SCD2,
    " UNION ALL ".join(
        f"SELECT '{e}' AS entity, count(*) AS bad_rows FROM scd2_{e} WHERE valid_from > valid_to"
        for e in _E
    ),
)
ORACLES["dq_unmatched_items"] = _with(
    _BATCH,
    """SELECT product_id, count(*) AS child_rows FROM src_items
       WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM src_products)
       GROUP BY product_id""",
)

ORACLES["stream_mart_orders_by_date_status"] = ORACLES["mart_orders_by_date_status"]
ORACLES["stream_marts"] = f"""
SELECT 'agg_orders_by_date_status' AS mart, CAST(delivery_date AS VARCHAR) AS key, status, CAST(NULL AS VARCHAR) AS name,
  order_count AS n, CAST(NULL AS BIGINT) AS m FROM ({ORACLES["mart_orders_by_date_status"]})
UNION ALL SELECT 'agg_top_delivery_dates', CAST(delivery_date AS VARCHAR), NULL, NULL, order_count, unique_customers
  FROM ({ORACLES["mart_top_delivery_dates"]})
UNION ALL SELECT 'agg_pending_items_by_product', CAST(product_id AS VARCHAR), status, product_name, pending_quantity, NULL
  FROM ({ORACLES["mart_pending_items_by_product"]})
UNION ALL SELECT 'agg_top_customers_open', CAST(customer_id AS VARCHAR), status, customer_name, order_count, NULL
  FROM ({ORACLES["mart_top_customers_open"]})"""
