"""DuckDB SQL text for the recommender views over the shared tables.

These strings are the independent oracle side: they restate in plain SQL
what ``ranklab.sources.tables`` builds with the DataFrame API.
"""

INTER = """inter AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS USER_ID, CAST(l.l_partkey AS VARCHAR) AS ITEM_ID,
         CAST(l.l_returnflag = 'R' AS DOUBLE) AS OUTCOME,
         CAST(epoch_us(o.o_orderdate) // 1000000 AS BIGINT) AS "TIMESTAMP",
         l.l_extendedprice * (1 - l.l_discount) AS OUTCOME_revenue,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

INTER_ORDER = '"TIMESTAMP", l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice'
INTER_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS USER_ID, event_type AS ITEM_ID, value AS OUTCOME,
         epoch_us(ts) AS "TIMESTAMP", event_id
  FROM events)"""

PRIO = """prio AS (
  SELECT CAST(o_custkey AS VARCHAR) AS USER_ID, o_orderpriority AS ITEM_ID,
         CAST(o_totalprice > CAST(200000 AS DOUBLE) AS DOUBLE) AS OUTCOME,
         CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS "TIMESTAMP", o_orderkey
  FROM orders)"""

LAB = """lab AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS USER_ID, CAST(l.quality AS DOUBLE) AS ITEM_quality,
         CAST(l.toxic AS DOUBLE) AS ITEM_toxic, d.lang, d.n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

CLS = """cls AS (
  SELECT CAST(c_custkey AS VARCHAR) AS USER_ID, c_mktsegment AS ITEM_ID, c_nationkey, c_acctbal
  FROM customer)"""

USERS = """users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS USER_ID, c_nationkey AS nation, c_acctbal AS acctbal,
         c_mktsegment AS segment
  FROM customer)"""

ITEMS = """items AS (
  SELECT CAST(p_partkey AS VARCHAR) AS ITEM_ID, p_brand AS brand, p_type AS ptype, p_size AS size,
         p_retailprice AS retailprice
  FROM part)"""


def temporal_split_sql(src: str, order: str, valid: float = 0.1, test: float = 0.1, name: str = "sp") -> str:
    """Positional temporal cut: the last floor(n*test) rows are test, the floor(n*valid) before valid."""
    return f"""{name} AS (
  SELECT * EXCLUDE (rn_, n_, nv_, nt_),
         CASE WHEN rn_ <= n_ - nv_ - nt_ THEN 'train' WHEN rn_ <= n_ - nt_ THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn_, count(*) OVER () AS n_,
               CAST(floor(count(*) OVER () * CAST({valid!r} AS DOUBLE)) AS BIGINT) AS nv_,
               CAST(floor(count(*) OVER () * CAST({test!r} AS DOUBLE)) AS BIGINT) AS nt_
        FROM {src}))"""
