"""Registered checks: ingest, profile, validate, reshape, contracts, splits, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklab.functions.columns import epoch_seconds
from ranklab.operators import profile as pf
from ranklab.operators import reshape as rs
from ranklab.operators import sparse as spw
from ranklab.operators import split as sp
from ranklab.operators import validate as vd
from ranklab.plans import bundle as bd
from ranklab.plans import sql_views as V
from ranklab.plans.registering import r6, registry, written_interactions
from ranklab.plans.transform import transform
from ranklab.sources import tables as T

QUERIES, ORACLE, register = registry()



# ------------------------------------------------------------------ profile

@register("profile_interactions", f"""
WITH {V.INTER}
SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_cols,
       count(DISTINCT USER_ID) AS n_users, count(DISTINCT ITEM_ID) AS n_items,
       round(1 - count(*) / (count(DISTINCT USER_ID) * count(DISTINCT ITEM_ID)), 6) AS sparsity,
       count(*) - count(DISTINCT (USER_ID, ITEM_ID)) AS duplicate_pairs,
       CASE WHEN count(DISTINCT OUTCOME) <= 1 THEN 'constant'
            WHEN bool_and(OUTCOME IN (0, 1)) THEN 'binary'
            WHEN count(DISTINCT OUTCOME) <= 10 AND bool_and(OUTCOME IN (1,2,3,4,5,6,7,8,9,10)) THEN 'rating'
            ELSE 'continuous' END AS target_type,
       min("TIMESTAMP") AS min_ts, max("TIMESTAMP") AS max_ts
FROM inter""")
def q_profile(spark, sf):
    inter = T.interactions(spark, sf).select("USER_ID", "ITEM_ID", "OUTCOME", "TIMESTAMP", "OUTCOME_revenue")
    p = pf.profile_interactions(inter)
    return p.select("n_rows", "n_cols", "n_users", "n_items", r6("sparsity"), "duplicate_pairs", "target_type",
                    epoch_seconds("min_ts").alias("min_ts"), epoch_seconds("max_ts").alias("max_ts"))


_ORDERS_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@register("column_summary_orders", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS name, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count, "
    f"count(DISTINCT {c}) AS n_unique FROM orders" for c in _ORDERS_COLS))
def q_column_summary(spark, sf):
    return pf.column_summary(T.table(spark, sf, "orders"), n_samples=0).select("name", "null_count", "n_unique")


@register("column_samples_customer", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS name, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v "
    f"FROM customer WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples" for c in
    ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def q_column_samples(spark, sf):
    cust = T.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    s = pf.column_summary(cust, n_samples=5)
    return s.select("name", F.array_join("sample_values", "|").alias("samples"))


@register("target_types", """
SELECT 'inter_outcome' AS source,
       CASE WHEN count(DISTINCT o) <= 1 THEN 'constant' WHEN bool_and(o IN (0, 1)) THEN 'binary'
            WHEN count(DISTINCT o) <= 10 AND bool_and(o IN (1,2,3,4,5,6,7,8,9,10)) THEN 'rating'
            ELSE 'continuous' END AS target_type
FROM (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS o FROM lineitem)
UNION ALL
SELECT 'event_value', CASE WHEN count(DISTINCT value) <= 1 THEN 'constant' WHEN bool_and(value IN (0, 1)) THEN 'binary'
            WHEN count(DISTINCT value) <= 10 AND bool_and(value IN (1,2,3,4,5,6,7,8,9,10)) THEN 'rating'
            ELSE 'continuous' END FROM events
UNION ALL
SELECT 'part_size', CASE WHEN count(DISTINCT p_size) <= 1 THEN 'constant' WHEN bool_and(p_size IN (0, 1)) THEN 'binary'
            WHEN count(DISTINCT p_size) <= 10 AND bool_and(p_size IN (1,2,3,4,5,6,7,8,9,10)) THEN 'rating'
            ELSE 'continuous' END FROM part
UNION ALL
SELECT 'segment', CASE WHEN count(DISTINCT c_mktsegment) <= 1 THEN 'constant' ELSE 'categorical' END FROM customer
""")
def q_target_types(spark, sf):
    li = T.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("o"))
    parts = [
        pf.classify_target(li, "o").select(F.lit("inter_outcome").alias("source"), "target_type"),
        pf.classify_target(T.table(spark, sf, "events"), "value").select(F.lit("event_value").alias("source"),
                                                                         "target_type"),
        pf.classify_target(T.table(spark, sf, "part"), "p_size").select(F.lit("part_size").alias("source"),
                                                                        "target_type"),
        pf.classify_target(T.table(spark, sf, "customer"), "c_mktsegment").select(F.lit("segment").alias("source"),
                                                                                  "target_type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("bundle_profile_interactions", f"""
WITH {V.INTER}
SELECT count(*) AS n_rows, count(DISTINCT USER_ID) AS n_users,
       round(1 - count(*) / (count(DISTINCT USER_ID) * count(DISTINCT ITEM_ID)), 6) AS sparsity,
       CASE WHEN count(DISTINCT OUTCOME) <= 1 THEN 'constant' WHEN bool_and(OUTCOME IN (0, 1)) THEN 'binary'
            ELSE 'continuous' END AS target_type,
       TRUE AS has_timestamps, TRUE AS has_user_features, TRUE AS has_item_features
FROM inter""")
def q_bundle_profile(spark, sf):
    inter = T.interactions(spark, sf)
    p = pf.bundle_profile(inter, T.users(spark, sf), T.items(spark, sf))
    return p.select("n_rows", "n_users", r6("sparsity"), "target_type", "has_timestamps", "has_user_features",
                    "has_item_features")


# ------------------------------------------------------------------ validate

@register("user_overlap_inter_customer", f"""
WITH {V.INTER}, {V.USERS},
iu AS (SELECT DISTINCT USER_ID FROM inter), uu AS (SELECT DISTINCT USER_ID FROM users)
SELECT (SELECT count(*) FROM iu) AS n_interaction_users, (SELECT count(*) FROM uu) AS n_feature_users,
       (SELECT count(*) FROM iu WHERE USER_ID IN (SELECT USER_ID FROM uu)) AS n_shared""")
def q_overlap(spark, sf):
    return vd.user_overlap(T.interactions(spark, sf), T.users(spark, sf))


@register("binary_reward_check", f"""
WITH {V.INTER}, {V.EV}
SELECT 'inter' AS source, CAST(count_if(OUTCOME IS NOT NULL AND OUTCOME NOT IN (0, 1)) AS BIGINT) AS n_bad,
       (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT OUTCOME AS v FROM inter
        WHERE OUTCOME IS NOT NULL AND OUTCOME NOT IN (0, 1) ORDER BY v LIMIT 5)) AS samples
FROM inter
UNION ALL
SELECT 'events', CAST(count_if(OUTCOME IS NOT NULL AND OUTCOME NOT IN (0, 1)) AS BIGINT),
       (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT OUTCOME AS v FROM ev
        WHERE OUTCOME IS NOT NULL AND OUTCOME NOT IN (0, 1) ORDER BY v LIMIT 5))
FROM ev""")
def q_binary(spark, sf):
    a = vd.binary_reward_report(T.interactions(spark, sf), "OUTCOME").select(F.lit("inter").alias("source"), "*")
    b = vd.binary_reward_report(T.events(spark, sf), "OUTCOME").select(F.lit("events").alias("source"), "*")
    out = a.unionByName(b)
    return out.select("source", "n_bad", F.when(F.size("samples") > 0, F.array_join(
        F.transform("samples", lambda x: x.cast("string")), "|")).alias("samples"))


@register("duplicate_users_priorities", f"""
WITH {V.PRIO}
SELECT count(*) AS n_duplicated_users, CAST(sum(n) AS BIGINT) AS n_rows_of_duplicated, max(n) AS max_rows_per_user
FROM (SELECT USER_ID, count(*) AS n FROM prio GROUP BY USER_ID HAVING count(*) > 1)""")
def q_dups(spark, sf):
    d = vd.duplicate_keys(T.priorities(spark, sf), "USER_ID")
    return d.agg(F.count(F.lit(1)).alias("n_duplicated_users"), F.sum("n").cast("long").alias("n_rows_of_duplicated"),
                 F.max("n").alias("max_rows_per_user"))


# ------------------------------------------------------------------ reshape

_PRIOS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@register("pivot_priorities_wide", f"""
WITH {V.PRIO}
SELECT USER_ID,
  {', '.join(f"coalesce(max(CASE WHEN ITEM_ID = '{p}' THEN OUTCOME END), 0) AS \"ITEM_{p}\"" for p in _PRIOS)},
  arg_min("TIMESTAMP", ("TIMESTAMP", o_orderkey)) AS "TIMESTAMP",
  arg_min(o_orderkey, ("TIMESTAMP", o_orderkey)) AS o_orderkey
FROM prio GROUP BY USER_ID""")
def q_pivot(spark, sf):
    return rs.pivot_to_wide(T.priorities(spark, sf), "USER_ID", "ITEM_ID", "OUTCOME",
                            order_cols=["TIMESTAMP", "o_orderkey"])


@register("pivot_parts_sparse", f"""
WITH {V.INTER},
c AS (SELECT USER_ID, 'ITEM_' || ITEM_ID AS t, max(OUTCOME) AS v FROM inter GROUP BY ALL),
m AS (SELECT USER_ID, count(*) AS n_targets, string_agg(t || ':' || CAST(CAST(v AS INTEGER) AS VARCHAR), ',' ORDER BY t) AS targets FROM c GROUP BY USER_ID),
f AS (SELECT USER_ID, arg_min("TIMESTAMP", ("TIMESTAMP", l_orderkey, l_linenumber)) AS first_seen,
             arg_min(l_orderkey, ("TIMESTAMP", l_orderkey, l_linenumber)) AS first_order FROM inter GROUP BY USER_ID)
SELECT USER_ID, n_targets, targets, first_seen, first_order FROM m JOIN f USING (USER_ID)""")
def q_pivot_sparse(spark, sf):
    """A target a part, thousands of them, kept as cells."""
    d = T.interactions(spark, sf).select("USER_ID", "ITEM_ID", "OUTCOME", "TIMESTAMP", "l_orderkey", "l_linenumber")
    w = spw.user_rows(spw.pivot_sparse(d, order_cols=["TIMESTAMP", "l_orderkey", "l_linenumber"]))
    cells = F.transform(F.map_entries("TARGETS"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("int").cast("string")))
    return w.select("USER_ID", F.size("TARGETS").cast("long").alias("n_targets"), F.array_join(cells, ",").alias("targets"),
                    F.col("TIMESTAMP").alias("first_seen"), F.col("l_orderkey").alias("first_order"))


@register("target_manifest_parts", f"""
WITH {V.INTER},
c AS (SELECT USER_ID, 'ITEM_' || ITEM_ID AS t, max(CASE WHEN l_linenumber >= 7 THEN l_quantity ELSE OUTCOME END) AS v FROM inter GROUP BY ALL),
u AS (SELECT count(DISTINCT USER_ID) AS n FROM inter),
a AS (SELECT t, n, count(*) AS k, count(DISTINCT v) AS d, min(v) AS lo, bool_or(v = 0) AS zero, count(*) FILTER (v NOT IN (0, 1)) AS bad FROM c, u GROUP BY t, n),
b AS (SELECT *, d + CASE WHEN k < n AND NOT zero THEN 1 ELSE 0 END AS nd FROM a),
s AS (SELECT t, string_agg(CAST(CAST(v AS INTEGER) AS VARCHAR), ',' ORDER BY v) AS samples
      FROM (SELECT DISTINCT t, v, dense_rank() OVER (PARTITION BY t ORDER BY v) AS r FROM c WHERE v NOT IN (0, 1)) WHERE r <= 5 GROUP BY t)
SELECT t AS "column", CASE WHEN bad > 0 THEN 'bad_non_binary' WHEN nd < 2 THEN 'degenerate' ELSE 'ok' END AS status,
       CASE WHEN bad = 0 AND nd < 2 THEN lo END AS value_seen, CASE WHEN bad > 0 THEN samples END AS samples,
       n AS n_nonnull, CAST(nd AS BIGINT) AS n_distinct
FROM b LEFT JOIN s USING (t)""")
def q_manifest_sparse(spark, sf):
    """R9 over a target a part; the last line of an order holds its quantity in place of the flag."""
    v = F.when(F.col("l_linenumber") >= 7, F.col("l_quantity")).otherwise(F.col("OUTCOME"))
    m = spw.cell_manifest(spw.pivot_sparse(T.interactions(spark, sf).select("USER_ID", "ITEM_ID", v.alias("OUTCOME"))))
    return m.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("double").cast("int").cast("string")), ","))


@register("melt_labels_long", f"""
WITH {V.LAB}
SELECT USER_ID, lang, n_chars, 'ITEM_quality' AS ITEM_ID, ITEM_quality AS OUTCOME FROM lab
UNION ALL
SELECT USER_ID, lang, n_chars, 'ITEM_toxic', ITEM_toxic FROM lab""")
def q_melt(spark, sf):
    return rs.melt_to_long(T.labelled_docs(spark, sf), "USER_ID", ["ITEM_quality", "ITEM_toxic"])


@register("sequences_events", f"""
WITH {V.EV}
SELECT USER_ID, count(*) AS seq_len, string_agg(ITEM_ID, '|' ORDER BY "TIMESTAMP", event_id) AS items,
       arg_min(OUTCOME, ("TIMESTAMP", event_id)) AS first_outcome,
       arg_max(OUTCOME, ("TIMESTAMP", event_id)) AS last_outcome
FROM ev GROUP BY USER_ID""")
def q_sequences(spark, sf):
    df, _ = transform(T.events(spark, sf), "prebuilt_sequences", timestamp_column="TIMESTAMP",
                      outcome_column="OUTCOME", tiebreak=["event_id"], with_report=False)
    return df.select("USER_ID", F.size("ITEM_SEQUENCE").cast("long").alias("seq_len"),
                     F.array_join("ITEM_SEQUENCE", "|").alias("items"),
                     F.col("OUTCOME_SEQUENCE")[0].alias("first_outcome"),
                     F.element_at("OUTCOME_SEQUENCE", -1).alias("last_outcome"))


SESSION_GAP_US = 3_600_000_000  # one hour between events starts a new session


@register("sessions_events", f"""
WITH {V.EV},
s1 AS (SELECT *, CASE WHEN "TIMESTAMP" - lag("TIMESTAMP") OVER (PARTITION BY USER_ID ORDER BY "TIMESTAMP", event_id)
                      > {SESSION_GAP_US} THEN 1 ELSE 0 END AS new_ FROM ev),
s2 AS (SELECT *, sum(new_) OVER (PARTITION BY USER_ID ORDER BY "TIMESTAMP", event_id ROWS UNBOUNDED PRECEDING) AS sid
       FROM s1),
s3 AS (SELECT USER_ID, sid, min("TIMESTAMP") AS start_, string_agg(ITEM_ID, ',' ORDER BY "TIMESTAMP", event_id) AS items
       FROM s2 GROUP BY USER_ID, sid)
SELECT USER_ID, count(*) AS n_sessions, string_agg(items, '|' ORDER BY start_, sid) AS sessions
FROM s3 GROUP BY USER_ID""")
def q_sessions(spark, sf):
    df, _ = transform(T.events(spark, sf), "sessions", timestamp_column="TIMESTAMP", session_gap=SESSION_GAP_US,
                      tiebreak=["event_id"], drop_null_columns=False, with_report=False)
    return df.select("USER_ID", F.size("SESSION_SEQUENCES").cast("long").alias("n_sessions"),
                     F.array_join(F.transform("SESSION_SEQUENCES", lambda s: F.array_join(s, ",")), "|")
                     .alias("sessions"))


_TRIAGE_SRC = """cw AS (
  SELECT CAST(c_custkey AS VARCHAR) AS USER_ID, c_nationkey AS ITEM_nation, c_mktsegment AS ITEM_segment,
         CAST(c_acctbal > 0 AS DOUBLE) AS ITEM_positive, CAST(c_custkey >= 0 AS DOUBLE) AS ITEM_all
  FROM customer)"""


@register("target_manifest_customer", f"""
WITH {_TRIAGE_SRC},
lg AS (SELECT 'ITEM_nation' AS "column", CAST(ITEM_nation AS VARCHAR) AS s FROM cw
       UNION ALL SELECT 'ITEM_segment', CAST(ITEM_segment AS VARCHAR) FROM cw
       UNION ALL SELECT 'ITEM_positive', CAST(ITEM_positive AS VARCHAR) FROM cw
       UNION ALL SELECT 'ITEM_all', CAST(ITEM_all AS VARCHAR) FROM cw),
l2 AS (SELECT *, TRY_CAST(s AS DOUBLE) AS d FROM lg),
per AS (SELECT "column", count(s) AS n_nonnull, count(d) AS n_numeric, count(DISTINCT d) AS n_distinct,
               count_if(d IS NOT NULL AND d NOT IN (0, 1)) AS n_nonbinary, min(d) AS only_
        FROM l2 GROUP BY "column"),
st AS (SELECT *, CASE WHEN n_numeric < n_nonnull THEN 'bad_non_binary' WHEN n_nonnull = 0 THEN 'degenerate'
                      WHEN n_nonbinary > 0 THEN 'bad_non_binary' WHEN n_distinct < 2 THEN 'degenerate' ELSE 'ok' END
              AS status FROM per),
bad AS (SELECT DISTINCT l2."column", s, d FROM l2 JOIN st USING ("column")
        WHERE CASE WHEN st.n_numeric < st.n_nonnull THEN s IS NOT NULL ELSE d IS NOT NULL AND d NOT IN (0, 1) END),
smp AS (SELECT "column", string_agg(s, ',' ORDER BY d NULLS FIRST, s) AS samples FROM (
          SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY d NULLS FIRST, s) AS rn FROM bad)
        WHERE rn <= 5 GROUP BY "column")
SELECT st."column", status, CASE WHEN status = 'degenerate' THEN only_ END AS value_seen,
       CASE WHEN status = 'bad_non_binary' THEN samples END AS samples, n_nonnull, n_distinct
FROM st LEFT JOIN smp USING ("column")""")
def q_manifest(spark, sf):
    c = T.table(spark, sf, "customer")
    cw = c.select(F.col("c_custkey").cast("string").alias("USER_ID"), F.col("c_nationkey").alias("ITEM_nation"),
                  F.col("c_mktsegment").alias("ITEM_segment"),
                  (F.col("c_acctbal") > 0).cast("double").alias("ITEM_positive"),
                  (F.col("c_custkey") >= 0).cast("double").alias("ITEM_all"))
    m = rs.target_manifest(cw)
    return m.select("column", "status", "value_seen", F.array_join("samples", ",").alias("samples"),
                    "n_nonnull", "n_distinct")


@register("dedupe_first_priorities", f"""
WITH {V.PRIO}
SELECT USER_ID, ITEM_ID, OUTCOME, "TIMESTAMP", o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY USER_ID ORDER BY "TIMESTAMP", o_orderkey) AS rn FROM prio)
WHERE rn = 1""")
def q_dedupe(spark, sf):
    return rs.dedupe_first(T.priorities(spark, sf), "USER_ID", ["TIMESTAMP", "o_orderkey"])


@register("transform_orders_long_with_timestamp", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS USER_ID, o_orderstatus, o_totalprice AS OUTCOME,
       o_orderpriority AS ITEM_ID, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS "TIMESTAMP"
FROM orders""")
def q_transform_long_ts(spark, sf):
    df, _ = transform(T.table(spark, sf, "orders"), "long_with_timestamp", user_id_column="o_custkey",
                      item_id_column="o_orderpriority", outcome_column="o_totalprice",
                      timestamp_column="o_orderdate", with_report=False)
    return df


@register("transform_labels_wide", """
SELECT CAST(doc_id AS VARCHAR) AS USER_ID, CAST(quality AS DOUBLE) AS ITEM_quality, CAST(toxic AS DOUBLE) AS ITEM_toxic
FROM labels""")
def q_transform_wide(spark, sf):
    df, _ = transform(T.table(spark, sf, "labels"), "wide_multioutput", user_id_column="doc_id",
                      target_columns=["quality", "toxic"], with_report=False)
    return df


@register("transform_lineitem_multi_reward", """
SELECT CAST(l_orderkey AS VARCHAR) AS USER_ID, CAST(l_partkey AS VARCHAR) AS ITEM_ID, l_quantity AS OUTCOME,
       l_extendedprice AS OUTCOME_extendedprice, l_discount AS OUTCOME_discount, l_linenumber
FROM lineitem""")
def q_transform_multi(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                                               "l_discount", "l_linenumber")
    li = li.withColumnsRenamed({"l_extendedprice": "extendedprice", "l_discount": "discount"})
    df, _ = transform(li, "long_multi_reward", user_id_column="l_orderkey", item_id_column="l_partkey",
                      outcome_column="l_quantity", auxiliary_outcome_columns=["extendedprice", "discount"],
                      with_report=False)
    return df


@register("transform_customer_multiclass", """
SELECT CAST(c_custkey AS VARCHAR) AS USER_ID, c_mktsegment AS ITEM_ID, c_name, c_nationkey, c_acctbal
FROM customer""")
def q_transform_multiclass(spark, sf):
    df, _ = transform(T.table(spark, sf, "customer"), "multiclass", user_id_column="c_custkey",
                      item_id_column="c_mktsegment", with_report=False)
    return df


@register("transform_part_items_features", """
SELECT CAST(p_partkey AS VARCHAR) AS ITEM_ID, p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def q_transform_items(spark, sf):
    df, _ = transform(T.table(spark, sf, "part"), "items_features", item_id_column="p_partkey", with_report=False)
    return df


@register("transform_supplier_users_features", """
SELECT CAST(s_suppkey AS VARCHAR) AS USER_ID, s_name, s_nationkey, s_acctbal FROM supplier""")
def q_transform_users(spark, sf):
    df, _ = transform(T.table(spark, sf, "supplier"), "users_features", user_id_column="s_suppkey",
                      with_report=False)
    return df


@register("wide_from_long_labels_melt", """
SELECT CAST(doc_id AS VARCHAR) AS USER_ID, 'quality' AS ITEM_ID, CAST(quality AS DOUBLE) AS OUTCOME FROM labels
UNION ALL
SELECT CAST(doc_id AS VARCHAR), 'toxic', CAST(toxic AS DOUBLE) FROM labels""")
def q_long_from_wide(spark, sf):
    df, _ = transform(T.table(spark, sf, "labels"), "long_interactions", user_id_column="doc_id",
                      target_columns=["quality", "toxic"], with_report=False)
    return df


# ------------------------------------------------------------------ splits

def _split_summary(df):
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("USER_ID").alias("n_users"),
                                   F.sum("l_orderkey").alias("sum_orderkey"), F.sum("l_partkey").alias("sum_partkey"))


_SPLIT_SUMMARY_SQL = ("SELECT split, count(*) AS n_rows, count(DISTINCT USER_ID) AS n_users, "
                      "CAST(sum(l_orderkey) AS BIGINT) AS sum_orderkey, CAST(sum(l_partkey) AS BIGINT) AS sum_partkey "
                      "FROM {src} GROUP BY split")


@register("split_temporal", f"""
WITH {V.INTER}, {V.temporal_split_sql('inter', V.INTER_ORDER)}
SELECT split, count(*) AS n_rows, min("TIMESTAMP") AS min_ts, max("TIMESTAMP") AS max_ts,
       CAST(sum(l_orderkey) AS BIGINT) AS sum_orderkey, CAST(sum(l_partkey) AS BIGINT) AS sum_partkey
FROM sp GROUP BY split""")
def q_split_temporal(spark, sf):
    s = sp.temporal_split(written_interactions(spark, sf, ["TIMESTAMP", *T.INTER_TIEBREAK]), 0.1, 0.1, "TIMESTAMP", T.INTER_TIEBREAK)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("TIMESTAMP").alias("min_ts"),
                                  F.max("TIMESTAMP").alias("max_ts"), F.sum("l_orderkey").alias("sum_orderkey"),
                                  F.sum("l_partkey").alias("sum_partkey"))


@register("split_temporal_uneven", f"""
WITH {V.INTER}, {V.temporal_split_sql('inter', V.INTER_ORDER, 0.07, 0.23)}
SELECT split, count(*) AS n_rows, count(DISTINCT USER_ID) AS n_users,
       CAST(sum(l_orderkey) AS BIGINT) AS sum_orderkey, CAST(sum(l_partkey) AS BIGINT) AS sum_partkey
FROM sp GROUP BY split""")
def q_split_temporal_uneven(spark, sf):
    return _split_summary(sp.temporal_split(written_interactions(spark, sf, ["USER_ID", "TIMESTAMP", *T.INTER_TIEBREAK]), 0.07, 0.23, "TIMESTAMP", T.INTER_TIEBREAK))


@register("split_leave_last_events", f"""
WITH {V.EV},
r AS (SELECT *, row_number() OVER (PARTITION BY USER_ID ORDER BY "TIMESTAMP" DESC, event_id DESC) AS rn,
             count(*) OVER (PARTITION BY USER_ID) AS n FROM ev),
s AS (SELECT *, CASE WHEN n > 3 AND rn <= 1 THEN 'test' WHEN n > 3 AND rn <= 3 THEN 'valid' ELSE 'train' END AS split
      FROM r)
SELECT split, count(*) AS n_rows, count(DISTINCT USER_ID) AS n_users, CAST(sum(event_id) AS BIGINT) AS sum_event_id
FROM s GROUP BY split""")
def q_split_last(spark, sf):
    s = sp.leave_last_n_per_user(T.events(spark, sf), n_valid=2, n_test=1, tiebreak=["event_id"])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("USER_ID").alias("n_users"),
                                  F.sum("event_id").alias("sum_event_id"))


_INTER_HASH = f"md5(concat_ws('|', '42', {V.INTER_KEY}))"


@register("split_random_per_user", f"""
WITH {V.INTER},
r AS (SELECT *, row_number() OVER (PARTITION BY USER_ID ORDER BY {_INTER_HASH}, {V.INTER_KEY}) AS rn,
             count(*) OVER (PARTITION BY USER_ID) AS n FROM inter),
s AS (SELECT *, CASE WHEN rn <= floor(n * CAST(0.1 AS DOUBLE)) THEN 'valid'
                     WHEN rn <= floor(n * CAST(0.1 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'test'
                     ELSE 'train' END AS split FROM r)
{_SPLIT_SUMMARY_SQL.format(src='s')}""")
def q_split_random_user(spark, sf):
    return _split_summary(sp.random_split_per_user(T.interactions(spark, sf), 0.1, 0.2, 42,
                                                   key_cols=list(T.INTER_TIEBREAK)))


@register("split_users_out", f"""
WITH {V.INTER},
u AS (SELECT USER_ID, row_number() OVER (ORDER BY md5(concat_ws('|', '7', USER_ID)), USER_ID) AS r
      FROM (SELECT DISTINCT USER_ID FROM inter)),
s AS (SELECT inter.*, CASE WHEN u.r <= 100 THEN 'valid' WHEN u.r <= 250 THEN 'test' ELSE 'train' END AS split
      FROM inter JOIN u USING (USER_ID))
{_SPLIT_SUMMARY_SQL.format(src='s')}""")
def q_split_users(spark, sf):
    return _split_summary(sp.leave_n_users_out(T.interactions(spark, sf), 100, 150, random_state=7))


@register("split_random_rows", f"""
WITH {V.INTER},
r AS (SELECT *, row_number() OVER (ORDER BY {_INTER_HASH}, {V.INTER_KEY}) AS rn, count(*) OVER () AS n FROM inter),
s AS (SELECT *, CASE WHEN rn <= floor(n * CAST(0.15 AS DOUBLE)) THEN 'valid'
                     WHEN rn <= floor(n * CAST(0.15 AS DOUBLE)) + floor(n * CAST(0.05 AS DOUBLE)) THEN 'test'
                     ELSE 'train' END AS split FROM r)
{_SPLIT_SUMMARY_SQL.format(src='s')}""")
def q_split_random(spark, sf):
    return _split_summary(sp.random_split(T.interactions(spark, sf), 0.15, 0.05, 42, key_cols=list(T.INTER_TIEBREAK)))


# ------------------------------------------------------------------ joins

@register("join_user_features_by_segment", f"""
WITH {V.INTER}, {V.USERS}
SELECT segment, count(*) AS n_rows, count(DISTINCT USER_ID) AS n_users, CAST(sum(OUTCOME) AS DOUBLE) AS n_returns,
       round(avg(acctbal), 6) AS avg_acctbal
FROM inter LEFT JOIN users USING (USER_ID) GROUP BY segment""")
def q_join_users(spark, sf):
    j = bd.join_user_features(T.interactions(spark, sf), T.users(spark, sf))
    return j.groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("USER_ID").alias("n_users"),
                                    F.sum("OUTCOME").alias("n_returns"), F.round(F.avg("acctbal"), 6).alias("avg_acctbal"))


@register("join_item_features_by_brand", f"""
WITH {V.INTER}, {V.ITEMS}
SELECT brand, count(*) AS n_rows, count(DISTINCT ITEM_ID) AS n_items, round(avg(retailprice), 6) AS avg_price,
       (SELECT count(*) FROM (SELECT DISTINCT USER_ID FROM inter) WHERE USER_ID NOT IN
          (SELECT CAST(c_custkey AS VARCHAR) FROM customer)) AS n_unmatched_users
FROM inter LEFT JOIN items USING (ITEM_ID) GROUP BY brand""")
def q_join_items(spark, sf):
    inter = T.interactions(spark, sf)
    j = bd.join_item_features(inter, T.items(spark, sf))
    n_unmatched = bd.unmatched_users(inter, T.users(spark, sf)).agg(F.count(F.lit(1)).alias("n_unmatched_users"))
    g = j.groupBy("brand").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ITEM_ID").alias("n_items"),
                               F.round(F.avg("retailprice"), 6).alias("avg_price"))
    return g.crossJoin(F.broadcast(n_unmatched))   # one row


# ------------------------------------------------------------------ more column operators

@register("binarize_revenue", f"""
WITH {V.INTER}
SELECT USER_ID, ITEM_ID, CAST(OUTCOME_revenue >= CAST(50000 AS DOUBLE) AS DOUBLE) AS OUTCOME, {V.INTER_KEY}
FROM inter""")
def q_binarize(spark, sf):
    inter = T.interactions(spark, sf)
    out = rs.binarize(inter, "OUTCOME_revenue", 50000.0, out="OUTCOME")
    return out.select("USER_ID", "ITEM_ID", "OUTCOME", *T.INTER_TIEBREAK)


@register("numeric_text_flags_customer", """
SELECT count(TRY_CAST(CAST(c_nationkey AS VARCHAR) AS DOUBLE)) = count(c_nationkey) AND count(c_nationkey) > 0 AS nation_text,
       count(TRY_CAST(c_mktsegment AS DOUBLE)) = count(c_mktsegment) AND count(c_mktsegment) > 0 AS c_mktsegment,
       count(TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE)) = count(c_acctbal) AND count(c_acctbal) > 0 AS acct_text
FROM customer""")
def q_numeric_text(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("nation_text"),
                                             "c_mktsegment", F.col("c_acctbal").cast("string").alias("acct_text"))
    return rs.numeric_text_flags(c, ["nation_text", "c_mktsegment", "acct_text"])


def _shape_sql(view: str, two_item_columns: str) -> str:
    cte = two_item_columns  # schema fact: the view has >= 2 ITEM_* columns
    return f"""SELECT '{view}' AS view, CASE
      WHEN (SELECT max(c) FROM (SELECT count(*) AS c FROM {view} GROUP BY USER_ID)) > 1 THEN 'long'
      WHEN {cte} THEN 'wide_already'
      ELSE 'single_row_per_user' END AS shape"""


@register("source_shapes", f"""
WITH {V.INTER}, {V.LAB}, {V.CLS}
{_shape_sql('inter', 'FALSE')}
UNION ALL {_shape_sql('lab', 'TRUE')}
UNION ALL {_shape_sql('cls', 'FALSE')}""")
def q_shapes(spark, sf):
    views = {"inter": T.interactions(spark, sf), "lab": T.labelled_docs(spark, sf), "cls": T.customer_classes(spark, sf)}
    rows = [(k, rs.detect_source_shape(v)) for k, v in views.items()]
    return spark.createDataFrame(rows, "view string, shape string")


_SIZED = ("lineitem", "orders", "customer", "events", "documents")


@register("large_table_flags", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) > 100000 AS is_large FROM {t}" for t in _SIZED))
def q_large(spark, sf):
    return pf.large_flags({t: T.table(spark, sf, t) for t in _SIZED})


@register("transform_priorities_wide", f"""
WITH {V.PRIO}
SELECT USER_ID,
  {', '.join(f"coalesce(max(CASE WHEN ITEM_ID = '{p}' THEN OUTCOME END), 0) AS \"ITEM_{p}\"" for p in _PRIOS)},
  arg_min("TIMESTAMP", ("TIMESTAMP", o_orderkey)) AS "TIMESTAMP",
  arg_min(o_orderkey, ("TIMESTAMP", o_orderkey)) AS o_orderkey
FROM prio GROUP BY USER_ID""")
def q_transform_prio_wide(spark, sf):
    df, _ = transform(T.priorities(spark, sf), "wide_multioutput", user_id_column="USER_ID", item_id_column="ITEM_ID",
                      outcome_column="OUTCOME", order_cols=["TIMESTAMP", "o_orderkey"], with_report=False)
    return df


@register("transform_lineitem_selected_features", """
SELECT CAST(l_orderkey AS VARCHAR) AS USER_ID, CAST(l_partkey AS VARCHAR) AS ITEM_ID, l_quantity AS OUTCOME,
       l_tax, l_returnflag, l_linestatus
FROM lineitem""")
def q_transform_select(spark, sf):
    """T9 + R21: long contract plus regex feature selection (other columns dropped at the scan)."""
    df, _ = transform(T.table(spark, sf, "lineitem"), "long_interactions", user_id_column="l_orderkey",
                      item_id_column="l_partkey", outcome_column="l_quantity",
                      feature_pattern=r"l_(tax|returnflag|linestatus)", with_report=False)
    return df


@register("holdout_report_events", f"""
WITH {V.EV},
r AS (SELECT *, row_number() OVER (PARTITION BY USER_ID ORDER BY "TIMESTAMP" DESC, event_id DESC) AS rn,
             count(*) OVER (PARTITION BY USER_ID) AS n FROM ev),
s AS (SELECT *, CASE WHEN n > 65 AND rn <= 5 THEN 'test' WHEN n > 65 AND rn <= 65 THEN 'valid' ELSE 'train' END
             AS split FROM r),
u AS (SELECT USER_ID, bool_and(split = 'train') AS train_only, count(*) AS n_rows FROM s GROUP BY USER_ID)
SELECT count(*) AS n_users, CAST(count_if(train_only) AS BIGINT) AS n_users_without_holdout,
       CAST(count_if(NOT train_only) AS BIGINT) AS n_users_with_holdout, max(n_rows) AS max_rows_per_user
FROM u""")
def q_holdout(spark, sf):
    """X2 + X7/X8: who got a hold-out (users with at most 65 events keep all of them in train)."""
    s = sp.leave_last_n_per_user(T.events(spark, sf), n_valid=60, n_test=5, tiebreak=["event_id"])
    rep = sp.holdout_report(s)
    mx = s.groupBy("USER_ID").count().agg(F.max("count").alias("max_rows_per_user"))
    return rep.crossJoin(F.broadcast(mx))   # one row beside one row
