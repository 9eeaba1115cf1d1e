"""Registered checks: ingest, renames, rules of targets and metrics, failure logs and audits (S3, S7, T2, T8, T10, R11, M7, L2-L4, L14,
D1, D3-D5). Their SQL states the rules anew, without the implementation's patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklab.operators import audit as au
from ranklab.operators import diagnose as dg
from ranklab.operators import leaderboard as lb
from ranklab.operators import learners as ln
from ranklab.operators import reshape as rs
from ranklab.operators import split as sp
from ranklab.plans import sql_views as V
from ranklab.plans import sweep as sw
from ranklab.plans.registering import registry
from ranklab.plans.transform import transform
from ranklab.session import ensure_checkpoint_dir
from ranklab.sources import ingest
from ranklab.sources import tables as T

QUERIES, ORACLE, register = registry()


# ------------------------------------------------------------------ sources and renames

@register("ingest_renamed_orders", """
SELECT CAST(o_custkey AS VARCHAR) AS USER_ID, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey""")
def q_ingest(spark, sf):
    """Read, rename by mapping, ids as text."""
    o = ingest.read_interactions(spark, f"{sf}/orders.parquet", {"o_custkey": "USER_ID", "o_totalprice": "OUTCOME"}, fmt="parquet")
    return o.groupBy("USER_ID").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("OUTCOME"), 2).alias("total"))


@register("written_split_sizes_orders", """
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT 'train' AS split, CAST(n - 2 * (n // 10) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_out_of_order FROM n
UNION ALL SELECT 'valid', CAST(n // 10 AS BIGINT), 0 FROM n UNION ALL SELECT 'test', CAST(n // 10 AS BIGINT), 0 FROM n""")
def q_written_splits(spark, sf):
    """S7 + X1: orders cut by their date alone (many ties, no tiebreak), written by split and read back; no row lies before
    an earlier split's last date."""
    import uuid
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = sp.temporal_split(o, 0.1, 0.1, "o_orderdate")
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    back = spark.read.parquet(ingest.write_splits(s, path))
    ends = {r["split"]: r["m"] for r in back.groupBy("split").agg(F.max("o_orderdate").alias("m")).collect()}   # three rows
    floor = F.when(F.col("split") == "valid", F.lit(ends["train"])).when(F.col("split") == "test", F.lit(ends["valid"]))
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o_orderdate") < floor).alias("n_out_of_order"))


@register("bulk_renamed_labels", "SELECT doc_id, quality AS ITEM_quality, toxic AS ITEM_toxic FROM labels")
def q_bulk_rename(spark, sf):
    return rs.bulk_rename_targets(T.table(spark, sf, "labels"), "(quality|toxic)")


@register("null_columns_orders", """
SELECT 'empty_int,empty_text' AS dropped, count(*) AS n_rows, round(sum(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice END), 2) AS sometimes FROM orders""")
def q_null_columns(spark, sf):
    """T8 with all-null and partly null columns."""
    o = T.table(spark, sf, "orders").withColumns({"empty_int": F.lit(None).cast("int"), "empty_text": F.lit(None).cast("string"),
                                                  "sometimes": F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice"))})
    left, dropped = rs.drop_null_columns(o)
    return left.agg(F.lit(",".join(sorted(dropped))).alias("dropped"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("sometimes"), 2).alias("sometimes"))


@register("multiclass_drops_outcome", f"""
WITH {V.PRIO} SELECT USER_ID, ITEM_ID FROM prio QUALIFY row_number() OVER (PARTITION BY USER_ID ORDER BY o_orderkey) = 1""")
def q_multiclass(spark, sf):
    """T10 + T6: a source with an OUTCOME becomes one class a user."""
    p = T.priorities(spark, sf).select("USER_ID", "ITEM_ID", "OUTCOME", "o_orderkey")
    out, _ = transform(p, "multiclass", order_cols=["o_orderkey"], with_report=False)
    if "OUTCOME" in out.columns:
        raise ValueError("OUTCOME should be gone")
    return out.select("USER_ID", "ITEM_ID")


@register("degenerate_targets_customers", """
SELECT 'ITEM_any' AS dropped, CAST(sum(urgent) AS BIGINT) AS urgent, CAST(sum(big) AS BIGINT) AS big, count(*) AS n_users FROM (
  SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent, max(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS big
  FROM orders GROUP BY o_custkey)""")
def q_degenerate(spark, sf):
    """The target that never varies is dropped and reported."""
    o = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("USER_ID")).agg(
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("ITEM_urgent"),
        F.max((F.col("o_totalprice") > 300000).cast("int")).alias("ITEM_big"), F.lit(1).alias("ITEM_any"))
    out, report = transform(o, "wide_multioutput", with_report=False)
    dropped = ",".join(d["column"] for d in report["dropped_targets"])
    return out.agg(F.lit(dropped).alias("dropped"), F.sum("ITEM_urgent").cast("long").alias("urgent"), F.sum("ITEM_big").cast("long").alias("big"),
                   F.count(F.lit(1)).alias("n_users"))


@register("constant_heads_labels", f"""
WITH {V.LAB} SELECT target, count(*) AS n, min(v) AS lowest, max(v) AS highest FROM lab, (VALUES ('ITEM_one', CAST(1 AS DOUBLE)), ('ITEM_zero', CAST(0 AS DOUBLE)),
  ('ITEM_none', CAST(0 AS DOUBLE))) t(target, v) GROUP BY target""")
def q_constant_heads(spark, sf):
    """M7: targets of one value (or none) are found and predicted as constants."""
    lab = T.labelled_docs(spark, sf).withColumns({"ITEM_one": F.when(F.col("n_chars") % 2 == 0, 1.0), "ITEM_zero": F.lit(0.0), "ITEM_none": F.lit(None).cast("double")})
    fitted = ln.fit_multioutput(lab, ["ITEM_one", "ITEM_zero", "ITEM_none"], ["n_chars"])
    return ln.score_multioutput(fitted, lab).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


# ------------------------------------------------------------------ metric names and sweep order

_SPEC_SQL = """CASE c_nationkey % 6 WHEN 0 THEN concat('NDCG@', c_nationkey) WHEN 1 THEN concat('recall_at_', c_nationkey) WHEN 2 THEN 'rmse'
  WHEN 3 THEN concat('MAP_at_k@', c_nationkey) WHEN 4 THEN concat('precision_', c_nationkey) ELSE 'LogLoss' END"""


@register("metric_names_customers", f"""
SELECT {_SPEC_SQL} AS spec,
  CASE c_nationkey % 6 WHEN 0 THEN 'NDCG' WHEN 1 THEN 'recall_at_k' WHEN 2 THEN 'rmse' WHEN 3 THEN 'MAP_at_k' WHEN 4 THEN 'precision' ELSE 'LogLoss' END AS name,
  CAST(CASE WHEN c_nationkey % 6 IN (2, 5) THEN 10 ELSE c_nationkey END AS BIGINT) AS k, c_nationkey % 6 NOT IN (2, 5) AS higher, count(*) AS n
FROM customer GROUP BY ALL""")
def q_metric_names(spark, sf):
    """L2 + L4 over a column of spellings."""
    c = T.table(spark, sf, "customer").select(F.expr(_SPEC_SQL).alias("spec"))
    name, k = lb.metric_spec_columns(F.col("spec"))
    return c.groupBy("spec").agg(F.count(F.lit(1)).alias("n")).select("spec", name.alias("name"), k.alias("k"), lb.direction_column(F.col("spec")).alias("higher"), "n")


_RUNS_SQL = """SELECT concat('m', c_nationkey) AS model_id, CASE c_nationkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'cached' ELSE 'ok' END AS status,
  CASE WHEN c_nationkey % 4 = 0 OR c_nationkey % 5 = 0 THEN NULL ELSE round(avg(c_acctbal), 4) END AS value FROM customer GROUP BY c_nationkey"""


@register("sweep_order_customers", f"""
WITH r AS ({_RUNS_SQL})
SELECT model_id, status, CAST(row_number() OVER (ORDER BY CASE WHEN status = 'error' THEN 1 ELSE 0 END, value ASC NULLS LAST, model_id) AS BIGINT) AS position,
  row_number() OVER (ORDER BY CASE WHEN status = 'error' THEN 1 ELSE 0 END, value ASC NULLS LAST, model_id) = 1 AS is_winner FROM r""")
def q_sweep_order(spark, sf):
    """L3 in ascending direction: failures last, missing values before them."""
    T.table(spark, sf, "customer").createOrReplaceTempView("customer")
    r = lb.sweep_order(spark.sql(_RUNS_SQL), "value", higher=False)
    return r.select("model_id", "status", F.col("position").cast("long").alias("position"), "is_winner")


# ------------------------------------------------------------------ failure logs

_FAILURE_SQL = """SELECT concat('m', o_custkey % 50) AS model_id, CAST(o_orderkey AS DOUBLE) AS ts, 'ValueError' AS error_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'REWARD must be binary 0/1; 7 rows are not' WHEN '2-HIGH' THEN 'validation split is empty'
    WHEN '3-MEDIUM' THEN 'java.lang.OutOfMemoryError: heap' WHEN '4-NOT SPECIFIED' THEN 'fit timed out' ELSE concat('odd failure ', o_orderkey) END AS message,
  CASE WHEN o_orderkey % 3 = 0 THEN 'retry' END AS fix FROM orders"""


def _failures(spark, sf):
    T.table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(_FAILURE_SQL)


@register("failure_categories_orders", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'non_binary_target' WHEN '2-HIGH' THEN 'degenerate_split' WHEN '3-MEDIUM' THEN 'oom'
  WHEN '4-NOT SPECIFIED' THEN 'timeout' ELSE 'unknown' END AS category, count(*) AS n, CAST(min(o_orderkey) AS DOUBLE) AS first_ts FROM orders GROUP BY 1""")
def q_categories(spark, sf):
    """D1 over a failure log."""
    return dg.classify_failures(_failures(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@register("dominant_failure_orders", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'non_binary_target' WHEN '2-HIGH' THEN 'degenerate_split' WHEN '3-MEDIUM' THEN 'oom'
  WHEN '4-NOT SPECIFIED' THEN 'timeout' ELSE 'unknown' END AS category, (SELECT count(*) FROM orders) AS n_failures
FROM orders GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1""")
def q_dominant(spark, sf):
    """The sweep's dominant category."""
    log = dg.classify_failures(_failures(spark, sf))
    return log.agg(F.lit(sw.dominant_failure(log)).alias("category"), F.count(F.lit(1)).alias("n_failures"))


@register("failure_history_orders", """
WITH f AS (SELECT concat('m', o_custkey % 50) AS model_id, o_orderkey, o_orderpriority FROM orders)
SELECT model_id, CAST(max(o_orderkey) AS DOUBLE) AS last_ts, CAST(count_if(o_orderkey % 3 = 0) AS BIGINT) AS retries, count_if(o_orderkey % 3 = 0) < 2 AS retry_allowed
FROM f GROUP BY model_id""")
def q_history(spark, sf):
    """D3: last failure and retries per model."""
    log = _failures(spark, sf)
    return au.last_failure_per_model(log).select("model_id", F.col("ts").alias("last_ts")).join(au.retries_per_model(log), "model_id").select(
        "model_id", "last_ts", "retries", "retry_allowed")


# ------------------------------------------------------------------ audits of messages that do hold links and code

_LINKS = """CASE WHEN role = 'assistant' THEN concat(text, ' See (https://site', conv_id % 3, '.example/a) and http://new.example/', turn, '.')
  WHEN conv_id % 2 = 0 THEN concat('I read https://site', conv_id % 3, '.example/a! ', text) ELSE text END"""


@register("planted_links_conversations", """
WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, min(turn) AS first_user, count(*) AS n_user FROM conversations WHERE role = 'user' GROUP BY conv_id),
o AS (SELECT conv_id, count(*) AS n_other FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
n AS (SELECT a.conv_id, count(*) AS n_assistant, sum(1 + CASE WHEN a.conv_id % 2 = 0 AND u.first_user <= a.turn THEN 0 ELSE 1 END) AS n_novel
      FROM a LEFT JOIN u USING (conv_id) GROUP BY a.conv_id)
SELECT c.conv_id, CAST(coalesce(any_value(n.n_assistant), 0) AS BIGINT) AS n_assistant_turns,
  CAST(coalesce(any_value(n.n_assistant), 0) * 2 + CASE WHEN c.conv_id % 2 = 0 THEN coalesce(any_value(o.n_other), 0) ELSE 0 END AS BIGINT) AS n_urls,
  CAST(coalesce(any_value(n.n_novel), 0) AS BIGINT) AS n_novel_urls
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id) LEFT JOIN o USING (conv_id) GROUP BY c.conv_id""")
def q_links(spark, sf):
    """D4 on messages that hold links: what the user typed before is not novel."""
    c = T.table(spark, sf, "conversations").withColumn("text", F.expr(_LINKS))
    return au.novel_url_counts(c)


_CODE = """CASE WHEN turn % 2 = 0 THEN concat(text, chr(10), '```python', chr(10), 'import os', chr(10),
    CASE conv_id % 4 WHEN 0 THEN 'import torch' WHEN 1 THEN 'from pandas import DataFrame' WHEN 2 THEN 'x = np.zeros(3)' ELSE 'from pyspark.sql import Row' END, chr(10), '```')
  ELSE concat(text, ' import notcode') END"""


@register("planted_code_conversations", """
SELECT conv_id, CAST(count_if(turn % 2 = 0) AS BIGINT) AS n_code_messages,
  CAST(CASE WHEN conv_id % 4 < 3 AND count_if(turn % 2 = 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_foreign_packages FROM conversations GROUP BY conv_id""")
def q_code(spark, sf):
    """D5 on messages that hold fenced code: imports and aliases outside the standard library and the trusted packages."""
    c = T.table(spark, sf, "conversations").withColumn("text", F.expr(_CODE))
    return au.foreign_reference_counts(c)


_LISTS = """concat(text, chr(10), '```python', chr(10), CASE conv_id % 6 WHEN 0 THEN 'import os, requests as r, json' WHEN 1 THEN 'x = 1; import torch.nn, yaml'
    WHEN 2 THEN concat('%%bash', chr(10), 'import torch') WHEN 3 THEN 'if x: import yaml, numpy.linalg, sys' WHEN 4 THEN concat('%%time', chr(10), 'from scipy import stats')
    ELSE 'import json, ranklab.plans, pyspark' END, chr(10), '```')"""


@register("planted_import_lists_conversations", """
SELECT conv_id, count(*) AS n_code_messages, CAST(CASE conv_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS n_foreign_packages
FROM conversations GROUP BY conv_id""")
def q_import_lists(spark, sf):
    """Import lists, imports after ; and :, blocks of other languages."""
    return au.foreign_reference_counts(T.table(spark, sf, "conversations").withColumn("text", F.expr(_LISTS)))


# Texts of this engine's and Spark's errors, and their category.
_CLASS_CASES = (
    ("single-class targets: ITEM_a", "multioutput_single_class_target"),
    ("fewer than 2 surviving targets after dropping single-class ones", "multioutput_all_targets_degenerate"),
    ("targets must be binary numeric 0/1 - ITEM_x", "multioutput_non_binary_target"),
    ("candidate restriction is not supported for multi-output scorers", "multioutput_item_subset_unsupported"),
    ("item features cannot join wide data", "multioutput_users_dataframe_rejected"),
    ("per_label=True applies to classification/regression metrics, not ranking metrics", "wide_bundle_eval_unsupported"),
    ("logged rewards must be binary 0/1; 4 are not", "non_binary_logged_rewards"),
    ("REWARD must be binary 0/1", "non_binary_target"),
    ("scorer_type=universal does not accept scorer_config keys [a]", "invalid_scorer_config_key"),
    ("Data type string of column c is not supported.", "object_dtype_features"),
    ("Encountered null while assembling a row with handleInvalid = error", "nan_in_features"),
    ("[CANNOT_MERGE_SCHEMAS] Failed merging schemas", "dtype_mismatch_across_files"),
    ("requirement failed: the number of features does not match", "data_shape_mismatch"),
    ("the logged items and rewards have different lengths; logged items of the same size are needed", "logged_items_shape_mismatch"),
    ("constant columns: f1", "degenerate_target_or_features"),
    ("java.lang.OutOfMemoryError: Java heap space", "oom"),
    ("ExecutorLostFailure (executor 3 exited)", "executor_lost"),
    ("something new", "unknown"),
)


@register("failure_classes_orders", "SELECT CASE o_orderkey % " + str(len(_CLASS_CASES)) + " "
          + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_CLASS_CASES)) + """ END AS category, count(*) AS n, CAST(min(o_custkey) AS BIGINT) AS first_customer
FROM orders GROUP BY 1""")
def q_failure_classes(spark, sf):
    """A log with every class of failure."""
    texts = F.array(*[F.lit(t) for t, _ in _CLASS_CASES])
    log = T.table(spark, sf, "orders").select("o_custkey", texts[(F.col("o_orderkey") % len(_CLASS_CASES)).cast("int")].alias("message"))
    return dg.classify_failures(log, type_col=None).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("o_custkey").cast("long").alias("first_customer"))
