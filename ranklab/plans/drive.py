"""The sweep driver over a bundle: guards, capability, advice on request, then train, evaluate and save per method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.operators import profile as pf
from ranklab.operators.validate import require_per_label_decision
from ranklab.plans import evaluate as ev
from ranklab.plans import methods as me
from ranklab.plans import sweep as sw
from ranklab.plans.bundle import Bundle
from ranklab.plans.train import RANKERS, Trained, histories, save_trained, train

SEQUENCE_CONTRACTS = ("prebuilt_sequences", "sessions")


def last_events(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(earlier events, each user's last event) of a sequence contract's histories."""
    h = histories(frame, {})
    newest = Window.partitionBy("USER_ID").orderBy(F.col("TIMESTAMP").desc())   # by contract one array a user
    h = h.withColumn("_back", F.row_number().over(newest))
    return h.filter("_back > 1").drop("_back"), h.filter("_back = 1").drop("_back")


def evaluate_trained(handle: Trained, frame: DataFrame, contract: str, metrics: Sequence[str], k_values: Sequence[int],
                     per_label: bool | None = False) -> dict:
    """{metric@k or metric: value} of a trained method on an evaluation slice.

    Sequence methods rank next items, so they answer the ranking metrics and refuse others; on sequence contracts each user's last event is
    what they predict.
    """
    scorer = handle.config.get("scorer_type")
    if handle.kind in RANKERS and (other := [m for m in metrics if m not in ev.RANKING_METRICS]):
        raise ValueError(f"{handle.model_id} ranks next items and has no scores for {', '.join(other)}; ask for {', '.join(sorted(ev.RANKING_METRICS))}")
    if contract in SEQUENCE_CONTRACTS:
        frame, logged = last_events(frame)
        logged = logged.select(F.col("USER_ID").alias("INSTANCE"), "USER_ID", "ITEM_ID", F.lit(1.0).alias("REWARD"))
        res = ev.evaluate(handle.model_id, handle.scores(frame, max(k_values)), logged, metrics=metrics, k_values=k_values,
                          single_item_instances=True)
    else:
        res = ev.evaluate(handle.model_id, handle.scores(frame, max(k_values)), metrics=metrics, k_values=k_values, contract=contract,
                          per_label=per_label, frame=frame, scorer_type=scorer)
    out = {}
    for r in res.collect():   # a row a metric, k and label
        key = r["metric"] if r["k"] is None else f"{r['metric']}@{r['k']}"
        out[key if r["label"] is None else f"{key}_per_label_{r['label']}"] = r["value"]
    return out


def sweep_bundle(bundle: Bundle, request="auto", primary_metric: str = "NDCG@10",
                 metrics: Sequence[str] = ("NDCG_at_k", "MAP_at_k", "precision_at_k", "recall_at_k"), k_values: Sequence[int] = (10,),
                 per_label: bool | None = False, large_ok: bool | None = None, advised: bool = False, bundle_id: str | None = None,
                 cache: dict | None = None, keep_top_k: int | None = None, models_root: str | None = None,
                 failures_path: str | None = None, results_path: str | None = None, max_workers: int = 2) -> dict:
    """Train and evaluate a contract's methods on a bundle; returns rows, dropped methods and the slice that was scored.

    Large tables and multi-target metrics need explicit decisions (P12, V7). ``advised`` filters and resizes the methods by the data profile; without
    it they run as given. Winners (``keep_top_k``) are saved below ``models_root``; failed methods go to ``failures_path`` with their category;
    results go to ``results_path``, whose finished configs are not run again.
    """
    spark, contract = bundle.interactions.sparkSession, bundle.contract
    kind = "classification" if set(metrics) & set(ev.CLASSIFICATION) else "other"
    require_per_label_decision(contract, kind, per_label)
    methods = me.resolve(contract, request, spark=spark)
    bad = me.incompatible(me.as_table(spark, methods)).collect()
    if bad:
        raise ValueError("; ".join(f"{r['short_name']}: {r['reason']}" for r in bad))
    n_rows = bundle.interactions.count()
    pf.require_decision_for_large(n_rows, large_ok)
    dropped: list = []
    if advised:
        profile = pf.bundle_profile(bundle.interactions, bundle.users, bundle.items)
        methods, dropped = me.apply_advice(methods, me.advice(me.as_table(spark, methods), profile))
    name = bundle_id or f"bundle-{bundle.version}"
    if results_path:
        methods = sw.pending_methods(spark, methods, name, results_path)
    frame, part = ev.pick_eval_frame(bundle.valid, bundle.interactions)

    def fit_eval(m):
        handle = train(bundle, m)
        handle.metrics = evaluate_trained(handle, frame, contract, metrics, k_values, per_label)
        return handle.metrics, handle

    def save(row, handle):
        return None if models_root is None else save_trained(spark, models_root, row["model_id"], handle)

    rows = sw.sweep(methods, fit_eval, name, primary_metric, cache, max_workers, keep_top_k, save=save) if methods else []
    if failures_path and any(r["status"] == "error" for r in rows):
        sw.record_failures(spark, rows, failures_path)
    if results_path and rows:
        sw.record_results(spark, rows, name, results_path)
    return {"rows": rows, "dropped": dropped, "scored_slice": part, "n_rows": n_rows}
