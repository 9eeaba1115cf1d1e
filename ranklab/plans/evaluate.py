"""Evaluation driver.

``evaluate`` turns a model's score sources and a logged table into one long
results table ``(model_id, metric, k, label, value)``. A ``ScoreCache`` keeps score tables
for several calls (E23).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.operators import metrics as mt
from ranklab.operators import offpolicy as op
from ranklab.operators.validate import check_binary_rewards, require_per_label_decision

# Evaluators and metric names.
EVALUATORS = ("simple", "replay_match", "IPS", "DR", "direct_method", "SNIPS", "policy_weighted")
RANKING_METRICS = ("NDCG_at_k", "MAP_at_k", "MRR_at_k", "precision_at_k", "recall_at_k", "average_reward_at_k")
NON_K_METRICS = ("roc_auc", "pr_auc", "rmse", "mae", "expected_reward")
SIMPLE_ONLY = ("rmse", "mae")
CLASSIFICATION = ("roc_auc", "pr_auc")
COUNTERFACTUAL = ("IPS", "DR", "SNIPS", "direct_method", "policy_weighted")

# Accepted scorer_config keys per scorer type (M8).
SCORER_CONFIG_KEYS = {"multioutput": ("on_degenerate_target",)}

_INTERNAL = {"NDCG_at_k": "ndcg", "MAP_at_k": "map", "MRR_at_k": "mrr", "precision_at_k": "precision",
             "recall_at_k": "recall"}


class EvaluatorMetricMismatch(ValueError):
    pass


def check_scorer_config(scorer_type: str, scorer_config: dict | None) -> None:
    """M8: reject scorer_config keys the scorer does not accept."""
    allowed = set(SCORER_CONFIG_KEYS.get(scorer_type, ()))
    unknown = set(scorer_config or {}) - allowed
    if unknown:
        raise ValueError(f"scorer_type={scorer_type!r} does not accept scorer_config keys {sorted(unknown)}; "
                         f"accepted: {sorted(allowed) or '(none)'}")


def check_request(evaluator: str, metrics: Sequence[str], contract: str = "long_interactions",
                  per_label: bool | None = False) -> None:
    """E11 + E12: reject unsupported evaluator / metric / per_label combinations."""
    if evaluator not in EVALUATORS:
        raise ValueError(f"unknown evaluator {evaluator!r}; valid: {EVALUATORS}")
    bad = [m for m in metrics if m not in RANKING_METRICS + NON_K_METRICS]
    if bad:
        raise ValueError(f"unknown metrics {bad}")
    so = sorted(set(metrics) & set(SIMPLE_ONLY))
    if so and evaluator != "simple":
        raise EvaluatorMetricMismatch(f"metrics {so} only compose with evaluator 'simple'")
    cl = sorted(set(metrics) & set(CLASSIFICATION))
    if cl and evaluator in COUNTERFACTUAL:
        raise EvaluatorMetricMismatch(f"classification metrics {cl} are not compatible with evaluator "
                                      f"{evaluator!r}; use 'simple' or 'replay_match'")
    if per_label and contract == "wide_multioutput" and set(metrics) & set(RANKING_METRICS):
        raise ValueError("per_label=True applies to classification/regression metrics, not ranking metrics")


def pick_eval_frame(valid: DataFrame | None, train: DataFrame) -> tuple[DataFrame, str]:
    """Score the validation slice when there is one, else fall back to train."""
    if valid is not None and not valid.isEmpty():
        return valid, "valid"
    return train, "train"


@dataclasses.dataclass
class Scores:
    """What a fitted model can provide; any may be None.

    topk: (ITEM_ID, rank) or (USER_ID, ITEM_ID, rank) up to max(k);
    pair_scores: (USER_ID, ITEM_ID, score) for logged pairs;
    item_scores: (ITEM_ID, score) of a user-independent scorer.
    """
    topk: DataFrame | None = None
    pair_scores: DataFrame | None = None
    item_scores: DataFrame | None = None


class ScoreCache:
    """Score tables persisted for several evaluations, keyed by model, kind and *plan*, so a deeper
    list or another bundle is never served from an older one. A context manager: leaving it frees everything."""

    def __init__(self):
        self._held: dict = {}

    def get(self, model_id: str, kind: str, df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        key = (model_id, kind, df.semanticHash())
        if key not in self._held:
            self._held[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
        return self._held[key]

    def release(self, model_id: str | None = None) -> None:
        for key in [k for k in self._held if model_id in (None, k[0])]:
            self._held.pop(key).unpersist()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.release()


REGIMES = ("per_row", "per_user", "wide")


def regime_of(contract: str, scorer_type: str | None = None) -> str:
    """How a contract's rows become logged instances."""
    if contract == "wide_multioutput":
        return "wide"
    return "per_user" if scorer_type in ("sequential", "hierarchical") else "per_row"


def logged_table(frame: DataFrame, contract: str, scorer_type: str | None = None) -> tuple[DataFrame, bool]:
    """The logged table of an evaluation slice, and whether each instance has one item.

    A multiclass row logs its class with reward 1; a row of any other long contract logs its OUTCOME.
    """
    regime = regime_of(contract, scorer_type)
    if regime == "wide":
        return mt.logged_wide(frame, [c for c in frame.columns if c.startswith("ITEM_") and c != "ITEM_ID"]), False
    if "OUTCOME" not in frame.columns:
        frame = frame.withColumn("OUTCOME", F.lit(1.0))
    if regime == "per_user":
        return mt.logged_per_user(frame), False
    keep = [c for c in ("PROPENSITY",) if c in frame.columns]
    return frame.select(F.monotonically_increasing_id().cast("string").alias("INSTANCE"), "USER_ID", "ITEM_ID",
                        F.col("OUTCOME").cast("double").alias("REWARD"), *keep), True


def _pair_metrics(logged: DataFrame, scores: Scores, metrics: Sequence[str], per_label: bool) -> list[DataFrame]:
    """Classification and regression metrics on the logged pairs that have a score; both AUCs from one histogram, both
    errors from one aggregation. With ``per_label``, a row a label (item) and their mean as the scalar."""
    table, on = (scores.pair_scores, ["USER_ID", "ITEM_ID"]) if scores.pair_scores is not None else (scores.item_scores, ["ITEM_ID"])
    if table is None:
        raise ValueError(f"metrics {list(metrics)} need pair scores or item scores")
    j = logged.join(table.select(*on, "score"), on)
    group = ["ITEM_ID"] if per_label else []
    parts = []
    for names, compute in ((("roc_auc", "pr_auc"), mt.classification_metrics), (("rmse", "mae"), mt.regression_metrics)):
        wanted = [m for m in names if m in metrics]
        if not wanted:
            continue
        table = compute(j, "REWARD", "score", group)
        label = F.col("ITEM_ID") if per_label else F.lit(None).cast("string")
        rows = table.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), label.alias("label"), F.col(m).alias("value"))
                                                for m in wanted])).alias("x")).select("x.*")
        parts.append(rows)
        if per_label:
            parts.append(table.agg(*[F.avg(m).alias(m) for m in wanted]).select(F.explode(F.array(*[
                F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("label"), F.col(m).alias("value"))
                for m in wanted])).alias("x")).select("x.*"))
    return [p.withColumn("k", F.lit(None).cast("long")) for p in parts]


def coverage(logged: DataFrame, scores: Scores) -> DataFrame:
    """(n_logged, n_scored): logged rows, and those whose pair (or item) has a score; cold ones are left out of pair metrics."""
    table, on = (scores.pair_scores, ["USER_ID", "ITEM_ID"]) if scores.pair_scores is not None else (scores.item_scores, ["ITEM_ID"])
    known = table.select(*on).distinct().withColumn("_known", F.lit(1))
    return logged.join(known, on, "left").agg(F.count(F.lit(1)).alias("n_logged"), F.count("_known").alias("n_scored"))


def evaluate(model_id: str, scores: Scores, logged: DataFrame | None = None, evaluator: str = "simple",
             metrics: Sequence[str] = ("NDCG_at_k", "MAP_at_k", "precision_at_k", "recall_at_k"),
             k_values: Sequence[int] = (10,), contract: str = "long_interactions", per_label: bool | None = False,
             epsilon: float = 0.1, single_item_instances: bool = False, frame: DataFrame | None = None,
             scorer_type: str | None = None, cache: ScoreCache | None = None, binary_rewards: bool = False) -> DataFrame:
    """(model_id, metric, k, label, value) for every requested metric, at every k where it has one.

    ``logged`` is (INSTANCE, USER_ID, ITEM_ID, REWARD[, PROPENSITY]); without it, it is built from the evaluation slice ``frame`` by the
    contract's regime. Off-policy evaluators estimate the same metrics under the policy (see ``off_policy_metrics``).
    A request that cannot be answered raises; none is skipped. ``per_label=None`` leaves the choice open and is refused where it matters
    (V7); ``binary_rewards`` refuses rewards other than 0 and 1 (V6).
    """
    check_request(evaluator, metrics, contract, per_label)
    require_per_label_decision(contract, "classification" if set(metrics) & set(CLASSIFICATION) else "other", per_label)
    if logged is None:
        if frame is None:
            raise ValueError("pass logged, or frame (the evaluation slice) to build it from")
        logged, single_item_instances = logged_table(frame, contract, scorer_type)
    if binary_rewards:
        check_binary_rewards(logged)
    if cache is not None:
        scores = Scores(**{k: cache.get(model_id, k, getattr(scores, k)) for k in ("topk", "pair_scores", "item_scores")})
    at_k = [m for m in metrics if m in RANKING_METRICS]
    if (at_k or evaluator != "simple") and scores.topk is None:
        raise ValueError(f"evaluator {evaluator!r} with metrics {list(metrics)} needs the model's top-k list")
    pair = [m for m in metrics if m in CLASSIFICATION + SIMPLE_ONLY]
    parts = []
    if evaluator == "simple":
        rk = [_INTERNAL[m] for m in at_k if m in _INTERNAL]
        if rk:
            res = mt.ranking_metrics(logged, scores.topk, k_values, single_item_instances)
            parts.append(res.filter(F.col("metric").isin(rk)))
        if "average_reward_at_k" in metrics:
            parts.append(mt.average_reward_at_k(logged, scores.topk, k_values, single_item_instances))
        if "expected_reward" in metrics:
            if scores.item_scores is not None:
                parts.append(mt.expected_reward_global(logged, scores.item_scores))
            elif scores.pair_scores is not None:
                parts.append(mt.expected_reward_pairs(logged, scores.pair_scores))
            else:
                raise ValueError("expected_reward needs item scores or pair scores")
    else:
        ranked = [m for m in metrics if m not in pair]
        if ranked:
            q = scores.pair_scores if scores.pair_scores is not None else scores.item_scores
            res = op.off_policy_metrics(logged, scores.topk, evaluator, ranked, k_values, epsilon,
                                        q.withColumnRenamed("score", "q") if q is not None else None)
            short = F.create_map(*[F.lit(x) for kv in {**_INTERNAL, "average_reward_at_k": "average_reward"}.items() for x in kv])
            parts.append(res.withColumn("metric", F.coalesce(short[F.col("metric")], F.col("metric"))))
        if pair:  # replay: the rows whose logged action the policy would take
            top = scores.topk.filter(F.col("rank") == 1).drop("rank", "score")
            logged = logged.join(top, [c for c in ("USER_ID", "ITEM_ID") if c in top.columns], "left_semi")
    if pair:
        parts += _pair_metrics(logged, scores, pair, bool(per_label))
    none = F.lit(None).cast("string").alias("label")
    parts = [p.select("metric", "k", F.col("label") if "label" in p.columns else none, F.col("value").cast("double").alias("value"))
             for p in parts]
    return reduce(DataFrame.unionByName, parts).select(F.lit(model_id).alias("model_id"), "metric", "k", "label", "value")
