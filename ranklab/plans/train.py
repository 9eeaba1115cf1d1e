"""Train driver (M3, M7, M13, M14): one call per contract, one handle that scores.

``train(bundle)`` takes the contract's default method unless given one, joins the bundle's user and item features where the scorer uses
them, dispatches on recommender and scorer type, and returns a ``Trained`` handle whose ``scores(frame)`` fits the evaluation driver.
"""

from __future__ import annotations

import dataclasses
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklab.operators import boosting as bo
from ranklab.operators import learners as ln
from ranklab.operators import scoring as sc
from ranklab.operators import sparse as spw
from ranklab.plans.bundle import Bundle, join_item_features, join_user_features
from ranklab.plans.evaluate import Scores, check_scorer_config
from ranklab.plans.methods import AUTO_SWEEPS
from ranklab.session import materialize
from ranklab.sources import registry

KEYS = ("USER_ID", "ITEM_ID", "OUTCOME", "TIMESTAMP", "PROPENSITY")
#: Kinds that rank items and give no score of a pair.
RANKERS = ("transitions", "discriminant")


def with_features(frame: DataFrame, bundle: Bundle) -> DataFrame:
    """Rows joined with the bundle's user and item features."""
    if bundle.users is not None and "USER_ID" in frame.columns:
        frame = join_user_features(frame, bundle.users)
    if bundle.items is not None and "ITEM_ID" in frame.columns:
        frame = join_item_features(frame, bundle.items)
    return frame


def feature_columns(frame: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns: what is neither a key, a target nor an extra reward."""
    used = [f for f in frame.schema.fields if f.name not in KEYS and not f.name.startswith(("ITEM_", "OUTCOME_", "SESSION_"))]
    return ([f.name for f in used if isinstance(f.dataType, (T.NumericType, T.BooleanType))],
            [f.name for f in used if isinstance(f.dataType, T.StringType)])


@dataclasses.dataclass
class Trained:
    """A fitted method: config, model, seconds, and how it scores."""
    model_id: str
    config: dict
    kind: str
    model: object
    bundle: Bundle
    numeric: list
    categorical: list
    train_seconds: float = 0.0
    metrics: dict = dataclasses.field(default_factory=dict)

    def pair_scores(self, frame: DataFrame) -> DataFrame:
        """(USER_ID, ITEM_ID, score) of the frame's pairs (of every target or class for per-target models)."""
        kind, m = self.kind, self.model
        if kind == "als":
            return ln.als_pair_scores(m, frame)
        if kind == "multioutput":
            s = ln.score_multioutput(m, frame)
            return s.select("USER_ID", F.regexp_replace("target", "^ITEM_", "").alias("ITEM_ID"), "score")
        if kind == "multiclass":
            classes = m.stages[0].labels
            p = m.transform(frame).select("USER_ID", F.posexplode(ln.vector_to_array("probability")).alias("_c", "score"))
            return p.select("USER_ID", F.array(*[F.lit(c) for c in classes])[F.col("_c")].alias("ITEM_ID"), "score")
        if kind in RANKERS:
            raise ValueError("sequence models and discriminants rank items; use top_k")
        rows = with_features(frame, self.bundle)
        if kind == "independent":
            rows = bo.score_by_item(m, rows) if isinstance(m, tuple) else ln.score_independent(m, rows, self.numeric)
            rows = rows.filter("score is not null")
        elif kind == "uplift":
            rows = ln.score_uplift(m, rows)
        elif kind == "goal":
            rows = ln.score_with_goals(m["model"], rows, m["goals"])
        else:
            rows = ln.score_pairs(m, rows, self.config.get("task", "classification"))
        return rows.select("USER_ID", "ITEM_ID", "score").groupBy("USER_ID", "ITEM_ID").agg(F.max("score").alias("score"))

    def top_k(self, frame: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        """(USER_ID, ITEM_ID, score, rank): the best k of each user of the frame."""
        if self.kind == "als":
            return ln.als_top_k(self.model, frame, k)
        if self.kind == "transitions":
            order = int(self.config.get("params", {}).get("order", 1))
            h = histories(frame, self.config)
            return sc.next_items_by_context(h, self.model, order, k) if order > 1 else sc.next_items(h, self.model, k, order_cols=("TIMESTAMP",))
        if self.kind == "discriminant":
            model = self.model if candidates is None else sc.restrict_candidates(self.model, candidates, scorer_type="multiclass")
            return spw.discriminant_top_k(model, with_features(frame, self.bundle), self.numeric, k)
        s = self.pair_scores(frame)
        if candidates is not None:
            s = sc.restrict_candidates(s, candidates, scorer_type=self.config.get("scorer_type", "universal"))
        return sc.top_k_per_user(s, k)

    def scores(self, frame: DataFrame, k: int = 10) -> Scores:
        """What the evaluation driver needs for a slice; pair scores only where the model scores pairs."""
        pairs = None if self.kind in RANKERS else self.pair_scores(frame)
        return Scores(topk=self.top_k(frame, k), pair_scores=pairs)


def histories(frame: DataFrame, config: dict) -> DataFrame:
    """Sequence contracts as rows (USER_ID, ITEM_ID, TIMESTAMP = position[, SESSION_ID]); long rows stay as they are."""
    if "ITEM_SEQUENCE" in frame.columns:
        return frame.select("USER_ID", F.posexplode("ITEM_SEQUENCE").alias("TIMESTAMP", "ITEM_ID"))
    if "SESSION_SEQUENCES" in frame.columns:
        s = frame.select("USER_ID", F.posexplode("SESSION_SEQUENCES").alias("SESSION_ID", "_items"))
        s = s.select("USER_ID", "SESSION_ID", F.posexplode("_items").alias("_i", "ITEM_ID"))
        return s.select("USER_ID", "SESSION_ID", F.struct("SESSION_ID", "_i").alias("TIMESTAMP"), "ITEM_ID")
    return frame


def default_method(contract: str) -> dict:
    methods = AUTO_SWEEPS.get(contract) or []
    if not methods:
        raise ValueError(f"contract {contract!r} has features only; there is nothing to train")
    return methods[0]


def train(bundle: Bundle, method: dict | None = None, scorer_config: dict | None = None) -> Trained:
    """Fit ``method`` (the contract's default without one) on the bundle's training rows."""
    method = method or default_method(bundle.contract)
    scorer, recommender = method.get("scorer_type", "universal"), method.get("recommender_type", "ranking")
    check_scorer_config(scorer, scorer_config)
    params, task, est = method.get("params", {}), method.get("task", "classification"), method.get("estimator", "gbt")
    t0, rows = time.time(), bundle.interactions
    numeric: list = []
    categorical: list = []
    if scorer in ("sequential", "hierarchical"):
        h = histories(rows, method)
        session = "SESSION_ID" if "SESSION_ID" in h.columns else None
        kind, order = "transitions", int(params.get("order", 1))
        if order > 1 and session:
            raise ValueError("contexts of several events and sessions do not go together")
        model = materialize(sc.context_counts(h, order), "contexts") if order > 1 else materialize(sc.transition_scores(h, session_col=session, max_len=params.get("max_len"),
                                                 across_weight=params.get("across_weight", 0.3) if session else 0.0), "transitions")
    elif est == "als":
        kind, model = "als", ln.fit_als(rows, rank=int(params.get("n_factors", 16)), max_iter=int(params.get("epochs", 5)), reg=float(params.get("reg", 0.1)))
    else:
        rows = with_features(rows, bundle)
        numeric, categorical = feature_columns(rows)
        if scorer == "multioutput":
            targets = [c for c in rows.columns if c.startswith("ITEM_") and c != "ITEM_ID"]
            kind, model = "multioutput", ln.fit_multioutput(rows, targets, numeric, categorical, task, params,
                                                            on_degenerate=(scorer_config or {}).get("on_degenerate_target", "constant"))
        elif scorer == "multiclass" and est == "discriminant":
            kind, model = "discriminant", materialize(spw.fit_discriminant(rows, numeric), "discriminant")
        elif scorer == "multiclass":
            kind, model = "multiclass", ln.fit_multiclass(rows, numeric, categorical)
        elif recommender == "uplift":
            control = params.get("control_item_id", "control")
            kind, model = "uplift", ln.fit_uplift(rows.withColumn("_treated", F.col("ITEM_ID") != F.lit(str(control))), numeric, "_treated",
                                                  learner=params.get("learner", "t"), categorical=categorical, params=params)
        elif recommender == "gcsl":
            goals = [c for c in rows.columns if c.startswith("OUTCOME_")]
            from ranklab.operators import stats as st
            kind, model = "goal", {"model": ln.fit_goal_conditioned(rows, numeric, goals, params=params, categorical=categorical), "goals": st.goal_values(rows, goals, "mean_scalarization") if goals else {}}
        elif scorer == "independent":
            kind = "independent"       # boosted trees, or logistic regressions, of every item
            model = bo.fit_by_item(rows, numeric, categorical=categorical, logistic=task == "classification", **ln.tree_params(params)) if est == "gbt" \
                else ln.independent_classifiers(rows, numeric)
        else:
            kind, model = "pipeline", ln.fit_universal(rows, numeric, categorical, est, task, params=params)
    return Trained(method.get("short_name", est), method, kind, model, bundle, numeric, categorical, time.time() - t0)


def save_trained(spark, root: str, name: str, handle: Trained, tags=()) -> str:
    """A trained method of any kind, with its config, metrics and the columns it scores with."""
    values = {k: float(v) for k, v in handle.metrics.items() if v is not None}
    return registry.save_model(spark, root, name, handle.model, handle.kind, handle.config, values, tags,
                               {"numeric": handle.numeric, "categorical": handle.categorical})


def load_trained(spark, root: str, name: str, bundle: Bundle) -> Trained:
    """A saved method as a handle that scores frames of ``bundle``'s contract."""
    model, meta = registry.load_model(spark, root, name)
    cols = json.loads(meta["features"])
    return Trained(name, json.loads(meta["config"]), meta["kind"], model, bundle, cols.get("numeric", []), cols.get("categorical", []),
                   metrics=dict(meta["metrics"] or {}))
