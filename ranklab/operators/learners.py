"""Learners (M1-M10, M14, M17-M20, M22): boosted trees (``boosting``), factorization machines (``factorization``) and ``pyspark.ml``.

Every fit runs distributed. Feature building stays in the
DataFrame API: ids that ALS needs as integers are indexed with an exact
distributed prefix sum (no driver-side label array), low-cardinality
categoricals go through StringIndexer, and user/item ids for tabular models
are hashed (FeatureHasher) into a width that follows their distinct count.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.operators import boosting as bo
from ranklab.operators import factorization as fz
from ranklab.operators.scoring import catalogue_top_k
from ranklab.operators.split import cumulative_before
from ranklab.session import cut_lineage, materialize


@dataclasses.dataclass
class ModelHandle:
    """Fitted model + bookkeeping (what the reference keeps per trained model)."""
    model_id: str
    config: dict
    model: object
    train_seconds: float
    kind: str
    extras: dict = dataclasses.field(default_factory=dict)
    metrics: dict = dataclasses.field(default_factory=dict)
    tags: list = dataclasses.field(default_factory=list)


# ----------------------------------------------------------------- ids and features


def index_ids(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Dense 0-based integer index per distinct id (ordered by id), computed
    with a distributed prefix sum. Returns (id, idx)."""
    d = df.select(col).distinct().filter(F.col(col).isNotNull())
    return cumulative_before(d, [col], out=out).select(col, F.col(out).cast("int").alias(out))


def hash_width(df: DataFrame, cols: Sequence[str]) -> int:
    """Hash buckets for id columns: a power of two of at least twice their distinct values (one approximate count)."""
    if not cols:
        return 1
    n = sum(df.agg(*[F.approx_count_distinct(c) for c in cols]).first())
    return 1 << max(10, (2 * int(n)).bit_length())


def tabular_features(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                     hashed: Sequence[str] = ("USER_ID", "ITEM_ID"), num_hash_features: int | None = None,
                     out: str = "features") -> Pipeline:
    """Pipeline: one StringIndexer for all low-cardinality categoricals, FeatureHasher for
    id columns (as wide as their distinct values ask for), VectorAssembler for everything."""
    stages, cols = [], list(numeric)
    if categorical:
        indexed = [f"{c}__ix" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        cols += indexed
    if hashed:
        stages.append(FeatureHasher(inputCols=list(hashed), outputCol="_hashed", numFeatures=num_hash_features or hash_width(df, hashed),
                                    categoricalCols=list(hashed)))
        cols.append("_hashed")
    stages.append(VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def positive_probability(pred: DataFrame, out: str = "score") -> DataFrame:
    """Probability of class 1 from a Spark ML classifier output."""
    return pred.withColumn(out, vector_to_array("probability")[1])


# ----------------------------------------------------------------- M1, M2, M10: universal models


def tree_params(params: dict | None) -> dict:
    """Sizes of boosted trees from a method's parameters."""
    p = dict(params or {})
    return {"n_trees": int(p.get("n_estimators", 50)), "depth": int(p.get("max_depth", 4)), "rate": float(p.get("learning_rate", 0.1)),
            "least_rows": int(p.get("min_child_rows", 1)), "l2": float(p.get("l2", bo.L2))}


def fit_universal(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                  family: str = "gbt", task: str = "classification", label: str = "OUTCOME",
                  params: dict | None = None, hashed: Sequence[str] = ("USER_ID", "ITEM_ID"),
                  seed: int = 42) -> bo.Boosted | fz.Factorization:
    """One model over user ⊕ item ⊕ feature rows.

    family 'gbt': boosted trees on binned features (``boosting``). family 'fm': factorization machine over the ids of ``hashed`` and all
    features (``factorization``; k = embedding_dim, sweeps = epochs) - the second-order feature-interaction model that stands in for the neural families.
    """
    if family == "gbt":
        return bo.fit_boosted(train, numeric, categorical, [label], task == "classification", **tree_params(params))
    if family != "fm":
        raise ValueError(f"unknown universal family {family!r}")
    p = dict(params or {})
    return fz.fit_factorization(train, [*hashed, *categorical], numeric, label, task == "classification", k=int(p.get("embedding_dim", 8)),
                                sweeps=int(p.get("epochs", 3)), l2=float(p.get("l2", fz.L2)), seed=seed)


def score_pairs(model: bo.Boosted | fz.Factorization | PipelineModel, pairs: DataFrame, task: str = "classification") -> DataFrame:
    """Score given (user, item, features) rows - a join-driven evaluation set, not a cross product."""
    if isinstance(model, bo.Boosted):
        return bo.score_boosted(model, pairs, "_scores").withColumn("score", F.col("_scores")[0]).drop("_scores")
    if isinstance(model, fz.Factorization):
        return fz.score_factorization(model, pairs)
    pred = model.transform(pairs)
    if task == "classification":
        return positive_probability(pred)
    return pred.withColumn("score", F.col("prediction"))


# ----------------------------------------------------------------- M9: ALS


#: Blocks of users and of items that ALS deals factors between; ratings that one block holds at most where fewer blocks would do.
ALS_BLOCKS, BLOCK_RATINGS = 10, 1 << 26
#: Bytes of factors that one step may send before fewer blocks are taken.
STEP_BYTES = 1 << 31


def als_pairs(train: DataFrame, rating: str = "OUTCOME") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ratings u, i, r by dense numbers, users' numbers, items' numbers), written, for one fit or several."""
    umap = cut_lineage(index_ids(train, "USER_ID", "u"))
    imap = cut_lineage(index_ids(train, "ITEM_ID", "i"))
    data = train.join(umap, "USER_ID").join(imap, "ITEM_ID").select("u", "i", F.col(rating).cast("float").alias("r"))
    return materialize(data, "ratings"), umap, imap


def _als_blocks(users: int, items: int, ratings: int, rank: int) -> int:
    """A step of ALS sends each factor to nearly every block, so a large model gets fewer blocks, as far as their ratings fit a task."""
    sent = (users + items) * rank * 4
    return min(ALS_BLOCKS, max(STEP_BYTES // max(1, sent), -(-ratings // BLOCK_RATINGS), 3))


def fit_als(train: DataFrame, rank: int = 16, max_iter: int = 5, reg: float = 0.1, implicit: bool = True,
            alpha: float = 1.0, seed: int = 42, rating: str = "OUTCOME", pairs: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> ModelHandle:
    """Matrix factorisation with Spark's blocked ALS (no per-user Python loop,
    so the reference's 500K-user / 5M-row exclusion does not apply). ``pairs``: what ``als_pairs`` made of ``train`` for several fits."""
    t0 = time.time()
    data, umap, imap = pairs or als_pairs(train, rating)
    blocks = _als_blocks(umap.count(), imap.count(), data.count(), rank)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, implicitPrefs=implicit, alpha=alpha, userCol="u", numUserBlocks=blocks, numItemBlocks=blocks,
              itemCol="i", ratingCol="r", coldStartStrategy="drop", seed=seed, nonnegative=False)
    model = als.fit(data)
    return ModelHandle("als", {"rank": rank, "max_iter": max_iter, "reg": reg, "implicit": implicit}, model,
                       time.time() - t0, "als", {"umap": umap, "imap": imap})


def als_top_k(h: ModelHandle, users: DataFrame, k: int) -> DataFrame:
    """Top-k items per user from ALS by the blocked products of ``catalogue_top_k`` over its factors; equal scores go by the item's
    index. Unknown users are skipped (cold start). Returns (USER_ID, ITEM_ID, score, rank)."""
    umap, imap = h.extras["umap"], h.extras["imap"]
    sub = users.select("USER_ID").distinct().join(umap, "USER_ID").select("u")
    u, i = (f.select(F.col("id").cast("long").alias(c), F.col("features").alias("embedding")) for f, c in ((h.model.userFactors, "u"), (h.model.itemFactors, "i")))
    top = catalogue_top_k(u.join(sub, "u"), i, k, "u", "i")
    return top.join(umap, "u").join(imap, "i").select("USER_ID", "ITEM_ID", "score", F.col("rank").cast("long").alias("rank"))


def als_pair_scores(h: ModelHandle, pairs: DataFrame) -> DataFrame:
    """(USER_ID, ITEM_ID, score) of the pairs whose user and item ALS knows."""
    p = pairs.select("USER_ID", "ITEM_ID").distinct().join(h.extras["umap"], "USER_ID").join(h.extras["imap"], "ITEM_ID")
    return h.model.transform(p).select("USER_ID", "ITEM_ID", F.col("prediction").cast("double").alias("score"))


# ----------------------------------------------------------------- M3: independent per-item models


def independent_linear(train: DataFrame, feature: str, item_col: str = "ITEM_ID", label: str = "OUTCOME") -> DataFrame:
    """Independent scorer, one linear model per item, for any number of items:
    per-item least squares of label on one feature from built-in aggregate
    ``regr_slope``/``regr_intercept`` (one grouped aggregation, no per-item job)."""
    y, x = F.col(label).cast("double"), F.col(feature).cast("double")
    return train.groupBy(item_col).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                       F.regr_count(y, x).alias("n"))


def _newton():
    """Newton steps: the systems (hessian + ridge) d = gradient of a batch of items, given as flat arrays, solved in one call."""
    @F.pandas_udf("array<double>")
    def step(beta: pd.Series, grad: pd.Series, hess: pd.Series) -> pd.Series:
        if not len(beta):
            return pd.Series([], dtype=object)
        b, g = np.stack(beta), np.stack(grad)
        h = np.stack(hess).reshape(len(g), g.shape[1], g.shape[1]) + 1e-6 * np.eye(g.shape[1])
        d = np.linalg.solve(h, g[..., None])[..., 0]
        return pd.Series(list(b + d * np.minimum(1.0, 5.0 / np.maximum(1e-9, np.abs(d).max(1)))[:, None]))
    return step("beta", "grad", "hess")


def independent_classifiers(train: DataFrame, numeric: Sequence[str], item_col: str = "ITEM_ID", label: str = "OUTCOME",
                            rounds: int = 8, ridge: float = 1e-3) -> DataFrame:
    """Independent scorer: one logistic regression per item, all items in one pass a round, for any number of items.

    Newton's method: each round joins the items' coefficients, sums gradient and Hessian by item (partial aggregation, so a hot item spreads
    over tasks), and solves one small system per item. Returns (item, beta): intercept, then one coefficient a
    standardised feature, with the scaling in ``mean`` / ``sd``.
    """
    y = (F.col(label).cast("double") > 0).cast("double")
    d = train.select(F.col(item_col).alias("item"), y.alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}")
                                                                    for i, c in enumerate(numeric)]).filter("item is not null and y is not null")
    m = len(numeric)
    scale = d.agg(*[F.avg(f"x{i}") for i in range(m)], *[F.stddev_pop(f"x{i}") for i in range(m)]).first() if m else ()
    mean, sd = [float(v or 0) for v in scale[:m]], [float(v) if v else 1.0 for v in scale[m:]]
    x = [F.lit(1.0), *[(F.col(f"x{i}") - mean[i]) / sd[i] for i in range(m)]]
    d = cut_lineage(d.select("item", "y", *[c.alias(f"z{i}") for i, c in enumerate(x)]))
    x = [F.col(f"z{i}") for i in range(m + 1)]
    beta = d.select("item").distinct().withColumn("beta", F.array(*[F.lit(0.0)] * (m + 1)))
    for _ in range(rounds):
        j = d.join(beta, "item")
        p = 1 / (1 + F.exp(-sum((x[i] * F.col("beta")[i] for i in range(m + 1)), F.lit(0.0))))
        j = j.withColumns({"_e": F.col("y") - p, "_w": p * (1 - p)})
        sums = j.groupBy("item").agg(F.first("beta").alias("beta"), *[F.sum(F.col("_e") * x[i]).alias(f"g{i}") for i in range(m + 1)],
                                     *[F.sum(F.col("_w") * x[i] * x[k]).alias(f"h{i}_{k}") for i in range(m + 1) for k in range(i, m + 1)])
        grad = F.array(*[F.col(f"g{i}") - ridge * F.col("beta")[i] for i in range(m + 1)])
        hess = F.array(*[F.col(f"h{min(i, k)}_{max(i, k)}") + (ridge if i == k else 0.0) for i in range(m + 1) for k in range(m + 1)])
        beta = cut_lineage(sums.select("item", "beta", grad.alias("grad"), hess.alias("hess")).withColumn("beta", _newton()).select("item", "beta"))
    consts = F.array(*[F.lit(v) for v in mean]).cast("array<double>"), F.array(*[F.lit(v) for v in sd]).cast("array<double>")
    return beta.select(F.col("item").alias(item_col), "beta", consts[0].alias("mean"), consts[1].alias("sd"))


def score_independent(models: DataFrame, df: DataFrame, numeric: Sequence[str], item_col: str = "ITEM_ID") -> DataFrame:
    """Score each row with its own item's model: one join; rows of items without a model stay, with a null score."""
    j = df.join(models, item_col, "left")
    z = F.col("beta")[0]
    for i, c in enumerate(numeric):
        z = z + F.col("beta")[i + 1] * (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col("mean")[i]) / F.col("sd")[i]
    return j.withColumn("score", 1 / (1 + F.exp(-z))).drop("beta", "mean", "sd")


# ----------------------------------------------------------------- M4, M5, M6, M7


def fit_multiclass(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), label_col: str = "ITEM_ID",
                   max_iter: int = 50, reg: float = 0.0) -> PipelineModel:
    """Multiclass scorer: ITEM_ID is the class (multinomial logistic regression)."""
    lab = StringIndexer(inputCol=label_col, outputCol="label", handleInvalid="skip")
    feats = tabular_features(df, numeric, categorical, hashed=())
    lr = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, featuresCol="features",
                            labelCol="label")
    return Pipeline(stages=[lab, feats, lr]).fit(df)


def constant_targets(df: DataFrame, targets: Sequence[str]) -> dict:
    """M7: {target: its only value} of the targets that never vary (nulls aside), in one aggregation; 0.0 for all-null ones."""
    row = df.agg(*[f(t).alias(f"{n}{i}") for i, t in enumerate(targets) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {t: float(row[f"lo{i}"] or 0.0) for i, t in enumerate(targets) if row[f"lo{i}"] == row[f"hi{i}"]}


def fit_multioutput(df: DataFrame, targets: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (),
                    task: str = "classification", params: dict | None = None, manifest: dict | None = None,
                    on_degenerate: str = "constant", seed: int = 42) -> dict:
    """One head per ``ITEM_*`` target; all heads grow together, a pass a level, on one binned matrix.

    Targets that never vary are found here (or given as ``manifest`` {target: constant}); ``on_degenerate`` 'constant' predicts
    their value, 'raise' refuses (M7).
    """
    if on_degenerate not in ("constant", "raise"):
        raise ValueError("on_degenerate must be 'constant' or 'raise'")
    constants = dict(manifest) if manifest is not None else constant_targets(df, targets)
    if constants and on_degenerate == "raise":
        raise ValueError(f"single-class targets: {sorted(constants)}")
    live = [t for t in targets if t not in constants]
    p = {"n_estimators": 20, "max_depth": 3} | dict(params or {})
    model = bo.fit_boosted(df, numeric, categorical, live, task == "classification", **tree_params(p)) if live else None
    return {"model": model, "constants": {t: float(v) for t, v in constants.items()}, "targets": list(targets), "task": task}


def score_multioutput(fitted: dict, df: DataFrame, id_col: str = "USER_ID") -> DataFrame:
    """Long scores (id, target, score) for every head, all from one scan."""
    model, constants = fitted["model"], fitted["constants"]
    d = bo.score_boosted(model, df, "_scores") if model is not None else df
    place = {t: i for i, t in enumerate(model.heads)} if model is not None else {}
    rows = F.array(*[F.struct(F.lit(t).alias("target"), (F.col("_scores")[place[t]] if t in place else F.lit(constants[t])).cast("double").alias("score"))
                     for t in fitted["targets"]])
    return d.select(id_col, F.explode(rows).alias("x")).select(id_col, "x.*")


# ----------------------------------------------------------------- M18-M20: uplift


@dataclasses.dataclass
class Uplift:
    """A fitted effect learner: trees whose heads are (fold, arm); a row is scored by heads that did not see its fold."""
    learner: str
    folds: int
    key: list[str]
    outcome: bo.Boosted
    effect: bo.Boosted | None = None       # X: imputed effects by (fold, arm), then propensities by fold


TREATED = "_uplift_treated"


def _fold(key: Sequence[str], folds: int):
    return F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit("fold")), F.lit(folds))


def _own(scores: str, folds: int, fold, arm: int = 0, arms: int = 1):
    """The score of the row's own fold (and an arm) in an array ordered by fold, then arm."""
    return F.element_at(F.col(scores), (fold * arms + arm + 1).cast("int"))


def _folded_heads(df: DataFrame, label, fold, folds: int, arm=None, prefix: str = "_h") -> tuple[DataFrame, list[str]]:
    """Label columns, one a (fold, arm): null for the rows of the fold itself and of the other arm."""
    heads = {}
    for k in range(folds):
        for a in ((None,) if arm is None else (1, 0)):
            mine = (fold != k) if folds > 1 else F.lit(True)
            heads[f"{prefix}{k}_{a}"] = F.when(mine & (F.lit(True) if a is None else arm == bool(a)), label)
    return df.withColumns(heads), list(heads)


def fit_uplift(df: DataFrame, numeric: Sequence[str], treatment: str, label: str = "OUTCOME", learner: str = "t", folds: int = 2,
               categorical: Sequence[str] = (), params: dict | None = None, key: Sequence[str] | None = None) -> Uplift:
    """Cross-fitted effect learners on boosted trees, the folds and arms of each stage as heads of one fit.

    't': outcome models of the treated and of the others. 's': one outcome model with the treatment as a feature, free to interact. 'x'
    (Kuenzel et al. 2019): imputed effects D1 = y - mu0(x) on treated and D0 = mu1(x) - y on others, a model of each, weighed by a fitted
    propensity. Rows of one key (the user, if there is one) share a fold, so no row's effect comes from models that saw it.
    """
    if learner not in ("t", "s", "x"):
        raise ValueError("learner must be 't', 's' or 'x'")
    key = list(key or (["USER_ID"] if "USER_ID" in df.columns else numeric))
    p = tree_params({"n_estimators": 30, "max_depth": 3, "min_child_rows": 20} | dict(params or {}))
    fold, t, y = _fold(key, folds), F.col(treatment).cast("boolean"), F.col(label).cast("double")
    d = df.filter(t.isNotNull())
    if learner == "s":
        h, heads = _folded_heads(d.withColumn(TREATED, t.cast("double")), y, fold, folds)
        return Uplift("s", folds, key, bo.fit_boosted(h, [*numeric, TREATED], categorical, heads, False, **p))
    h, heads = _folded_heads(d, y, fold, folds, t)
    m = Uplift(learner, folds, key, bo.fit_boosted(h, numeric, categorical, heads, False, **p))
    if learner == "t":
        return m
    base = _with_means(m, d)
    imputed = F.when(t, y - F.col("mu0")).otherwise(F.col("mu1") - y)
    h, effects = _folded_heads(base, imputed, fold, folds, t)
    h, treated = _folded_heads(h, t.cast("double"), fold, folds, prefix="_p")
    m.effect = bo.fit_boosted(h, numeric, categorical, [*effects, *treated], [False] * len(effects) + [True] * len(treated), **p)
    return m


def _with_means(m: Uplift, df: DataFrame) -> DataFrame:
    """+ mu1, mu0: the outcome expected with and without treatment."""
    fold = _fold(m.key, m.folds)
    if m.learner == "s":
        for name, flag in (("mu1", 1.0), ("mu0", 0.0)):
            s = bo.score_boosted(m.outcome, df.withColumn(TREATED, F.lit(flag)), "_s")
            df = s.withColumn(name, _own("_s", m.folds, fold)).drop("_s", TREATED)
        return df
    s = bo.score_boosted(m.outcome, df, "_s")
    return s.withColumns({"mu1": _own("_s", m.folds, fold, 0, 2), "mu0": _own("_s", m.folds, fold, 1, 2)}).drop("_s")


def score_uplift(m: Uplift, df: DataFrame) -> DataFrame:
    """``df`` with mu1, mu0 and the effect as ``uplift`` and ``score``; for 'x' also tau1, tau0 and propensity."""
    fold = _fold(m.key, m.folds)
    d = _with_means(m, df)
    effect = F.col("mu1") - F.col("mu0")
    if m.learner == "x":
        d = bo.score_boosted(m.effect, d, "_s").withColumns({
            "tau1": _own("_s", m.folds, fold, 0, 2), "tau0": _own("_s", m.folds, fold, 1, 2),
            "propensity": F.element_at("_s", (fold + 2 * m.folds + 1).cast("int"))}).drop("_s")
        effect = F.col("propensity") * F.col("tau0") + (1 - F.col("propensity")) * F.col("tau1")
    return d.withColumn("uplift", effect).withColumn("score", F.col("uplift"))


def uplift_t_learner(df: DataFrame, numeric: Sequence[str], treatment: str, label: str = "OUTCOME", **kw) -> DataFrame:
    """Two outcome models (treated, others), cross-fitted; effect = mu1(x) - mu0(x)."""
    return score_uplift(fit_uplift(df, numeric, treatment, label, "t", **kw), df)


def uplift_s_learner(df: DataFrame, numeric: Sequence[str], treatment: str, label: str = "OUTCOME", **kw) -> DataFrame:
    """One model with the treatment flag as a feature, scored with the flag set to 1 and 0."""
    return score_uplift(fit_uplift(df, numeric, treatment, label, "s", **kw), df)


def uplift_x_learner(df: DataFrame, numeric: Sequence[str], treatment: str, label: str = "OUTCOME", **kw) -> DataFrame:
    """Imputed effects, a model of each arm's, weighed by the fitted propensity."""
    return score_uplift(fit_uplift(df, numeric, treatment, label, "x", **kw), df)


# ----------------------------------------------------------------- M22: goal-conditioned


def fit_goal_conditioned(train: DataFrame, numeric: Sequence[str], goal_cols: Sequence[str], label: str = "OUTCOME",
                         params: dict | None = None, categorical: Sequence[str] = ()) -> bo.Boosted:
    """GCSL-style: the extra rewards are input features at fit time."""
    return fit_universal(train, [*numeric, *goal_cols], categorical, family="gbt", label=label, params=params)


def score_with_goals(model: bo.Boosted, df: DataFrame, goals: dict) -> DataFrame:
    """At inference every goal column is set to its goal value (mean / percentile / predefined)."""
    return score_pairs(model, df.withColumns({c: F.lit(float(v)) for c, v in goals.items()}))
