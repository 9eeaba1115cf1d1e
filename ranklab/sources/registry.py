"""Model save / list / load.

Each saved model is a folder: ``meta/`` holds one line of JSON, written through Spark, so listing is ``spark.read.json`` over the
metadata of every model; ``model/`` holds the model in parts - one line of JSON for what is small (trees, cuts, settings), a Parquet table for
each part that grows with the data (id maps, level tables, transitions, per-item trees) and a Spark ML folder for each Spark ML stage.
Every kind that the train driver makes comes back ready to score.
"""

from __future__ import annotations

import json
import os
import re
import time

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.operators import boosting as bo
from ranklab.operators import factorization as fz
from ranklab.operators.learners import ModelHandle, Uplift
from ranklab.session import path_exists

# Fixed value: allowed model names.
NAME_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
META = ("name string, kind string, recommender_type string, config string, metrics map<string,double>, "
        "tags array<string>, features string, saved_at double")


class RegistryError(ValueError):
    pass


def validate_model_name(name: str) -> str:
    """Safe names only (no separators, no parent references)."""
    if not isinstance(name, str) or not re.match(NAME_PATTERN, name) or ".." in name:
        raise RegistryError(f"invalid model name {name!r}: use letters, digits, '_', '-', '.'")
    return name


def _dir(root: str, name: str) -> str:
    return os.path.join(root, validate_model_name(name))


def _exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path)


def to_parts(model) -> tuple[dict, dict, dict]:
    """(JSON-able description, tables, Spark ML stages) of a model of any kind."""
    tables: dict[str, DataFrame] = {}
    stages: dict = {}

    def trees(m: bo.Boosted | None, name: str):
        if m is None:
            return None
        return bins(m.bins, name) | {"trees": bo.describe(m)}

    def bins(b: bo.Bins, name: str) -> dict:
        for i, c in enumerate(b.categorical):
            tables[f"{name}_levels_{i}"] = b.levels[c]
        return {"numeric": b.numeric, "categorical": b.categorical, "cuts": [c.tolist() for c in b.cuts]}

    if isinstance(model, bo.Boosted):
        return {"type": "boosted", "model": trees(model, "model")}, tables, stages
    if isinstance(model, fz.Factorization):
        tables.update({f"field_{i}": t for i, t in enumerate(model.tables)})
        return {"type": "factorization", "model": fz.describe(model)}, tables, stages
    if isinstance(model, Uplift):
        return {"type": "uplift", "learner": model.learner, "folds": model.folds, "key": model.key,
                **{part: trees(getattr(model, part), part) for part in ("outcome", "effect")}}, tables, stages
    if isinstance(model, DataFrame):
        tables["rows"] = model
        return {"type": "table"}, tables, stages
    if isinstance(model, tuple):                       # trees of every item
        tables["items"] = model[1]
        return {"type": "item_trees", "bins": bins(model[0], "bins")}, tables, stages
    if isinstance(model, dict) and "targets" in model:
        return {"type": "heads", "constants": model["constants"], "targets": model["targets"], "task": model["task"],
                "model": trees(model["model"], "model")}, tables, stages
    if isinstance(model, dict) and "goals" in model:
        return {"type": "goals", "goals": model["goals"], "model": trees(model["model"], "model")}, tables, stages
    if isinstance(model, ModelHandle):                 # ALS and its id maps
        tables.update(model.extras)
        stages["als"] = model.model
        return {"type": "als"}, tables, stages
    if hasattr(model, "write"):
        stages["stage"] = model
        return {"type": "als_stage" if isinstance(model, ALSModel) else "pipeline"}, tables, stages
    raise RegistryError(f"a model of type {type(model).__name__} cannot be saved")


def from_parts(text: dict, table, stage):
    """The model of a description; ``table(name)`` and ``stage(class, name)`` read the parts."""
    def trees(d: dict | None, name: str):
        if d is None:
            return None
        return bo.from_description(d["trees"], {c: table(f"{name}_levels_{i}") for i, c in enumerate(d["categorical"])})
    kind = text["type"]
    if kind == "boosted":
        return trees(text["model"], "model")
    if kind == "factorization":
        d = text["model"]
        return fz.Factorization(**d, tables=[table(f"field_{i}") for i in range(len(d["categorical"]))])
    if kind == "uplift":
        return Uplift(text["learner"], text["folds"], text["key"], *[trees(text[part], part) for part in ("outcome", "effect")])
    if kind == "table":
        return table("rows")
    if kind == "item_trees":
        d = text["bins"]
        return bo.Bins(d["numeric"], d["categorical"], {c: table(f"bins_levels_{i}") for i, c in enumerate(d["categorical"])},
                       [np.array(c) for c in d["cuts"]]), table("items")
    if kind == "heads":
        return {"model": trees(text["model"], "model"), "constants": text["constants"], "targets": text["targets"], "task": text["task"]}
    if kind == "goals":
        return {"model": trees(text["model"], "model"), "goals": text["goals"]}
    if kind == "als":
        return ModelHandle("als", {}, stage(ALSModel, "als"), 0.0, "als", {p: table(p) for p in ("umap", "imap")})
    return stage(ALSModel if kind == "als_stage" else PipelineModel, "stage")


def save_model(spark: SparkSession, root: str, name: str, model, kind: str, config: dict | None = None,
               metrics: dict | None = None, tags=(), features: dict | None = None) -> str:
    """Write model + metadata; refuse to overwrite; tags merged ordered-unique. ``features``: the columns that the model scores with."""
    d = _dir(root, name)
    if _exists(spark, d):
        raise RegistryError(f"model {name!r} already exists; choose another name")
    text, tables, stages = to_parts(model)
    for part, stage in stages.items():
        stage.write().save(os.path.join(d, "model", f"stage_{part}"))
    for part, frame in tables.items():
        frame.write.parquet(os.path.join(d, "model", f"table_{part}"))
    # the description is written last: a folder without it is no model
    spark.createDataFrame([json.dumps(text)], "string").coalesce(1).write.text(os.path.join(d, "model", "description"))
    seen, merged = set(), []
    for t in tags:
        if t not in seen:
            seen.add(t)
            merged.append(t)
    meta = {"name": name, "kind": kind, "recommender_type": (config or {}).get("recommender_type", "ranking"),
            "config": json.dumps(config or {}, sort_keys=True, default=str), "metrics": metrics or {},
            "tags": merged, "features": json.dumps(features or {}), "saved_at": time.time()}
    spark.createDataFrame([json.dumps(meta)], "string").coalesce(1).write.text(os.path.join(d, "meta"))
    return d


def list_models(spark: SparkSession, root: str, tag_filter=(), recommender_type: str | None = None) -> DataFrame:
    """Metadata of every saved model; tags must be a superset of ``tag_filter``."""
    df = spark.read.schema(META).json(os.path.join(root, "*", "meta"))
    if tag_filter:
        df = df.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in tag_filter]), F.col("tags"))) == 0)
    if recommender_type:
        df = df.filter(F.col("recommender_type") == recommender_type)
    return df.orderBy("name")


def load_model(spark: SparkSession, root: str, name: str):
    """Both parts must exist; returns (model, metadata row). Every kind comes back as the object that was saved."""
    d = _dir(root, name)
    if not _exists(spark, os.path.join(d, "model", "description")) or not _exists(spark, os.path.join(d, "meta")):
        raise RegistryError(f"model {name!r} is missing its model or metadata part")
    meta = spark.read.schema(META).json(os.path.join(d, "meta")).first()
    text = json.loads(spark.read.text(os.path.join(d, "model", "description"), wholetext=True).first()[0])
    model = from_parts(text, lambda part: spark.read.parquet(os.path.join(d, "model", f"table_{part}")),
                       lambda cls, part: cls.load(os.path.join(d, "model", f"stage_{part}")))
    if isinstance(model, ModelHandle):
        model.model_id, model.config = name, json.loads(meta["config"])
    return model, meta
