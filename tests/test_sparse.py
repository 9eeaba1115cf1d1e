"""Sparse wide form: equal to the wide table's pivot, triage and least squares; discriminants equal to plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklab.operators import reshape as rs
from ranklab.operators import sparse as sw


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    out = []
    for k in range(600):
        u = r.randrange(25) if r.random() < 0.6 else 0
        i = r.choice("abcdefg")
        y = {"a": 1.0, "b": 0.0, "c": r.choice([0.0, 2.5, 7.0]), "d": None}.get(i, float(r.random() < 0.5))
        out.append((f"u{u}", i, y, k, u * 0.5 - 3))
    out += [(f"u{u}", "a", 1.0, 999, u * 0.5 - 3) for u in range(25)]           # a target that everybody has
    out += [(None, "a", 1.0, 1, 0.0), ("u1", None, 1.0, 1000, -2.5), ("u1", "a", 1.0, 999, -2.5), ("only", "d", None, 5, 1.0), ("only", "a", 1.0, 5, 1.0)]
    return spark.createDataFrame(out, "USER_ID string, ITEM_ID string, OUTCOME double, t long, age double").cache()


def test_rows_equal_the_wide_pivot(rows):
    wide = {r["USER_ID"]: r.asDict() for r in rs.pivot_to_wide(rows, "USER_ID", "ITEM_ID", "OUTCOME", order_cols=["t", "age"]).collect()}
    sparse = [r.asDict() for r in sw.user_rows(sw.pivot_sparse(rows, order_cols=["t", "age"])).withColumn("keys", F.map_keys("TARGETS")).collect()]
    assert len(sparse) == len(wide) == 26
    for r in sparse:
        want = wide[r["USER_ID"]]
        assert (r["t"], r["age"]) == (want["t"], want["age"]) and r["keys"] == sorted(r["TARGETS"])
        assert all(r["TARGETS"].get(c, 0.0) == v for c, v in want.items() if c.startswith("ITEM_"))


@pytest.mark.parametrize("fill", [0.0, 1.0, -1.0])
def test_triage_equals_that_of_the_wide_table(rows, fill):
    wide = rs.pivot_to_wide(rows.filter("ITEM_ID <> 'd'"), "USER_ID", "ITEM_ID", "OUTCOME", order_cols=["t", "age"], fill=fill)
    want = {r["column"]: r.asDict() for r in rs.target_manifest(wide).collect()}
    got = {r["column"]: r.asDict() for r in sw.cell_manifest(sw.pivot_sparse(rows.filter("ITEM_ID <> 'd'"), fill=fill)).collect()}
    assert got == want and {r["status"] for r in got.values()} >= {"bad_non_binary", "degenerate"}


def test_melt_gives_the_observed_pairs_and_targets_are_dropped(spark, rows):
    s = sw.pivot_sparse(rows, order_cols=["t", "age"])
    m = sw.melt_cells(s)
    assert m.columns == ["USER_ID", "t", "age", "ITEM_ID", "OUTCOME"]
    assert m.count() == rows.dropna(subset=["USER_ID", "ITEM_ID", "OUTCOME"]).select("USER_ID", "ITEM_ID").distinct().count()
    left = sw.drop_targets(s, spark.createDataFrame([("ITEM_c",)], "column string"))
    assert "ITEM_c" not in {r[0] for r in left.cells.select("ITEM_ID").distinct().collect()} and left.users.count() == s.users.count()


@pytest.mark.parametrize("fill, ridge", [(0.0, 0.0), (0.5, 2.0)])
def test_heads_equal_least_squares_on_the_wide_table(rows, fill, ridge):
    wide = rs.pivot_to_wide(rows, "USER_ID", "ITEM_ID", "OUTCOME", order_cols=["t", "age"], fill=fill).toPandas()
    heads = sw.linear_heads(sw.pivot_sparse(rows, order_cols=["t", "age"], fill=fill), ["age", "t"], ridge)
    x = np.column_stack([np.ones(len(wide)), wide["age"], wide["t"]])
    for r in heads.collect():
        want = np.linalg.solve(x.T @ x + ridge * np.diag([0, 1, 1]), x.T @ (wide[r["ITEM_ID"]].to_numpy() - fill)) + [fill, 0, 0]
        assert np.allclose(r["beta"], want, atol=1e-8)
    pairs = rows.select("USER_ID", F.concat(F.lit("ITEM_"), "ITEM_ID").alias("ITEM_ID"), "age", "t")
    assert sw.score_heads(heads, pairs, ["age", "t"]).filter("score is null and ITEM_ID in ('ITEM_a', 'ITEM_e')").count() == 0


def test_discriminant_equals_the_plain_one(spark):
    r = np.random.default_rng(4)
    c = np.where(r.random(900) < 0.4, 0, r.integers(0, 30, 900))
    x = np.column_stack([c * 2.0, -(c % 5)]) + r.normal(size=(900, 2)) + 1000
    d = spark.createDataFrame([(f"r{k}", f"c{int(c[k]):02d}", float(x[k, 0]), float(x[k, 1])) for k in range(900)], "USER_ID string, ITEM_ID string, a double, b double")
    d = d.unionByName(spark.createDataFrame([("n", None, 1.0, None)], d.schema))
    m = sw.fit_discriminant(d, ["a", "b"], ridge=1e-3)
    names = sorted({f"c{k:02d}" for k in c})
    mu = np.array([x[c == int(n[1:])].mean(0) for n in names])
    res = x - np.array([mu[names.index(f"c{k:02d}")] for k in c])
    cov = res.T @ res / (900 - len(names))
    sd = np.sqrt(np.diag(cov))
    inv = np.linalg.inv(cov / np.outer(sd, sd) + 1e-3 * np.eye(2)) / np.outer(sd, sd)
    prior = np.log([np.mean(c == int(n[1:])) for n in names])
    z = prior[None, :] - 0.5 * np.einsum("nci,ij,ncj->nc", x[:, None] - mu, inv, x[:, None] - mu)
    want = {f"r{k}": [names[j] for j in np.argsort(-z[k], kind="stable")[:3]] for k in range(900)}
    got: dict = {}
    for r_ in sw.discriminant_top_k(m, d, ["a", "b"], 3).orderBy("USER_ID", "rank").collect():
        got.setdefault(r_["USER_ID"], []).append(r_["ITEM_ID"])
    assert m.count() == len(names) and got.keys() == want.keys() | {"n"}
    assert sum(got[k] == v for k, v in want.items()) >= 895        # near ties may turn
    assert np.mean([v[0] == f"c{c[int(k[1:])]:02d}" for k, v in got.items() if k != "n"]) > 0.5


def test_empty_tables(spark, rows):
    s = sw.pivot_sparse(rows.limit(0), order_cols=["t", "age"])
    assert sw.user_rows(s).count() == sw.cell_manifest(s).count() == sw.linear_heads(s, ["age"]).count() == 0
    assert sw.fit_discriminant(rows.limit(0), ["age"]).count() == 0
