"""Whole-catalogue retrieval, contexts of several events, the Qini curve."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklab.operators import scoring as sc


@pytest.mark.parametrize("block", [3, 2048])
def test_catalogue_top_k_equals_brute_force(spark, block):
    r = np.random.default_rng(0)
    v = r.integers(-2, 3, (50, 4)).astype(float)
    v[7] = v[9] = v[11]
    rows = [(i, v[i].tolist()) for i in range(50)] + [(60, None), (61, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    got = {}
    for x in sc.catalogue_top_k(df.withColumnRenamed("id", "USER_ID"), df.withColumnRenamed("id", "ITEM_ID"), 3, block=block, same=False).collect():
        got.setdefault(x["USER_ID"], []).append((x["rank"], x["ITEM_ID"], x["score"]))
    s = v @ v.T
    for q in range(50):
        want = sorted((-s[q, i], i) for i in range(50) if i != q)[:3]
        assert [(i, c) for _, i, c in sorted(got[q])] == [(i, -c) for c, i in want]
    assert len(got) == 50
    few = df.filter("id < 2").withColumnRenamed("id", "ITEM_ID")
    assert sc.catalogue_top_k(df.withColumnRenamed("id", "USER_ID"), few, 5).count() == 100


def plain_top(q, v, k):
    with np.errstate(all="ignore"):
        s = np.round((q[:, None, :] * v[None]).sum(2), sc.DOT_DIGITS)
    out = {}
    for a in range(len(q)):
        known = np.flatnonzero(~np.isnan(s[a]))
        out[a] = [(n + 1, int(i), float(s[a, i])) for n, i in enumerate(known[np.lexsort((known, -s[a, known]))[:k]])]
    return {a: t for a, t in out.items() if t}


@pytest.mark.parametrize("kind", ["intercept", "popular", "not finite"])
def test_catalogue_top_k_leaves_no_item_out(spark, kind):
    r = np.random.default_rng(3)
    q, v = r.normal(size=(400, 4)), r.normal(size=(700, 4)) * r.gamma(0.5, size=(700, 1))
    if kind == "intercept":
        q[:, 0] = 1.0
    if kind == "not finite":        # such vectors take no other vector of their block with them
        q[3], q[4, 1], q[8], q[9] = np.nan, np.inf, 0.0, 1e200
        v[5], v[6, 0], v[9] = np.nan, np.inf, 1e200
    a, b = (spark.createDataFrame(list(enumerate(x.tolist())), f"{n} long, embedding array<double>").repartition(3) for x, n in ((q, "USER_ID"), (v, "ITEM_ID")))
    got = {}
    for x in sc.catalogue_top_k(a, b, 6, block=32).collect():
        got.setdefault(x["USER_ID"], []).append((x["rank"], x["ITEM_ID"], x["score"]))
    assert {u: sorted(t) for u, t in got.items()} == plain_top(q, v, 6)


def test_near_queries_multiply_few_items(monkeypatch):
    r = np.random.default_rng(4)
    q = np.column_stack([np.ones(4096), r.uniform(0, 50, 4096), r.uniform(0, 100, 4096)])
    v = np.column_stack([-r.uniform(10, 20, 20_000), r.normal(size=(20_000, 2)) / 10])
    mean, near, pairs = v.mean(0), [], []
    for rows in sc._near_groups(q * v.std(0), 64):
        near.append(sc._Near(rows, q[rows], 10, mean, False))
    plain = sc._near_products
    monkeypatch.setattr(sc, "_near_products", lambda a, b: pairs.append(len(a) * len(b)) or plain(a, b))
    for at in range(0, len(v), 5000):
        sc._offer(near, np.arange(at, at + 5000), v[at:at + 5000], True, mean)
    assert sum(pairs) < len(q) * len(v) / 10
    want = plain_top(q[:50], v, 10)
    got = {int(i): [(n + 1, int(x), float(s)) for n, (x, s) in enumerate(zip(g.item[j], g.score[j]))] for g in near for j, i in enumerate(g.ids) if i < 50}
    assert got == want


def histories(r, users=40):
    out = []
    for u in range(users):
        seq = [r.choice("abcde"), r.choice("abcde")]
        for _ in range(r.randint(0, 15)):
            seq.append(r.choice("abcde") if r.random() < .25 else "abcde"[("abcde".index(seq[-1]) + 2 * "abcde".index(seq[-2]) + 1) % 5])
        out.append(seq)
    return out + [["a"], ["z"]]


def plain_prob(seqs, ctx, x):
    if not ctx:
        n = Counter(e for s in seqs for e in s)
        return n[x] / sum(n.values())
    m = len(ctx)
    after = Counter(s[i + m] for s in seqs for i in range(len(s) - m) if tuple(s[i:i + m]) == tuple(ctx))
    lower = plain_prob(seqs, ctx[1:], x)
    return lower if not after else (after[x] + len(after) * lower) / (sum(after.values()) + len(after))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_contexts_equal_plain_counts(spark, order):
    seqs = histories(random.Random(order))
    rows = [(f"u{u}", x, t) for u, s in enumerate(seqs) for t, x in enumerate(s)]
    df = spark.createDataFrame(rows, "USER_ID string, ITEM_ID string, TIMESTAMP long").repartition(5)
    counts = sc.context_counts(df, order).cache()
    got = {(tuple(r["context"]), r["next_item"]): (r["n"], r["prob"]) for r in sc.context_scores(counts, order).collect()}
    seen = Counter((tuple(s[i:i + order]), s[i + order]) for s in seqs for i in range(len(s) - order))
    assert {k: n for k, (n, _) in got.items()} == seen
    assert all(p == pytest.approx(plain_prob(seqs, c, x)) for (c, x), (_, p) in got.items())
    top = {}
    for r in sc.next_items_by_context(df, counts, order, 3).collect():
        top.setdefault(r["USER_ID"], []).append((r["rank"], r["ITEM_ID"], r["score"]))
    items = sorted({x for s in seqs for x in s})
    for u, s in enumerate(seqs):
        want = sorted((-plain_prob(seqs, s[-order:], x), x) for x in items)[:3]
        assert [(x, round(p, 9)) for _, x, p in sorted(top[f"u{u}"])] == [(x, round(-p, 9)) for p, x in want]


def test_two_events_predict_better_than_one(spark):
    seqs = histories(random.Random(9), 200)
    rows = [(f"u{u}", x, t) for u, s in enumerate(seqs) for t, x in enumerate(s[:-1])]
    df = spark.createDataFrame(rows, "USER_ID string, ITEM_ID string, TIMESTAMP long")
    hit = []
    for order in (1, 2):
        top = sc.next_items_by_context(df, sc.context_counts(df, order), order, 1).collect()
        hit.append(sum(seqs[int(r["USER_ID"][1:])][-1] == r["ITEM_ID"] for r in top))
    assert hit[1] > hit[0]


def test_qini_curve(spark):
    r = random.Random(2)
    rows = [(k, r.random(), r.random() < .5, float(r.random() < .4)) for k in range(997)] + [(2000, .5, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, score double, t boolean, OUTCOME double").repartition(6)
    got = [tuple(x) for x in sc.qini_curve(df, "score", "t", buckets=10, tie_cols=["id"]).orderBy("bucket").collect()]
    rows = sorted((x for x in rows if x[2] is not None), key=lambda x: (-x[1], x[0]))
    want = []
    for b in range(1, 11):
        top = rows[:-(-997 * b // 10)]
        yt, yc, nt = sum(x[3] for x in top if x[2]), sum(x[3] for x in top if not x[2]), sum(x[2] for x in top)
        want.append((b, len(top), yt - yc * nt / (len(top) - nt)))
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert got[-1][3] == pytest.approx(got[-1][2]) and got[0][3] == pytest.approx(got[-1][2] * 100 / 997)
    assert sc.qini_curve(df.limit(0), "score", "t").count() == 0


def test_a_task_keeps_k_items_a_query_over_all_its_blocks(spark):
    """What leaves a task does not grow with the number of item blocks it met."""
    import pyarrow as pa
    r = np.random.default_rng(1)
    v = r.integers(-3, 4, (60, 3)).astype(float)
    ids = [list(range(a, a + 10)) for a in range(0, 60, 10)]
    pair = [(ids[0], v[:10].tobytes(), one, v[one].tobytes()) for one in ids]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pair), (pa.list_(pa.int64()), pa.binary()) * 2)], ["ids", "vectors", "_ids", "_vectors"])
    got = [x for b in sc._best_of_blocks([batch], 4, False) for x in zip(*(c.to_pylist() for c in b.columns))]
    s = v @ v.T
    assert sorted((q, -x, i) for q, i, x in got) == [(q, -s[q, i], i) for q in range(10) for i in sorted((i for i in range(60) if i != q), key=lambda i: (-s[q, i], i))[:4]]
