import numpy as np
import pytest

from ranklab.llm import vectors as vx


def brute(rows, t=0.98):
    ok = []
    for _, e, label in rows:
        good = label is not None and e is not None and len(e) > 0 and all(v is not None and np.isfinite(v) for v in e) and any(v != 0 for v in e)
        ok.append(np.array(e, float) if good else None)
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(n):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= t:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(rows[i][0], low.get(find(i), rows[i][0]))
    return sorted(((rows[i][0], links[i], low.get(find(i)), rows[i][0] == low.get(find(i))) for i in range(n)), key=str)


@pytest.mark.parametrize("seed,cells", [(0, None), (1, 12), (2, 40)])
def test_equals_brute_force(spark, seed, cells):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(30):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 12)):
            rows.append([None, (base + r.normal(size=8) * r.choice([0, 0.03, 0.08])).astype(np.float32).tolist(), int(g % 3)])
    rows += [[None, r.normal(size=8).astype(np.float32).tolist(), 1] for _ in range(60)]
    rows += [[None, [1.0] * 8, None], [None, None, 1], [None, [], 1], [None, [0.0] * 8, 1], [None, [float("nan")] + [1.0] * 7, 1], [None, [None] + [1.0] * 7, 1],
             [None, [float("inf")] + [1.0] * 7, 1], [None, [1.0, 2.0, 3.0], 1], [None, [1.0, 2.0, 3.0], 1], [None, [2.0, 4.0, 6.0], 1], [None, [1e30] * 8, 2], [None, [1e-30] * 8, 2]]
    order = r.permutation(len(rows))
    for i, k in enumerate(order):
        rows[i][0] = int(k) if k % 40 else None
    rows.append(list(rows[0]))
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int, n int").repartition(3)
    got = vx.near_duplicates(df, cells=cells)
    assert sorted(((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got.collect() if x["vec_id"] is not None), key=str) == \
        [x for x in brute(rows) if x[0] is not None]
    nulls = sorted((x["n_links"], x["component_id"] or -1) for x in got.collect() if x["vec_id"] is None)
    assert nulls == sorted((x[1], -1 if x[2] is None else x[2]) for x in brute(rows) if x[0] is None)


def test_empty(spark):
    assert vx.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_whole_numbers(spark):
    rows = [(1, 0, [-1, -2, -3]), (2, 0, [-2, -4, -6]), (3, 0, [3, -2, 1]), (4, 0, None), (5, 0, [0, 0, 0])]
    want = [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
    for kind in ("int", "bigint", "float", "double", "decimal(10,2)"):
        df = spark.createDataFrame(rows, "vec_id long, label int, v array<int>").selectExpr("vec_id", "label", f"cast(v as array<{kind}>) as embedding")
        got = vx.near_duplicates(df).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want, kind
