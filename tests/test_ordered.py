import random

from pyspark.sql import functions as F

from ranklab.operators import ordered as od
from ranklab.operators import reshape as rs


def _events(spark, seed=7):
    rnd = random.Random(seed)
    rows = [("hot", t, f"i{rnd.randint(0, 4)}") for t in range(0, 3000, 3)]  # one user with most rows
    rows += [(f"u{u}", rnd.randint(0, 3000), f"i{rnd.randint(0, 4)}") for u in range(30) for _ in range(5)]
    seen, uniq = set(), []
    for r in rows:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            uniq.append(r)
    return uniq, spark.createDataFrame(uniq, "u string, t long, i string")


def test_hot_group_is_split_and_neighbors_are_exact(spark):
    data, df = _events(spark)
    pieces = od.range_pieces(df, ["u"], ["t"], n_partitions=8)
    hot_parts = pieces.filter(F.col("u") == "hot").select("_rp").distinct().count()
    assert hot_parts > 1  # the hot user really spans several tasks
    got = {(r["u"], r["t"]): (r["_prev_i"], r["_next_i"]) for r in
           od.with_neighbors(od.with_neighbors(df, ["u"], ["t"], ["i"], "prev", pieces=pieces).drop("_rp"),
                             ["u"], ["t"], ["i"], "next").collect()}
    by_user = {}
    for u, t, i in data:
        by_user.setdefault(u, []).append((t, i))
    for u, evs in by_user.items():
        evs.sort()
        for j, (t, _) in enumerate(evs):
            want_prev = evs[j - 1][1] if j > 0 else None
            want_next = evs[j + 1][1] if j + 1 < len(evs) else None
            assert got[(u, t)] == (want_prev, want_next)


def test_sessions_match_brute_force(spark):
    data, df = _events(spark, seed=11)
    got = {(r["u"], r["t"]): r["SESSION_ID"] for r in rs.assign_sessions(df, "u", "t", 2).collect()}
    by_user = {}
    for u, t, _ in data:
        by_user.setdefault(u, []).append(t)
    for u, ts in by_user.items():
        ts.sort()
        sid = 0
        for j, t in enumerate(ts):
            if j and t - ts[j - 1] > 2:
                sid += 1
            assert got[(u, t)] == sid
