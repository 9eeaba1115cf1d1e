"""Batch scoring and top-k (M11, M12, M13, M16, M21, M23, M24 and score baselines).

Score tables are long: ``(USER_ID, ITEM_ID, score)`` or, for scorers that do
not depend on the user, ``(ITEM_ID, score)``. A user-independent ranking is
kept as one global top-k table (k rows) instead of being copied per user, so
evaluation joins logged rows to it on the item alone.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.functions.columns import seeded_hash
from ranklab.operators.ordered import range_pieces, with_neighbors, with_running_sums
from ranklab.session import materialize

# task functions travel with their code, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOT_DIGITS = 9     # dot products are compared by so many decimals, so that the order of summation makes no ties or breaks them


def item_mean_scores(train: DataFrame, item_col: str = "ITEM_ID", outcome_col: str = "OUTCOME") -> DataFrame:
    """Mean outcome per item (the reward model / popularity-by-rate baseline)."""
    return train.groupBy(item_col).agg(F.avg(outcome_col).alias("score"))


def top_k_global(scores: DataFrame, k: int, item_col: str = "ITEM_ID", score_col: str = "score") -> DataFrame:
    """Top-k items of a user-independent scorer, ties by item id. Returns k rows (item, score, rank)."""
    top = scores.orderBy(F.col(score_col).desc(), F.col(item_col)).limit(k)  # TakeOrderedAndProject
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score_col).desc(), F.col(item_col))))


def top_k_per_user(scores: DataFrame, k: int, user_col: str = "USER_ID", item_col: str = "ITEM_ID",
                   score_col: str = "score") -> DataFrame:
    """``row_number() <= k`` per user; Spark plans a WindowGroupLimit that keeps
    only k rows per user in every map task, so a hot user never reaches the
    shuffle with more than k rows per task."""
    w = Window.partitionBy(user_col).orderBy(F.col(score_col).desc(), F.col(item_col))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def restrict_candidates(scores: DataFrame, candidates: DataFrame, item_col: str = "ITEM_ID",
                        scorer_type: str = "universal") -> DataFrame:
    """Keep only candidate items (semi join; Spark picks broadcast or shuffle by the list's size).

    Refused for multi-output scorers: their targets are fixed columns, not a
    candidate set of items.
    """
    if scorer_type == "multioutput":
        raise ValueError("candidate restriction is not supported for multi-output scorers")
    return scores.join(candidates.select(item_col), item_col, "left_semi")


def dot_scores(left: DataFrame, right: DataFrame, on: str | Sequence[str], left_vec: str, right_vec: str,
               out: str = "score") -> DataFrame:
    """Dot product of two embedding columns for pairs matched by an equi-join
    (``aggregate(zip_with(u, v, *), 0, +)``, JVM-side)."""
    j = left.join(right, on)
    prod = F.zip_with(F.col(left_vec), F.col(right_vec), lambda x, y: x.cast("double") * y.cast("double"))
    return j.withColumn(out, F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x))


def centroid_scores(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    group_col: str = "label") -> DataFrame:
    """Two-sided scoring on `embeddings`: each vector against its group's centroid.

    Centroids are an element-wise average per group (explode + groupBy on
    (group, position), so no vector is ever collected); the per-group centroid
    table joins back on the group key.
    """
    pos = emb.select(group_col, F.posexplode(vec_col).alias("_i", "_x"))
    cent = (pos.groupBy(group_col, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
            .groupBy(group_col).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_c"))
            .select(group_col, F.transform("_c", lambda s: s["_m"]).alias("centroid")))
    return dot_scores(emb.select(id_col, group_col, vec_col), cent, group_col, vec_col, "centroid") \
        .select(id_col, group_col, "score")


def transition_scores(seq_long: DataFrame, user_col: str = "USER_ID", item_col: str = "ITEM_ID",
                      order_cols: Sequence[str] = ("TIMESTAMP",), max_len: int | None = None,
                      session_col: str | None = None, across_weight: float = 0.0) -> DataFrame:
    """First-order next-item probabilities P(next | prev) from ordered, whole histories.

    The next event comes from range pieces, so a hot user spans many tasks. With ``session_col``, a pair inside one session
    counts 1 and a pair over a session border ``across_weight`` (the back-off between sessions; 0 leaves it out). ``max_len`` is an option
    of the caller: it keeps only the last events of each history. Output (prev_item, next_item, n, prob).
    """
    part = [user_col] + ([session_col] if session_col else [])
    s = seq_long
    if max_len:
        wr = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order_cols])  # WindowGroupLimit, pruned per task
        s = s.withColumn("_rrev", F.row_number().over(wr)).filter(F.col("_rrev") <= max_len).drop("_rrev")
    vals = [item_col] + ([session_col] if session_col else [])
    s = with_neighbors(s, [user_col], list(order_cols), vals, "next", prefix="_n_").withColumnRenamed("_n_" + item_col, "_next")
    weight = F.lit(1)
    if session_col:
        same = F.col("_n_" + session_col) == F.col(session_col)
        weight = F.when(same, F.lit(1.0)).otherwise(F.lit(float(across_weight))) if across_weight else same.cast("int")
    s = s.filter(F.col("_next").isNotNull()).withColumn("_wt", weight).filter(F.col("_wt") > 0)
    pairs = s.groupBy(F.col(item_col).alias("prev_item"), F.col("_next").alias("next_item")).agg(F.sum("_wt").alias("n"))
    # totals by partial aggregation and a join: the successors of a popular item never meet in one task
    totals = pairs.groupBy(F.col("prev_item").alias("_prev")).agg(F.sum("n").alias("_t"))
    return pairs.join(totals, F.col("prev_item") == F.col("_prev")).select("prev_item", "next_item", "n", (F.col("n") / F.col("_t")).alias("prob"))


def next_items(histories: DataFrame, transitions: DataFrame, k: int, user_col: str = "USER_ID", item_col: str = "ITEM_ID",
               order_cols: Sequence[str] = ("TIMESTAMP",)) -> DataFrame:
    """Top-k next items per user from the user's last event: (user, item, score, rank).

    The score depends on the previous item alone, so its successors are cut to the top k before the join with the users.
    """
    best = top_k_per_user(transitions, k, user_col="prev_item", item_col="next_item", score_col="prob")
    key = F.struct(*[F.col(c) for c in [*order_cols, item_col]])
    last = histories.groupBy(user_col).agg(F.max_by(F.col(item_col), key).alias("prev_item"))
    return last.join(best, "prev_item").select(user_col, F.col("next_item").alias(item_col), F.col("prob").alias("score"), "rank")


def observed_uplift(df: DataFrame, segment_col: str, treatment_col: str, outcome_col: str = "OUTCOME") -> DataFrame:
    """Mean outcome treated minus mean outcome control per segment (model-free)."""
    t = F.col(treatment_col).cast("boolean")
    return df.groupBy(segment_col).agg(
        F.avg(F.when(t, F.col(outcome_col))).alias("mean_treated"),
        F.avg(F.when(~t, F.col(outcome_col))).alias("mean_control"),
        F.count_if(t).alias("n_treated"), F.count_if(~t).alias("n_control"),
    ).withColumn("uplift", F.col("mean_treated") - F.col("mean_control"))


def epsilon_greedy(topk: DataFrame, epsilon: float, seed: int, user_col: str = "USER_ID",
                   item_col: str = "ITEM_ID", rank_col: str = "rank") -> DataFrame:
    """explore/exploit choice per user from its ranked list.

    Draw u = md5(seed|user) mapped to [0,1). Exploit (rank 1) when u >= epsilon,
    else explore: pick rank 1 + floor(u/epsilon * k) among the top-k. The
    propensity of the chosen action is (1-eps)+eps/k for rank 1, eps/k otherwise.
    """
    k_per_user = F.max(rank_col).over(Window.partitionBy(user_col))
    u = F.conv(F.substring(seeded_hash(seed, user_col), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    t = topk.withColumn("_u", u).withColumn("_k", k_per_user)
    explore = F.col("_u") < F.lit(float(epsilon))
    target = F.when(explore, 1 + F.floor(F.col("_u") / F.lit(float(epsilon)) * F.col("_k"))).otherwise(1)
    chosen = t.filter(F.col(rank_col) == target)
    prop = F.when(F.col(rank_col) == 1, (1 - F.lit(float(epsilon))) + F.lit(float(epsilon)) / F.col("_k")) \
        .otherwise(F.lit(float(epsilon)) / F.col("_k"))
    return chosen.select(user_col, item_col, F.col(rank_col).alias("chosen_rank"),
                         explore.alias("explored"), prop.alias("propensity"))


# ----------------------------------------------------------------- M12, M13: contexts of several events


def context_counts(seq_long: DataFrame, order: int, user_col: str = "USER_ID", item_col: str = "ITEM_ID",
                   order_cols: Sequence[str] = ("TIMESTAMP",)) -> DataFrame:
    """(depth, context, next_item, n): how often an item followed each run of 0 to ``order`` events; the context's newest event is last.

    The events before each event come from range pieces, so a hot user spans many tasks.
    """
    back, seen = item_col, []
    s = range_pieces(seq_long.select(user_col, item_col, *order_cols).filter(F.col(item_col).isNotNull()), [user_col], list(order_cols))
    for m in range(1, order + 1):
        s = with_neighbors(s, [user_col], list(order_cols), [back], "prev", prefix="_b", pieces=s)
        s = s.withColumnRenamed("_b" + back, f"_p{m}")
        back = f"_p{m}"
        seen.insert(0, back)
    ctx = [F.struct(F.lit(m).alias("depth"), F.array(*[F.col(c) for c in seen[order - m:]]).cast("array<string>").alias("context"),
                    (F.col(f"_p{m}").isNotNull() if m else F.lit(True)).alias("_all")) for m in range(order + 1)]
    e = s.select(F.col(item_col).alias("next_item"), F.explode(F.array(*ctx)).alias("c")).filter("c._all")
    return e.groupBy("c.depth", "c.context", "next_item").agg(F.count(F.lit(1)).alias("n"))


def _context_totals(counts: DataFrame) -> DataFrame:
    """(context, total, kinds) by partial aggregation: a popular context's successors never meet in one task."""
    return counts.groupBy(F.col("context").alias("_ctx")).agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_kinds"))


def _backed_off(rows: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """``rows`` (context, next_item) with ``prob``, interpolated from the empty context up (Witten and Bell 1991):
    P(x | c) = (n(c, x) + kinds(c) * P(x | c without its oldest event)) / (total(c) + kinds(c)). A context never seen leaves the shorter one's."""
    zero = counts.filter("depth = 0").select(F.col("next_item").alias("_x"), F.col("n").alias("_n"))
    n_all = zero.agg(F.sum("_n").cast("double").alias("_whole"))
    d = rows.join(zero, F.col("next_item") == F.col("_x"), "left").crossJoin(F.broadcast(n_all))      # one row
    d = d.withColumn("prob", F.coalesce("_n", F.lit(0)) / F.col("_whole")).drop("_x", "_n", "_whole")
    totals = _context_totals(counts.filter("depth > 0"))
    for m in range(1, order + 1):
        c = counts.filter(F.col("depth") == m).select(F.col("context").alias("_c"), F.col("next_item").alias("_x"), F.col("n").alias("_n"))
        t = totals.filter(F.size("_ctx") == m)
        own = F.when(F.size("context") >= m, F.slice("context", -m, m))
        d = d.withColumn("_own", own).join(t, F.col("_own") == F.col("_ctx"), "left").join(
            c, (F.col("_own") == F.col("_c")) & (F.col("next_item") == F.col("_x")), "left")
        p = (F.coalesce("_n", F.lit(0)) + F.col("_kinds") * F.col("prob")) / (F.col("_total") + F.col("_kinds"))
        d = d.withColumn("prob", F.coalesce(p, F.col("prob"))).drop("_own", "_ctx", "_total", "_kinds", "_c", "_x", "_n")
    return d


def context_scores(counts: DataFrame, order: int) -> DataFrame:
    """(context, next_item, n, prob) of every observed run of ``order`` events and what followed it."""
    return _backed_off(counts.filter(F.col("depth") == order).select("context", "next_item", "n"), counts, order)


def next_items_by_context(histories: DataFrame, counts: DataFrame, order: int, k: int, user_col: str = "USER_ID", item_col: str = "ITEM_ID",
                          order_cols: Sequence[str] = ("TIMESTAMP",)) -> DataFrame:
    """Top-k next items per user from its last ``order`` events: (user, item, score, rank).

    Scores belong to contexts, so each distinct context is scored once. Candidates are what ever followed the newest event, and the k
    most frequent items: any other item has a smaller share of the same back-off than all of those k.
    """
    newest = Window.partitionBy(user_col).orderBy(*[F.col(c).desc() for c in order_cols], F.col(item_col).desc())   # pruned to ``order`` rows a task
    last = histories.filter(F.col(item_col).isNotNull()).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= order)
    last = last.groupBy(user_col).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_r"), F.col(item_col).alias("x")))), lambda e: e["x"].cast("string")).alias("context"))
    contexts = last.select("context").distinct()
    follows = counts.filter("depth = 1").select(F.col("context")[0].alias("_c"), "next_item")
    top = counts.filter("depth = 0").orderBy(F.col("n").desc(), "next_item").limit(k).select("next_item")
    cand = contexts.join(follows, F.element_at("context", -1) == F.col("_c")).select("context", "next_item") \
        .unionByName(contexts.crossJoin(F.broadcast(top))).distinct()     # k rows
    scored = _backed_off(cand, counts, order)
    best = Window.partitionBy("context").orderBy(F.col("prob").desc(), "next_item")
    best = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return last.join(best, "context").select(user_col, F.col("next_item").alias(item_col), F.col("prob").alias("score"), "rank")


# ----------------------------------------------------------------- M11, M16: the whole catalogue

#: Bytes of vectors in one row of a block table, and of the items that a task reads at once.
ROW_BYTES, TASK_BYTES = 1 << 22, 1 << 28
#: Queries that are put in order of nearness at a time, and groups of near queries that travel together.
CHUNK, GROUPS = 1 << 17, 16
#: Items looked at first to learn what the others must reach, and at once after them.
FIRST, STEP = 256, 2048


def _chunks(batches, size: int):
    """(ids, vectors) of up to ``size`` rows."""
    ids, parts, n = [], [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            ids.append(part.column("id").to_numpy(zero_copy_only=False))
            parts.append(part.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(part.num_rows, -1))
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield np.concatenate(ids), np.concatenate(parts)
                ids, parts, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(parts)


def _lengths(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt((v * v).sum(1))


def _scale(q: np.ndarray, unit: bool) -> np.ndarray:
    """What queries are divided by before they are compared with each other: a query's best items do not depend on its length."""
    return np.where((size := _lengths(q)) > 0, size, 1.0) if unit else np.ones(len(q))


def _near_groups(v: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of up to ``size`` vectors near each other: halves by the coordinate that varies most, until they are small."""
    todo, groups = [np.arange(len(v))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            groups.append(rows)
            continue
        x = v[rows]
        half = len(rows) // 2
        order = np.argpartition(x[:, x.std(0).argmax()], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return groups


def _packed(batches, rows: int, size: int, weight: np.ndarray | None, unit: bool):
    """Rows of a block table: up to ``rows`` vectors, and with ``weight`` (what each coordinate counts) in groups of up to ``size`` near ones that end at ``ends``."""
    for ids, v in _chunks(batches, rows if weight is None else max(rows, min(CHUNK, ROW_BYTES * GROUPS // (8 * max(1, len(weight)))))):
        if weight is None:
            groups = [np.arange(len(v))]
        else:
            ok = np.isfinite(_lengths(v))
            good, bad = np.flatnonzero(ok), np.flatnonzero(~ok)
            groups = [good[g] for g in _near_groups(v[good] / _scale(v[good], unit)[:, None] * weight, size)] + [bad[at:at + size] for at in range(0, len(bad), size)]
            groups = [g for g in groups if len(g)]
        most = max(1, min(GROUPS, rows // size)) if weight is not None else 1
        for at in range(0, len(groups), most):
            some = np.concatenate(groups[at:at + most])
            ends = np.cumsum([len(g) for g in groups[at:at + most]])
            yield pa.RecordBatch.from_arrays([pa.array([ids[some]], pa.list_(pa.int64())), pa.array([v[some].tobytes()], pa.binary()), pa.array([ends], pa.list_(pa.int32()))],
                                             ["ids", "vectors", "ends"])


def _coordinate_sums(batches, unit: bool):
    """One row: number, sums, squares and extremes of a task's finite vectors by coordinate."""
    total = None
    for _, v in _chunks(batches, 1 << 14):
        v = v[np.isfinite(_lengths(v))]
        if len(v):
            v = v / _scale(v, unit)[:, None]
            x = len(v), v.sum(0), (v * v).sum(0), v.min(0), v.max(0)
            total = x if total is None else (total[0] + x[0], total[1] + x[1], total[2] + x[2], np.minimum(total[3], x[3]), np.maximum(total[4], x[4]))
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total[0]]), *[pa.array([x], pa.list_(pa.float64())) for x in total[1:]]], ["n", "s", "ss", "lo", "hi"])


def _coordinates(df: DataFrame, unit: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, standard deviation, whether it is one number other than 0) of each coordinate of a table of vectors; a row a task reaches the driver."""
    some = df.select(F.size("v").alias("d")).first()
    d = some["d"] if some else 0
    r = df.mapInArrow(lambda b: _coordinate_sums(b, unit), "n long, s array<double>, ss array<double>, lo array<double>, hi array<double>").collect()
    if not r:
        return np.zeros(d), np.zeros(d), np.zeros(d, bool)
    n, s, ss = (np.sum([x[c] for x in r], axis=0) for c in ("n", "s", "ss"))
    lo, hi = np.min([x["lo"] for x in r], axis=0), np.max([x["hi"] for x in r], axis=0)
    return s / n, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0.0)), (lo == hi) & (lo != 0)


def _near_products(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All dot products in single precision, and by how much those of each query may be off, rounding to ``DOT_DIGITS`` included."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = _lengths(q) * _lengths(v).max()
        if np.isfinite(size).all() and size.max() < 1e30:
            return q.astype("<f4") @ v.astype("<f4").T, 4 * (q.shape[1] + 4) * 2.0 ** -23 * size + 2 * 10.0 ** -DOT_DIGITS
        return q @ v.T, np.where(np.isfinite(size), 1e-12 * size + 2 * 10.0 ** -DOT_DIGITS, np.inf)


class _Near:
    """Queries near each other, the best items of each so far, and the box and the ball that all of them lie in."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, mean: np.ndarray, unit: bool):
        self.ids, self.q, self.k, n = ids, q, k, len(q)
        self.score, self.item, self.count, self.least = np.zeros((n, k)), np.zeros((n, k), np.int64), np.zeros(n, np.int64), np.full(n, -np.inf)
        self.finite = bool(np.isfinite(_lengths(q)).all())
        self.by = _scale(q, unit) if self.finite else np.ones(n)
        u = q / self.by[:, None] if self.finite else np.zeros_like(q)
        lo, hi = u.min(0), u.max(0)
        self.middle, self.half, self.centre = (lo + hi) / 2, (hi - lo) / 2, u.mean(0)
        self.lengths, self.radius = _lengths(u), _lengths(u - self.centre).max()
        self.size, self.most = np.sqrt((np.maximum(abs(lo), abs(hi)) ** 2).sum()), self.lengths.max()
        self.shift = q @ mean if self.finite else np.zeros(n)

    def floors(self) -> np.ndarray:
        """What the bound of an item must reach for it to be among the best of each query."""
        return (self.least - self.shift - 2 * 10.0 ** -DOT_DIGITS) / self.by if self.finite else np.full(len(self.q), -np.inf)

    def add(self, ids: np.ndarray, v: np.ndarray, same: bool, longest: float = np.inf) -> None:
        """Items that may be among the best; none is longer than ``longest``, so they are multiplied only with queries that such an item can be good for."""
        some = np.flatnonzero(self.floors() <= self.lengths * longest) if self.finite and longest < np.inf else np.arange(len(self.q))
        if len(some):
            self._add(some, ids, v, same)

    def _add(self, some: np.ndarray, ids: np.ndarray, v: np.ndarray, same: bool) -> None:
        q, floor, count = (x if len(some) == len(self.q) else x[some] for x in (self.q, self.least, self.count))
        s, slack = _near_products(q, v)
        least, new = np.where(np.isinf(slack), -np.inf, floor - np.where(np.isinf(slack), 0.0, slack)), np.flatnonzero(count < self.k)
        if len(new) and s.shape[1] > self.k + 1 and s.dtype == np.float32:      # one more, as an item may be the query itself
            least[new] = np.maximum(least[new], np.partition(s[new], s.shape[1] - self.k - 1, axis=1)[:, s.shape[1] - self.k - 1] - slack[new])
        least = least.astype(s.dtype)
        rows = np.flatnonzero((s.max(1) if s.dtype == np.float32 else np.fmax.reduce(s, axis=1)) >= least)
        if not len(rows):
            return
        row, col = np.divmod(np.flatnonzero((s if len(rows) == len(s) else s[rows]) >= least[rows, None]), s.shape[1])
        row = some[rows[row]]
        with np.errstate(over="ignore", invalid="ignore"):
            item, score = ids[col], np.round((self.q[row] * v[col]).sum(1), DOT_DIGITS)
        good = (score >= self.least[row]) & (True if same else self.ids[row] != item)
        row, item, score = row[good], item[good], score[good]
        hit = np.unique(row)
        held = np.arange(self.k) < self.count[hit][:, None]
        row, item, score = np.concatenate((np.repeat(hit, self.count[hit]), row)), np.concatenate((self.item[hit][held], item)), np.concatenate((self.score[hit][held], score))
        order = np.lexsort((item, -score, row))
        row, item, score = row[order], item[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        best = nth < self.k
        self.score[row[best], nth[best]], self.item[row[best], nth[best]] = score[best], item[best]
        self.count[hit] = np.minimum(self.k, np.searchsorted(row, hit, "right") - np.searchsorted(row, hit))
        self.least[hit] = np.where(self.count[hit] == self.k, self.score[hit, self.k - 1], -np.inf)


def _offer(near: list[_Near], ids: np.ndarray, v: np.ndarray, same: bool, mean: np.ndarray) -> None:
    """Show a block of items to groups of queries. Only items whose bound (the highest product with any point of a group's box and ball) reaches what
    some query of it already has are multiplied; products are compared less the items' mean, which changes no query's order. Long items come first, so that little of the rest is left."""
    ok = np.isfinite(_lengths(v))
    if not ok.all():
        for g in near:
            g.add(ids[~ok], v[~ok], same)
        ids, v = ids[ok], v[ok]
    if not len(v):
        return
    w = v - mean
    length = _lengths(w)
    table = lambda name: np.array([getattr(g, name) for g in near])      # noqa: E731
    bounds = np.minimum(table("middle") @ w.T + table("half") @ np.abs(w).T, table("centre") @ w.T + table("radius")[:, None] * length)
    margin = 1e-11 * (length.max() + 2 * _lengths(mean[None])[0])
    bounds = np.minimum(bounds, table("most")[:, None] * length) + (margin * (1 + table("size")))[:, None]
    for g, bound in zip(near, bounds):
        take = np.flatnonzero(bound >= g.floors().min()) if g.finite else np.arange(len(v))
        if len(take) > FIRST and g.finite:
            take = take[np.argsort(-bound[take])]
        at, step = 0, FIRST
        while at < len(take):
            part = take[at:at + step]
            g.add(ids[part], v[part], same, length[part].max() * (1 + 1e-9) + margin)
            at, step = at + step, STEP
            if g.finite and at < len(take):
                take = take[:np.searchsorted(-bound[take], -g.floors().min(), "right")]


def _best_of_blocks(batches, k: int, same: bool, mean: np.ndarray | float = 0.0, unit: bool = True):
    """The best k items of a task's item blocks for every query of its query blocks, whose pairs come one query block after the other.

    ``lot`` names a query block and ``ends`` its groups; without them its ids name it, and it is one group.
    """
    name, near = None, []

    def found():
        for g in near:
            held = np.arange(k) < g.count[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g.ids, g.count)), pa.array(g.item[held]), pa.array(g.score[held])], ["query", "item", "score"])
    for batch in batches:
        qi, qv, ii, iv = (batch.column(c) for c in ("ids", "vectors", "_ids", "_vectors"))
        lot, ends = (batch.column(c) if c in batch.schema.names else other for c, other in (("lot", qi), ("ends", None)))
        for r in range(batch.num_rows):
            if lot[r].as_py() != name:
                yield from found()
                ids, at = qi[r].values.to_numpy(zero_copy_only=False), 0
                name, near, q = lot[r].as_py(), [], np.frombuffer(qv[r].as_py(), "<f8").reshape(len(ids), -1)
                middle = np.broadcast_to(mean, q.shape[1:])
                for end in [len(ids)] if ends is None else ends[r].as_py():
                    near.append(_Near(ids[at:end], q[at:end], k, middle, unit))
                    at = end
            ids = ii[r].values.to_numpy(zero_copy_only=False)
            _offer(near, ids, np.frombuffer(iv[r].as_buffer(), "<f8").reshape(len(ids), -1), same, middle)
    yield from found()


def catalogue_top_k(queries: DataFrame, items: DataFrame, k: int, query_id: str = "USER_ID", item_id: str = "ITEM_ID", vector: str = "embedding",
                    block: int = 1024, same: bool = True) -> DataFrame:
    """(query id, item id, score, rank): the k items of the whole catalogue with the highest dot product, for every query; equal
    scores go by item id. Ids are whole numbers; ``same=False`` leaves out an item with the query's own id. Rows without a vector take no part.

    Queries are dealt into groups near each other (a range shuffle by the coordinate that decides most, then halves), items into plain blocks, and both
    written. Each task reads some query blocks and a part of the item blocks as they were written, so blocks are neither shuffled nor broadcast; for a
    group it multiplies only the items that a bound over the group cannot rule out. The result is exact: with vectors that lie without any order all
    pairs are multiplied. k items a query and part of the items leave the tasks and are merged by query with a group limit.
    """
    def rows(df, id_col):
        return materialize(df.filter(F.size(vector) > 0).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")), "vectors")

    def packed(df, weight=None, size=block * 8):
        t = df.mapInArrow(lambda b: _packed(b, most(size * GROUPS if weight is not None else size), size, weight, unit), "ids array<bigint>, vectors binary, ends array<int>")
        return materialize(t.withColumn("lot", F.monotonically_increasing_id()), "vector-blocks")
    def long_first(df):
        far = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
        return df.withColumn("_far", far).repartitionByRange(max(cores, -(-df.count() // CHUNK)), F.desc("_far")).sortWithinPartitions(F.desc("_far")).drop("_far")
    q, i = rows(queries, query_id), rows(items, item_id)
    n_q, cores = q.count(), max(1, q.sparkSession.sparkContext.defaultParallelism)
    mean, spread, _ = _coordinates(i)
    unit, d = not _coordinates(q)[2].any(), max(1, len(mean))       # a coordinate that never varies (an intercept): the queries are scaled already

    def most(size):
        return max(1, min(size, ROW_BYTES // (8 * d)))
    size = most(block)
    if len(mean) and n_q:
        scaled = _coordinates(q, unit)[1] * spread
        key, tasks = F.element_at("v", int(scaled.argmax()) + 1), max(cores, -(-n_q // CHUNK))
        if unit:
            key = key / F.sqrt(F.aggregate("v", F.lit(1e-300), lambda a, x: a + x * x))
        q = q.repartitionByRange(tasks, key)
        q, i = packed(q, spread + 1e-300, max(1, min(size, n_q // (4 * cores)))), packed(long_first(i))
    else:
        q, i = packed(q), packed(i)
    n_lots, n_blocks = q.count(), i.count()
    parts = min(max(1, n_blocks), max(-(-n_blocks * most(block * 8) * 8 * d // TASK_BYTES), -(-cores // max(1, n_lots))))
    q = q.repartition(max(1, min(n_lots, 4 * cores)), "lot").select("lot", "ids", "vectors", "ends")
    # row numbers rise with the tables' order, so that each part gets its long items first
    i = i.repartition(parts).sortWithinPartitions("lot").select(F.col("ids").alias("_ids"), F.col("vectors").alias("_vectors"))
    part = q.crossJoin(i.hint("shuffle_replicate_nl")).mapInArrow(lambda b: _best_of_blocks(b, k, same, mean, unit), "query bigint, item bigint, score double")
    return top_k_per_user(part, k, "query", "item").select(F.col("query").alias(query_id), F.col("item").alias(item_id), "score", "rank")


# ----------------------------------------------------------------- M18-M21: uplift curve


def qini_curve(df: DataFrame, score_col: str, treatment_col: str, outcome_col: str = "OUTCOME", buckets: int = 10, tie_cols: Sequence[str] = ()) -> DataFrame:
    """(bucket, n, qini, random): extra outcomes among the rows of highest score, bucket by bucket, and what a random order would give.

    qini = outcomes of the treated minus those of the others, scaled to as many rows. Rows are ranked by a range sort and per-piece sums.
    """
    t = F.col(treatment_col).cast("boolean")
    y = F.col(outcome_col).cast("double")
    d = df.filter(t.isNotNull()).select((-F.col(score_col)).alias("_s"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(tie_cols)], F.lit(0).alias("_g"),
                                        F.lit(1).alias("_1"), t.cast("int").alias("_t"), F.when(t, y).otherwise(0.0).alias("_yt"), F.when(t, 0.0).otherwise(y).alias("_yc"))
    order = ["_s", *[f"_k{i}" for i in range(len(tie_cols))]]
    p = range_pieces(d, ["_g"], order)
    total = p.count()
    r = with_running_sums(p, ["_g"], order, {"n": "_1", "nt": "_t", "yt": "_yt", "yc": "_yc"})
    ends = sorted({-(-total * b // buckets) for b in range(1, buckets + 1)} - {0})
    r = r.filter(F.col("n").isin(ends)).select(F.floor(F.col("n") * buckets / F.lit(max(1, total))).cast("int").alias("bucket"), F.col("n").cast("long").alias("n"),
                                               (F.col("yt") - F.coalesce(F.col("yc") * F.col("nt") / F.nullif(F.col("n") - F.col("nt"), F.lit(0)), F.lit(0.0))).alias("qini"))
    whole = r.agg(F.max_by("qini", "n").alias("_q"))     # at most one row a bucket
    return r.crossJoin(F.broadcast(whole)).select("bucket", "n", "qini", (F.col("_q") * F.col("n") / F.lit(float(max(1, total)))).alias("random"))
