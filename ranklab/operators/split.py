"""Train / valid / test splits.

Every split is a lazy DataFrame with one extra column ``split`` in
{'train','valid','test'}; the three frames of the reference become one table
that can be written ``partitionBy("split")``.

Scale notes
-----------
* Global positional cuts (temporal, random) never run an un-partitioned
  window over the data. ``positional_segments`` counts rows per bucket of the
  ordering key (partial aggregation into at most 65,536 buckets), turns the
  bucket counts into exact offsets, and orders only the rows of the at most
  ``len(cuts)`` buckets that a cut falls into.
* Per-user splits never put a whole user's history in one task:
  ``leave_last_n`` keeps ``row_number() <= n`` (a WindowGroupLimit that prunes
  every user, including a hot one, to n rows per task before the shuffle);
  ``random_split_per_user`` works on (user, hash bucket) groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklab.functions.columns import col, seeded_hash
from ranklab.session import cut_lineage, materialize

SPLITS = ("train", "valid", "test")
_MASK33 = (1 << 33) - 1


class DegenerateSplit(ValueError):
    """A requested split came out empty."""


def _ordered(cols: Sequence) -> list[Column]:
    return [col(c) for c in cols]


def cumulative_before(df: DataFrame, order_cols: Sequence, weight: str | None = None,
                      out: str = "_before") -> DataFrame:
    """Exact sum of ``weight`` (1 per row when None) over all rows before each row.

    ``order_cols`` must define a total order (unique). Distributed: a range
    partitioned sort, a reliable checkpoint that freezes partition ids, the
    in-partition position (or a running sum partitioned by the frozen id), and
    one offset per partition - a table bounded by the partition count - that is
    broadcast back.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    s = df.withColumn("_w", w).orderBy(*_ordered(order_cols)).withColumn("_mid", F.monotonically_increasing_id())
    s = cut_lineage(s).withColumn("_part", F.shiftright("_mid", 33))
    if weight is None:
        local = s.withColumn("_local", F.col("_mid").bitwiseAND(F.lit(_MASK33)))
    else:
        wl = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        local = s.withColumn("_local", F.coalesce(F.sum("_w").over(wl), F.lit(0)))
    totals = s.groupBy("_part").agg(F.sum("_w").alias("_tot"))
    offsets = totals.withColumn(
        "_off", F.coalesce(F.sum("_tot").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0))).select("_part", "_off")
    return (local.join(F.broadcast(offsets), "_part")
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_w", "_mid", "_part", "_local", "_off"))


def prefix_sums(df: DataFrame, order_cols: Sequence, weights: dict) -> DataFrame:
    """Several exclusive running sums in ONE distributed pass: for each
    ``out -> weight column`` pair, the sum of the weight over all rows before
    each row in the total order ``order_cols`` (one sort, one checkpoint, one
    per-partition offset table bounded by the partition count)."""
    names = list(weights)
    s = df.withColumns({f"_w{i}": F.col(weights[n]).cast("long") for i, n in enumerate(names)})
    s = s.orderBy(*_ordered(order_cols)).withColumn("_mid", F.monotonically_increasing_id())
    s = cut_lineage(s).withColumn("_part", F.shiftright("_mid", 33))
    wl = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumns({f"_l{i}": F.coalesce(F.sum(f"_w{i}").over(wl), F.lit(0)) for i in range(len(names))})
    tot = s.groupBy("_part").agg(*[F.sum(f"_w{i}").alias(f"_t{i}") for i in range(len(names))])
    wo = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = tot.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(wo), F.lit(0)).alias(f"_o{i}")
                                    for i in range(len(names))])
    out = local.join(F.broadcast(offsets), "_part").withColumns(
        {n: (F.col(f"_o{i}") + F.col(f"_l{i}")).cast("long") for i, n in enumerate(names)})
    tmp = [f"_{x}{i}" for i in range(len(names)) for x in ("w", "l", "o")]
    return out.drop("_mid", "_part", *tmp)


MAX_BUCKETS = 1 << 16


def time_bucket(df: DataFrame, ts_col: str, n_buckets: int = MAX_BUCKETS) -> Column:
    """Monotone bucket of a time column with at most ``n_buckets`` values
    (equal-width over [min, max]; one small aggregation). Numeric columns are
    taken as epoch values; timestamp and date columns as wall-clock microseconds."""
    from pyspark.sql import types as T
    dt = df.schema[ts_col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        val = (f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
               f"CAST(`{ts_col}` AS TIMESTAMP_NTZ))")
    else:
        val = f"CAST(`{ts_col}` AS BIGINT)"
    lo, hi = df.agg(F.min(F.expr(val)), F.max(F.expr(val))).first()
    if lo is None:
        return F.lit(0).cast("long")
    width = max(1, -(-(int(hi) - int(lo) + 1) // n_buckets))
    return F.expr(f"({val} - {int(lo)}) div {width}")


def _content(df: DataFrame) -> Column:
    """Hash of a whole row: the last ordering key, so that only equal rows tie (map columns cannot be hashed and are left out)."""
    from pyspark.sql import types as T
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])


def _literal(values, fields) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, fields)])


def _numbered_copies(df: DataFrame, out: str = "_copy") -> DataFrame:
    """Equal rows numbered from 0: one counted row each, spread out again (so no task holds or sorts the copies)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn(
        out, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")


def _locate(df: DataFrame, bucket: Column, cuts_fn: Callable[[int], list[int]]) -> tuple[list, int, list[int], list]:
    """(bucket, first position, rows) of every bucket; number of rows; cuts; and for each cut inside the rows its bucket's entry after it."""
    rows = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c")).limit(MAX_BUCKETS + 1).collect()
    if len(rows) > MAX_BUCKETS:
        raise ValueError(f"bucket expression must take at most {MAX_BUCKETS} values")
    if any(r["_b"] is None for r in rows):
        raise ValueError("ordering columns must not be null")
    rows.sort(key=lambda r: r["_b"])
    hist, before = [], 0
    for r in rows:
        hist.append((r["_b"], before, r["_c"]))
        before += r["_c"]
    n = before
    cuts = [int(c) for c in cuts_fn(int(n))]
    located = [next((c, bk, bf, cnt) for bk, bf, cnt in hist if bf <= c < bf + cnt) for c in cuts if 0 < c < n]
    return hist, n, cuts, located


def positional_segments(df: DataFrame, order_cols: Sequence[str], bucket: Column,
                        cuts_fn: Callable[[int], list[int]], out: str = "_seg") -> tuple[DataFrame, int]:
    """Segment index of every row = number of cut positions <= its 0-based position in the order ``order_cols``, then row content.

    ``bucket`` must be non-decreasing along ``order_cols`` and take at most
    ``MAX_BUCKETS`` values (a hash prefix, or ``time_bucket``). One partial
    aggregation yields the per-bucket counts - a table bounded by
    construction, so it comes back to the driver - from which every bucket's
    first position is known. The rows of the buckets that a cut falls into (and no others) are ordered by one
    distributed prefix count, which gives the row at each cut. The
    segment of every row is then one projection: comparisons of its ordering
    key (null first, as in the sort) with those few threshold keys.

    Cuts are positional through ties: rows of equal key are told apart by their content, and where equal
    rows straddle a cut, as many of them as belong there go to either side.
    ``cuts_fn(n)`` turns the row count into ascending cut positions.
    Returns (frame, n).
    """
    hist, n, cuts, located = _locate(df, bucket, cuts_fn)
    edge, first = [], {}
    for bk in sorted({bk for c, bk, bf, _ in located if c > bf}):
        first[bk] = sum(cnt for b, _, cnt in hist if b in edge)  # first position of the bucket among the edge rows
        edge.append(bk)
    # a row's content is hashed only where a cut falls into its bucket
    tie = F.when(F.col("_bk").isin(edge), _content(df)) if edge else F.lit(None).cast("long")
    d = df.withColumn("_bk", bucket).withColumn("_tie", tie)
    names = [*order_cols, "_tie"]
    fields = [d.schema[c] for c in names]
    key = F.struct(*[F.col(c) for c in names])
    thresholds = {}  # cut -> (key at the cut, rows of the same key before the cut)
    if edge:
        pos = cumulative_before(d.filter(F.col("_bk").isin(edge)).select("_bk", *names), ["_bk", *names], out="_p")
        at = {c: first[bk] + c - bf for c, bk, bf, _ in located if c > bf}
        got = {r["_p"]: tuple(r[x] for x in names) for r in pos.filter(F.col("_p").isin(list(at.values()))).collect()}
        starts = pos.agg(*[F.min(F.when(F.struct(*names) == _literal(got[p], fields), F.col("_p"))).alias(f"s{c}") for c, p in at.items()]).first()
        thresholds = {c: (got[p], p - starts[f"s{c}"]) for c, p in at.items()}
    seg = F.lit(sum(1 for c in cuts if c <= 0))
    split_keys: dict = {}
    for c, bk, bf, _ in located:
        b = F.col("_bk")
        if c == bf:
            above = b >= F.lit(bk)
        else:
            values, ahead = thresholds[c]
            thr = _literal(values, fields)
            if ahead:
                split_keys.setdefault(values, []).append(ahead)
            above = (b > F.lit(bk)) | ((b == F.lit(bk)) & ((key > thr) if ahead else (key >= thr)))
        seg = seg + above.cast("int")
    d = d.withColumn(out, seg)
    if split_keys:  # equal rows on both sides of a cut
        same = F.lit(False)
        extra = F.lit(0)
        for values, aheads in split_keys.items():
            eq = key == _literal(values, fields)
            same = same | F.coalesce(eq, F.lit(False))
            extra = extra + F.when(eq, sum((F.col("_copy") >= a).cast("int") for a in aheads)).otherwise(0)
        equal = _numbered_copies(d.filter(same)).withColumn(out, F.col(out) + extra).drop("_copy")
        d = d.filter(~same).unionByName(equal)
    return d.drop("_bk", "_tie"), n


def _label(seg: Column) -> Column:
    return F.when(seg == 0, "train").when(seg == 1, "valid").otherwise("test")


def _check_fractions(valid_fraction: float, test_fraction: float) -> None:
    for name, v in (("valid_fraction", valid_fraction), ("test_fraction", test_fraction)):
        if v is None or not (0.0 <= float(v) < 1.0):
            raise ValueError(f"{name} must be in [0, 1), got {v!r}")
    if float(valid_fraction) + float(test_fraction) >= 1.0:
        raise ValueError("valid_fraction + test_fraction must be < 1 so train is not empty")


def _sizes(n: int, valid_fraction: float, test_fraction: float) -> tuple[int, int, int]:
    n_test = int(n * float(test_fraction) // 1)
    n_valid = int(n * float(valid_fraction) // 1)
    return n - n_valid - n_test, n_valid, n_test


def temporal_split(df: DataFrame, valid_fraction: float = 0.1, test_fraction: float = 0.1,
                   timestamp_col: str = "TIMESTAMP", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Latest floor(n*test) rows -> test, the floor(n*valid) before -> valid, rest train.

    The cut is positional even through equal timestamps: ``tiebreak`` columns decide ties (null first), then
    the rows' content; equal rows are divided by number.
    """
    _check_fractions(valid_fraction, test_fraction)
    if timestamp_col not in df.columns:
        raise ValueError(f"temporal split needs the timestamp column {timestamp_col!r}")

    def cuts(n):
        n_train, n_valid, _ = _sizes(n, valid_fraction, test_fraction)
        return [n_train, n_train + n_valid]

    out, _ = positional_segments(df, [timestamp_col, *tiebreak], time_bucket(df, timestamp_col), cuts)
    return out.withColumn("split", _label(F.col("_seg"))).drop("_seg")


def temporal_split_narrow(df: DataFrame, whole: Callable[[Column], DataFrame], valid_fraction: float = 0.1, test_fraction: float = 0.1,
                          timestamp_col: str = "TIMESTAMP", tiebreak: Sequence[str] = ()) -> DataFrame:
    """X1 over rows of which only a few columns are read later: the labels of ``temporal_split`` over whole rows, on ``df``'s columns.

    ``df`` has every row with its timestamp; ``whole(f)`` gives the whole rows whose timestamp passes the filter ``f``. Tiebreaks and
    content decide only within the time buckets that a cut falls into, so only those buckets' rows are read whole (and written once);
    the label of every other row follows from its bucket.
    """
    _check_fractions(valid_fraction, test_fraction)

    def cuts(n):
        n_train, n_valid, _ = _sizes(n, valid_fraction, test_fraction)
        return [n_train, n_train + n_valid]

    bucket = time_bucket(df, timestamp_col)
    hist, n, at, located = _locate(df, bucket, cuts)
    edge = sorted({bk for c, bk, bf, _ in located if c > bf})
    seg = F.lit(sum(1 for c in at if c <= 0))
    for c, bk, bf, _ in located:
        seg = seg + ((bucket > F.lit(bk)) if c > bf else (bucket >= F.lit(bk))).cast("int")
    rest = (df.filter(~bucket.isin(edge)) if edge else df).withColumn("split", _label(seg))
    if not edge:
        return rest
    rows = materialize(whole(bucket.isin(edge)), "edge-rows")
    inside = {c: sum(cnt for b, _, cnt in hist if b in edge and b < bk) + (c - bf if bk in edge else 0) for c, bk, bf, _ in located}
    # a cut before all rows stays before the edge rows, one behind all rows behind them
    parts, _ = positional_segments(rows, [timestamp_col, *tiebreak], bucket, lambda m: [0 if c <= 0 else inside.get(c, m) for c in at])
    return rest.unionByName(parts.withColumn("split", _label(F.col("_seg"))).select(*rest.columns))


def random_split(df: DataFrame, valid_fraction: float = 0.1, test_fraction: float = 0.1,
                 random_state: int = 42, key_cols: Sequence[str] | None = None) -> DataFrame:
    """Rows ordered by md5(seed|key); the first floor(n*valid) -> valid, next floor(n*test) -> test."""
    _check_fractions(valid_fraction, test_fraction)
    key_cols = list(key_cols or df.columns)
    h = seeded_hash(random_state, *key_cols)
    tmp = df.withColumn("_h", h)

    def cuts(n):
        _, n_valid, n_test = _sizes(n, valid_fraction, test_fraction)
        return [n_valid, n_valid + n_test]

    # 65,536 hash-prefix buckets: uniform by construction, so the boundary
    # buckets hold ~n/65536 rows each and are the only ones sorted.
    out, _ = positional_segments(tmp, ["_h", *key_cols], F.substring("_h", 1, 4), cuts)
    seg = F.col("_seg")
    lab = F.when(seg == 0, "valid").when(seg == 1, "test").otherwise("train")
    return out.withColumn("split", lab).drop("_seg", "_h")


def leave_last_n_per_user(df: DataFrame, n_valid: int = 1, n_test: int = 1, user_col: str = "USER_ID",
                          timestamp_col: str = "TIMESTAMP", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Per user, the last n_test rows -> test, the n_valid before -> valid.

    Users with at most n_valid + n_test rows stay wholly in train (counted by
    ``holdout_report`` as users without a hold-out).

    Skew-safe: the per-user tail is ``row_number() <= n_valid + n_test`` (a
    WindowGroupLimit, so every task keeps at most that many rows per user),
    row counts come from a partial aggregation, and the two per-user
    thresholds (the n_test-th and the (n_valid+n_test)-th latest key) join
    back on the user - one row per user, which AQE's skew-join handling can
    split against a hot user's rows.
    """
    if n_valid < 0 or n_test < 0 or n_valid + n_test == 0:
        raise ValueError("n_valid and n_test must be >= 0 and not both 0")
    if timestamp_col not in df.columns:
        raise ValueError(f"leave_last_n_per_user needs the timestamp column {timestamp_col!r}")
    k = n_valid + n_test
    key_cols = [timestamp_col, *tiebreak, "_tie"]
    d = df.withColumn("_tie", _content(df))
    key = F.struct(*[F.col(c) for c in key_cols])
    w = Window.partitionBy(user_col).orderBy(*[F.col(c).desc_nulls_last() for c in key_cols])
    tail = d.select(user_col, *key_cols).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    thr = tail.groupBy(user_col).agg(
        F.max(F.when(F.col("_rn") == n_test, key)).alias("_thr_test"),
        F.max(F.when(F.col("_rn") == k, key)).alias("_thr_hold"), F.collect_list(F.struct("_rn", key.alias("key"))).alias("_tail"))
    # of the rows equal to a threshold, so many belong above it
    def above(t, m):
        return F.size(F.filter("_tail", lambda x: (x["key"] == F.col(t)) & (x["_rn"] <= m)))
    quota = [above("_thr_test", n_test), above("_thr_hold", k)]
    thr = thr.select(F.col(user_col).alias("_user"), "_thr_test", "_thr_hold", quota[0].alias("_q_test"), quota[1].alias("_q_hold"))
    counts = df.groupBy(F.col(user_col).alias("_user")).agg(F.count(F.lit(1)).alias("_n"))
    thr = thr.join(counts, thr["_user"].eqNullSafe(counts["_user"])).filter(F.col("_n") > k).drop(counts["_user"]).drop("_n")
    j = d.join(thr, F.col(user_col).eqNullSafe(F.col("_user")), "left").drop("_user")
    at_test, at_hold = F.coalesce(key == F.col("_thr_test"), F.lit(False)), F.coalesce(key == F.col("_thr_hold"), F.lit(False))
    lab = (F.when(F.col("_thr_hold").isNull(), "train").when(F.coalesce(key > F.col("_thr_test"), F.lit(False)), "test")
           .when(key > F.col("_thr_hold"), "valid").otherwise("train"))
    plain = j.filter(~(at_test | at_hold)).withColumn("split", lab)
    # rows at a threshold: usually one a user; copies of one row are numbered and divided
    edge = _numbered_copies(j.filter(at_test | at_hold))
    edge = edge.withColumn("split", F.when(at_test & (F.col("_copy") < F.col("_q_test")), "test")
                           .when(at_hold & (F.col("_copy") < F.col("_q_hold")), "valid")
                           .when(at_test & (key > F.col("_thr_hold")), "valid").otherwise("train"))
    temp = ["_tie", "_thr_test", "_thr_hold", "_q_test", "_q_hold"]
    return plain.drop(*temp).unionByName(edge.drop("_copy", *temp))


def random_split_per_user(df: DataFrame, valid_fraction: float = 0.1, test_fraction: float = 0.1,
                          random_state: int = 42, user_col: str = "USER_ID",
                          key_cols: Sequence[str] | None = None) -> DataFrame:
    """Per user, rows ordered by md5(seed|key); first floor(cnt*valid) -> valid,
    next floor(cnt*test) -> test, the rest (always >= 1 row) -> train.

    Skew-safe: rows are counted per (user, 4-hex-digit hash bucket) - at most
    65,536 histogram rows per user, so the per-user prefix sum runs over a
    bounded group - and join back on (user, bucket), which spreads a hot user
    over 65,536 keys. Only rows of buckets that a cut falls into are ordered,
    within (user, bucket) groups of about n_user/65,536 rows.
    """
    _check_fractions(valid_fraction, test_fraction)
    key_cols = list(key_cols or df.columns)
    d = df.withColumn("_h", seeded_hash(random_state, *key_cols)).withColumn("_b", F.substring("_h", 1, 4))
    hist = d.groupBy(user_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(user_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = (hist.withColumn("_bf", F.coalesce(F.sum("_c").over(before), F.lit(0)))
            .withColumn("_n", F.sum("_c").over(Window.partitionBy(user_col))))
    nv = F.floor(F.col("_n") * F.lit(float(valid_fraction))).cast("long")
    nt = F.floor(F.col("_n") * F.lit(float(test_fraction))).cast("long")
    hist = hist.withColumn("_nv", nv).withColumn("_nvt", nv + nt)
    bf, end = F.col("_bf"), F.col("_bf") + F.col("_c")
    straddle = ((bf < F.col("_nv")) & (F.col("_nv") < end)) | ((bf < F.col("_nvt")) & (F.col("_nvt") < end))
    hist = hist.withColumn("_edge", straddle).drop("_c", "_n")
    j = d.join(hist, [user_col, "_b"])

    def label(pos):
        return F.when(pos < F.col("_nv"), "valid").when(pos < F.col("_nvt"), "test").otherwise("train")

    plain = j.filter(~F.col("_edge")).withColumn("split", label(F.col("_bf")))
    wi = Window.partitionBy(user_col, "_b").orderBy("_h", *[F.col(c) for c in key_cols])
    edge = j.filter(F.col("_edge")).withColumn("split", label(F.col("_bf") + F.row_number().over(wi) - 1))
    drop = ["_h", "_b", "_bf", "_nv", "_nvt", "_edge"]
    return plain.drop(*drop).unionByName(edge.drop(*drop))


def leave_n_users_out(df: DataFrame, n_valid_users: int, n_test_users: int, random_state: int = 42,
                      user_col: str = "USER_ID") -> DataFrame:
    """Whole users held out; users ordered by md5(seed|user), first n_valid -> valid, next n_test -> test.

    Users are cut by position in the hash order, distributed like ``random_split``; the held-out users
    join back on the user, and Spark picks the join by their size.
    """
    if n_valid_users < 0 or n_test_users < 0 or n_valid_users + n_test_users == 0:
        raise ValueError("n_valid_users and n_test_users must be >= 0 and not both 0")
    users = df.select(user_col).distinct().withColumn("_h", seeded_hash(random_state, user_col))
    seg, _ = positional_segments(users, ["_h", user_col], F.substring("_h", 1, 4), lambda n: [n_valid_users, n_valid_users + n_test_users])
    chosen = seg.filter(F.col("_seg") < 2).select(
        F.col(user_col).alias("_user"), F.when(F.col("_seg") == 0, "valid").otherwise("test").alias("_held"))
    return (df.join(chosen, F.col(user_col).eqNullSafe(F.col("_user")), "left")
            .withColumn("split", F.coalesce(F.col("_held"), F.lit("train"))).drop("_held", "_user"))


STRATEGIES = {
    "temporal": temporal_split,
    "leave_last_n_per_user": leave_last_n_per_user,
    "random_split_per_user": random_split_per_user,
    "leave_n_users_out": leave_n_users_out,
    "random_split": random_split,
}


def split(df: DataFrame, strategy: str, check: bool = True, **params) -> DataFrame:
    """X6 dispatcher with argument guards; raises ``DegenerateSplit`` where the requested validation part is empty.

    ``check=False`` leaves the guard (one aggregation) to the caller.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown split strategy {strategy!r}; choose one of {sorted(STRATEGIES)}")
    out = STRATEGIES[strategy](df, **params)
    if check:
        asked = next((params[k] for k in ("valid_fraction", "n_valid", "n_valid_users") if k in params), 1)
        check_not_degenerate(out, params.get("user_col", "USER_ID"), want_valid=asked > 0)
    return out


def split_info(split_df: DataFrame, timestamp_col: str | None = "TIMESTAMP") -> DataFrame:
    """Rows and time range per split (one partial aggregation)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if timestamp_col and timestamp_col in split_df.columns:
        aggs += [F.min(timestamp_col).alias("min_ts"), F.max(timestamp_col).alias("max_ts")]
    return split_df.groupBy("split").agg(*aggs)


def holdout_report(split_df: DataFrame, user_col: str = "USER_ID") -> DataFrame:
    """Users that kept every row in train (too short for a hold-out) versus
    users with held-out rows - one partial aggregation per user, then one row."""
    per_user = split_df.groupBy(user_col).agg(F.bool_and(F.col("split") == "train").alias("_train_only"))
    return per_user.agg(F.count(F.lit(1)).alias("n_users"),
                        F.count_if(F.col("_train_only")).alias("n_users_without_holdout"),
                        F.count_if(~F.col("_train_only")).alias("n_users_with_holdout"))


def check_not_degenerate(split_df: DataFrame, user_col: str = "USER_ID", want_valid: bool = True) -> dict:
    """Refuse a split whose requested valid part is empty; explain one-row users."""
    counts = {r["split"]: r["n_rows"] for r in split_info(split_df, None).collect()}  # <= 3 rows
    if want_valid and counts.get("valid", 0) == 0:
        max_per_user = (split_df.groupBy(user_col).count().agg(F.max("count")).first()[0]
                        if user_col in split_df.columns else None)
        hint = ("every user has a single row, so a per-user hold-out cannot leave anything in train; "
                "use a random or temporal split" if max_per_user == 1 else
                "increase the validation fraction or count")
        raise DegenerateSplit(f"validation split is empty ({counts}); {hint}")
    return counts


def recommend_strategy(profile: dict) -> str:
    """Timestamps -> temporal; sequential -> leave-last-n; cold start -> users out; else per-user random."""
    if profile.get("sequential"):
        return "leave_last_n_per_user"
    if profile.get("cold_start"):
        return "leave_n_users_out"
    if profile.get("has_timestamps"):
        return "temporal"
    return "random_split_per_user"
