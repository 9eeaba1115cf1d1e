"""Operator 6: embedding near-duplicates by spherical k-means cells.

1. Equal vectors of one label become one row with its number of copies.
2. Spherical k-means (cosine) is fitted on a bounded sample (``SAMPLE`` vectors of each length, the first by a hash); every vector is
   assigned to its nearest centre, its home cell.
3. Vectors within the cosine threshold are at most ``r = sqrt(2 - 2 t)`` apart. If a vector's partner has its home
   in cell c, then ``v.home - v.c <= r |home - c|``, so the vector also visits every cell (of a higher number than its
   own) for which that holds; no link is lost at a cell border.
4. Within a cell, blocks of vectors are compared by matrix products in double precision: home blocks with home blocks and with
   visiting blocks. Blocks are cut after a range sort by (label, cell, vector), so a crowded cell spreads over tasks.
5. A block pair sends link counts and at most one edge for each linked vector; components of these edges are the groups, and the vector
   with the smallest id of a group is kept.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null
label, have no links and are their own group; vectors of different length never link; repeated rows link to each other; a null id is
never the smallest id of a group; an empty table gives an empty result; only the three named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.llm.common import components, in_tasks, link_labels, register, shuffle_partitions, table
from ranklab.session import cut_lineage

THRESHOLD = 0.98
SAMPLE = 20_000
MAX_CELLS = 1024
ROUNDS = 10


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``k`` unit centres of the unit rows ``x``; an emptied cell starts anew at the row that fits worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        score = x @ centres.T
        home = score.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        worst = np.argsort(score.max(1))
        for i, j in zip(np.flatnonzero(norm < 1e-12), worst):
            sums[i], norm[i] = x[j], 1.0
        centres = sums / norm[:, None]
    return centres


def _unit(batch):
    """The batch's rows by length: {length: (row numbers, unit vectors, vectors as given)}."""
    col = batch.column("embedding")
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    out = {}
    for d in np.unique(size):
        i = np.flatnonzero(size == d)
        x = flat[start[i][:, None] + np.arange(d)]
        out[int(d)] = i, normed(x), x
    return out


def normed(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1)[:, None]


def _assign(batch, centres: dict, reach: float):
    label, g, n = (batch.column(c).to_numpy() for c in ("label", "g", "n"))
    for d, (rows, x, given) in _unit(batch).items():
        c = centres.get(d)
        if c is None:  # a length that the sample does not hold: one cell
            c = np.eye(1, d)
        score = x @ c.T
        home = score.argmax(1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        best = score[np.arange(len(x)), home]
        visit = (best[:, None] - score <= reach * apart[home] + 1e-9) & (np.arange(len(c))[None, :] > home[:, None])
        a, cell = np.nonzero(visit)
        who, cell = np.concatenate((np.arange(len(x)), a)), np.concatenate((home, cell))
        at_home = np.arange(len(who)) < len(x)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(given.itemsize * d), len(who), [None, pa.py_buffer(np.ascontiguousarray(given[who]))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(label[rows[who]], pa.int64()), pa.array(np.full(len(who), d, np.int32)), pa.array(cell.astype(np.int32)),
             pa.array(at_home), pa.array(g[rows[who]]), pa.array(n[rows[who]]), raw.cast(pa.binary())],
            ["label", "dim", "cell", "home", "g", "n", "v"])


def _blocks(batch):
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "dim", "cell", "home")])
    cut = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0))))
    end = [*cut[1:], batch.num_rows]
    g, n, v = batch.column("g").to_numpy(), batch.column("n").to_numpy(), batch.column("v").to_pylist()
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys[0][cut]), pa.array(keys[1][cut].astype(np.int32)), pa.array(keys[2][cut].astype(np.int32)), pa.array(keys[3][cut] > 0),
         pa.array(g[cut]), *[pa.array([part(a, b) for a, b in zip(cut, end)], pa.binary())
                             for part in (lambda a, b: g[a:b].tobytes(), lambda a, b: n[a:b].tobytes(), lambda a, b: b"".join(v[a:b]))]],
        ["label", "dim", "cell", "home", "first", "gs", "ns", "vs"])


def _links(batch, threshold: float, kind: str):
    out = []
    for r in batch.to_pylist():
        ga, gb, na, nb = (np.frombuffer(r[c], np.int64) for c in ("gs", "gs2", "ns", "ns2"))
        a, b = (normed(np.frombuffer(r[c], np.dtype(kind)).reshape(-1, r["dim"])) for c in ("vs", "vs2"))
        linked = a @ b.T >= threshold
        same = r["home"] and r["first"] == r["first2"]
        if same:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        node, label = link_labels(linked, ga, gb)
        where = dict(zip(node.tolist(), label.tolist()))
        sides = [(ga, linked @ nb)] if same else [(ga, linked @ nb), (gb, na @ linked)]
        out += [(int(x), int(k), where[int(x)]) for ids, count in sides for x, k in zip(ids, count) if k]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["g", "links", "label"])


def usable(vector, label) -> F.Column:
    """Vectors that can link."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, sample: int = SAMPLE, cells: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    single = v.schema["embedding"].dataType.simpleString() == "array<float>"
    if not single:               # whole numbers, decimals: compared as doubles
        v = v.withColumn("embedding", F.col("embedding").cast("array<double>"))
    ok = usable(F.col("embedding"), F.col("label"))
    one = v.filter(ok).groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    one = cut_lineage(one.withColumn("g", F.monotonically_increasing_id()))
    # the largest label of each length sets the number of cells: enough to keep cells small, few enough that visits stay rare
    sizes = one.groupBy(F.size("embedding").alias("d"), "label").agg(F.count(F.lit(1)).alias("k")).groupBy("d").agg(F.max("k").alias("k"))
    sizes = {r["d"]: r["k"] for r in sizes.orderBy(F.desc("k"), "d").limit(16).collect()}
    centres = {}
    for d, k in sizes.items():
        rows = one.filter(F.size("embedding") == d).orderBy(F.xxhash64("embedding")).limit(sample).select("embedding", "g")
        batch = pa.Table.from_pandas(rows.toPandas()).combine_chunks().to_batches()[0]
        centres[d] = spherical_kmeans(_unit(batch)[d][1], cells or min(MAX_CELLS, max(1, round(math.sqrt(k) / 16))))
    near = one.select("label", "g", "n", "embedding").transform(in_tasks(
        _assign, "label long, dim int, cell int, home boolean, g long, n long, v binary", centres, math.sqrt(2 - 2 * threshold)))
    order = ["label", "dim", "cell", "home", "g"]
    blocks = cut_lineage(near.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).transform(in_tasks(
        _blocks, "label long, dim int, cell int, home boolean, first long, gs binary, ns binary, vs binary")))
    right = blocks.filter("home").select("label", "dim", "cell", *[F.col(c).alias(f"{c}2") for c in ("first", "gs", "ns", "vs")])
    pairs = blocks.join(right, ["label", "dim", "cell"]).filter("not home or first <= first2")
    links = cut_lineage(pairs.repartition(shuffle_partitions(spark)).transform(
        in_tasks(_links, "g long, links long, label long", threshold, "<f4" if single else "<f8")))
    counts = links.groupBy("g").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("g").alias("u"), F.col("label").alias("v")))
    linked = groups.join(one.select("g", "low"), groups["node"] == F.col("g")).select("g", "component", "low")
    least = linked.groupBy("component").agg(F.min("low").alias("least"))
    linked = linked.join(least, "component").select("g", "least")
    known = one.select("g", "label", "embedding", "low", "n").join(counts, "g", "left").join(linked, "g", "left").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    # a written table: both sides of the join are then shuffled, so that Spark can split a hot vector's rows
    found = v.filter(ok).join(cut_lineage(known), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = v.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@register("op6_embedding_near_duplicates", f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
         AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {THRESHOLD}),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id,
       coalesce(c.low, v.vec_id) >= v.vec_id AS kept
FROM v LEFT JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a""")
def op6_embedding_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
