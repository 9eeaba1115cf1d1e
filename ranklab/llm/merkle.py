"""Operator 13: Merkle manifest of a dataset, by checkpoint and recompute.

Every row is a leaf, the hash of its fields. The leaves of a source, in order of id, are the bottom of a tree of arity
``ARITY``; the subroots of the sources, in order of source, are the bottom of a second tree whose top is the root.

Only every ``STEP``-th level is stored, as aligned subtrees: a stored row holds the up to ``ARITY ** STEP`` nodes below one node
of the next stored level. The levels between are never written. To extract proofs, each aligned subtree is
regenerated from its stored nodes, the siblings of each of its nodes are emitted, and the regenerated nodes are
dropped. A subtree gets the proof of its top node from the subtree above (one row for each), so the walk goes from the
root down, stored level by stored level, and no task holds more than a subtree and a path.

Leaves get their places by a range sort and per-piece counts, so one source, however large, spans all tasks. Texts
are read once; from then on a row is its id and two digests.

Defined results: each null field hashes as ``-``; a null source is a source of its own, before all others; null ids come first in
their source; equal ids are ordered by leaf, and rows equal there too are interchangeable; a null id is never tampered with;
a null text has nothing to tamper with; an empty table gives an empty result; only the five named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklab.llm.common import register, table, written
from ranklab.operators.ordered import range_pieces, with_running_sum

ARITY = 3
STEP = 3
STEPS_TYPE = "array<struct<left:string,right:string>>"


def digest(text) -> Column:
    return F.sha2(text, 256)


def field(c) -> Column:
    """A null as ``-``, else the number of UTF-8 bytes, a colon and the value."""
    s = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(text, id_col: str, source_col: str, lang_col: str, size_col: str) -> Column:
    return digest(F.concat(field(id_col), field(source_col), field(lang_col), field(size_col), field(text)))


def level_up(nodes, arity: int = ARITY) -> Column:
    """The parents of an array of neighbouring nodes that starts at a parent's first child."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / arity).cast("int") - 1),
                       lambda k: digest(F.array_join(F.slice(nodes, k * arity + 1, F.lit(arity)), "")))


def sibling_step(nodes, at, arity: int = ARITY) -> Column:
    """(left, right): the siblings of node ``at`` of the array, before and after it, each joined."""
    first = F.floor(at / arity).cast("int") * arity
    before = F.slice(nodes, first + 1, at - first)
    after = F.slice(nodes, at + 2, F.lit(arity) - 1 - (at - first))
    return F.struct(F.array_join(before, "").alias("left"), F.array_join(after, "").alias("right"))


def aligned_subtrees(nodes: DataFrame, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """(tree, at, left_levels, nodes): rows (tree, i, size, payload...) gathered into subtrees.

    ``nodes`` holds tree, i (place in the level), levels (how many are above this one), node (a struct that begins with its digest).
    """
    width = arity ** step
    g = nodes.groupBy("tree", F.floor(F.col("i") / width).alias("at"), "levels").agg(
        F.sort_array(F.collect_list(F.struct("i", "node"))).alias("n"))
    return g.select("tree", "at", "levels", F.transform("n", lambda x: x["node"]).alias("nodes"))


def _regenerate(df: DataFrame, digests, arity: int, step: int) -> DataFrame:
    """+ _l0 .. _l<step>: the levels of each row's subtree; a level above the top repeats the top."""
    df = df.withColumn("_l0", digests)
    for k in range(step):
        df = df.withColumn(f"_l{k + 1}", F.when(F.col("levels") > k, level_up(F.col(f"_l{k}"), arity)).otherwise(F.col(f"_l{k}")))
    return df


def stored_levels(nodes: DataFrame, arity: int = ARITY, step: int = STEP) -> tuple[list[DataFrame], DataFrame]:
    """(stored levels of all trees, bottom first; (tree, subroot)).

    ``nodes``: tree, i, levels (how many are above its tree's bottom), node (a struct with ``digest``). A tree that
    reaches its top inside a subtree is whole there and leaves the loop.
    """
    stored, tops = [], []
    while True:
        # one level of aligned subtrees is written; what lies between it and the next is not
        level = written(aligned_subtrees(nodes, arity, step), "merkle")
        stored.append(level)
        up = _regenerate(level, F.col("nodes.digest"), arity, step).select(
            "tree", F.col("at").alias("i"), "levels", F.element_at(f"_l{step}", 1).alias("digest"))
        tops.append(up.filter(F.col("levels") <= step).select("tree", F.col("digest").alias("subroot")))
        most = level.agg(F.max("levels")).first()[0]
        if most is None or most <= step:
            return stored, written(functools.reduce(DataFrame.unionByName, tops), "merkle-roots")
        nodes = up.filter(F.col("levels") > step).select("tree", "i", (F.col("levels") - step).alias("levels"), F.struct("digest").alias("node"))


def proofs(stored: list[DataFrame], above: DataFrame, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """(tree, i, node, steps, subroot) of the bottom nodes; ``above``: (tree, steps, subroot).

    ``steps`` are the (left, right) siblings from the bottom to the tree's top, then those that ``above`` has for the tree.
    """
    down = None
    for level in reversed(stored):
        part = level.filter(F.col("levels") <= step).join(above.withColumnRenamed("steps", "_rest"), "tree")
        if down is not None:
            rest = down.select("tree", F.col("i").alias("at"), F.col("steps").alias("_rest"), "subroot")
            part = part.unionByName(level.filter(F.col("levels") > step).join(rest, ["tree", "at"]))
        t = _regenerate(part, F.col("nodes.digest"), arity, step)
        own = F.transform("nodes", lambda node, k: F.struct(k.alias("k"), node.alias("node"), F.filter(
            F.array(*[F.when(F.col("levels") > s, sibling_step(F.col(f"_l{s}"), F.floor(k / arity ** s).cast("int"), arity)) for s in range(step)]),
            lambda x: x.isNotNull()).alias("steps")))
        down = t.select("tree", "at", "_rest", "subroot", F.explode(own).alias("x")).select(
            "tree", (F.col("at") * arity ** step + F.col("x.k")).alias("i"), F.col("x.node").alias("node"),
            F.concat(F.col("x.steps"), F.col("_rest")).alias("steps"), "subroot")
    return down


def folded(leaf, steps) -> Column:
    """The root recomputed from a leaf and its siblings."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def proof_hash(steps) -> Column:
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def levels_above(n, arity: int = ARITY) -> Column:
    """Number of levels above the bottom of a tree of ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(arity ** k) for k in range(62) if arity ** k < 1 << 62]), lambda p: p < n))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars",
             text_col: str = "text", tampered: Column | None = None, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, proof_sha256, folded_root, verified) per row.

    ``tampered`` is the text that the copy under test holds (by default the same text); ``folded_root`` is recomputed from that copy's leaf
    and the manifest's siblings, ``verified`` tells whether it equals the root.
    """
    same = F.col(text_col)
    narrow = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        leaf_hash(same, id_col, source_col, lang_col, size_col).alias("leaf"),
        leaf_hash(tampered if tampered is not None else same, id_col, source_col, lang_col, size_col).alias("other"))
        .withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))), "merkle-leaves")
    sizes = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("_g", F.lit(0)).withColumn("_1", F.lit(1)) \
        .withColumn("_null", F.col("source").isNotNull())
    order = ["_null", "source"]
    places = with_running_sum(range_pieces(sizes, ["_g"], order), ["_g"], order, "_1", "pos")
    trees = written(places.select("source", (F.col("pos") - 1).alias("tree"), levels_above(F.col("n"), arity).alias("levels")), "merkle-trees")
    rows = narrow.join(trees.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source") \
        .withColumns({"_1": F.lit(1), "_null": F.col("doc_id").isNotNull()})
    order = ["_null", "doc_id", "leaf"]
    rows = with_running_sum(range_pieces(rows, ["tree"], order), ["tree"], order, "_1", "place")
    stored, subroots = stored_levels(rows.select("tree", (F.col("place") - 1).alias("i"), "levels", F.struct(
        F.col("leaf").alias("digest"), "doc_id", "other").alias("node")), arity, step)
    # the second tree: subroots in order of source
    n = trees.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), levels_above(F.lit(n), arity).alias("levels"),
                           F.struct(F.col("subroot").alias("digest")).alias("node"))
    stored_tops, root = stored_levels(tops, arity, step)
    root = root.first()
    root = F.lit(root["subroot"] if root else None).cast("string")
    start = root_frame(docs.sparkSession)
    above = proofs(stored_tops, start, arity, step).select(F.col("i").alias("tree"), "steps", F.col("node.digest").alias("subroot"))
    out = proofs(stored, written(above, "merkle-tops"), arity, step)
    out = out.select(F.col("node.doc_id").alias("doc_id"), F.col("node.digest").alias("leaf"), "subroot", root.alias("root"), "steps",
                     proof_hash(F.col("steps")).alias("proof_sha256"),
                     folded(F.coalesce("node.other", "node.digest"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def root_frame(spark) -> DataFrame:
    """What stands above the tree of sources: nothing."""
    return spark.range(1).select(F.col("id").alias("tree"), F.array().cast(STEPS_TYPE).alias("steps"), F.lit(None).cast("string").alias("subroot"))


def newline_tampering(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Texts without their newlines where 2 divides the crc32 of the id."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))


@register("op13_merkle_manifest", """
WITH RECURSIVE
crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS v
        FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
t AS (SELECT *, CASE WHEN list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1])) & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS other
      FROM documents, crc),
f AS (SELECT doc_id, source, other,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head, text FROM t),
d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS tampered FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
lev AS (SELECT tree, 0 AS l, i, leaf AS h, n FROM p
        UNION ALL
        SELECT tree, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM lev WHERE n > 1 GROUP BY tree, l, i // 3),
sub AS (SELECT tree, h AS subroot FROM lev WHERE n = 1),
top AS (SELECT 0 AS l, tree AS i, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
        UNION ALL
        SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY l, i // 3),
s AS (SELECT tree, l, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
        || coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS sib
      FROM lev WHERE n > 1 WINDOW w AS (PARTITION BY tree, l, i // 3 ORDER BY i)),
ts AS (SELECT l, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
        || coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS sib
      FROM top WHERE n > 1 WINDOW w AS (PARTITION BY l, i // 3 ORDER BY i)),
lows AS (SELECT p.tree, p.i, list(sib ORDER BY l) AS steps FROM p JOIN s ON p.tree = s.tree AND p.i // CAST(pow(3, l) AS BIGINT) = s.i GROUP BY p.tree, p.i),
highs AS (SELECT sub.tree, list(sib ORDER BY l) AS steps FROM sub JOIN ts ON sub.tree // CAST(pow(3, l) AS BIGINT) = ts.i GROUP BY sub.tree),
a AS (SELECT p.*, subroot, list_concat(coalesce(lows.steps, []), coalesce(highs.steps, [])) AS steps
      FROM p JOIN sub ON p.tree = sub.tree LEFT JOIN lows ON p.tree = lows.tree AND p.i = lows.i LEFT JOIN highs ON p.tree = highs.tree),
g AS (SELECT a.*, h AS root, list_reduce(list_prepend(tampered, steps), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
      FROM a, (SELECT h FROM top WHERE n = 1))
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g""")
def op13_merkle_manifest(spark, sf_dir):
    m = manifest(table(spark, sf_dir, "documents"), tampered=newline_tampering())
    return m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
