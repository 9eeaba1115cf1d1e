import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ranklab.llm import merkle as mk

COLS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, `i` string, digest string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], text)))


def tree(nodes, arity):
    """(top, per bottom node its list of (left, right))."""
    steps = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(place):
            a = at - at % arity
            run = nodes[a:a + arity]
            steps[k].append(("".join(run[:at - a]), "".join(run[at - a + 1:])))
            place[k] = at // arity
        nodes = [h("".join(nodes[a:a + arity])) for a in range(0, len(nodes), arity)]
    return nodes[0], steps


def plain(rows, tampered, arity=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found = []
    for s in names:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        found.append((members, *tree([leaf(r, r[1]) for r in members], arity)))
    if not found:
        return []
    root, above = tree([top for _, top, _ in found], arity)
    out = []
    for (members, top, steps), more in zip(found, above):
        for r, own in zip(members, steps):
            path = own + more
            x = leaf(r, tampered(r))
            for a, b in path:
                x = h(a + x + b)
            out.append((r[0], leaf(r, r[1]), top, root, h("".join(a + b for a, b in path)), x, x == root))
    return out


def newline(r):
    return r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], COLS)


@pytest.mark.parametrize("seed, step", [(0, 3), (1, 1), (2, 2)])
def test_manifest_equals_plain_trees(spark, seed, step):
    r = random.Random(seed)
    rows = []
    for k in range(230):
        i = r.choice([k, k, k, k, 7, None])
        text = r.choice([None, "", "a\nb", f"line {k}\nline", "é\n" * 3, "same"])
        rows.append((i, text, r.choice([None, "en"]), r.choice([None, "", "hot", "hot", "hot", "hot", "é", "Z"]), r.choice([None, k])))
    rows += [(5000, "one\n", "en", "single", 1), (7, "same", None, "hot", 3), (7, "same", None, "hot", 3)]
    got = mk.manifest(frame(spark, rows), tampered=mk.newline_tampering(), step=step)
    assert sorted(map(tuple, got.select(NAMES).collect()), key=str) == sorted(plain(rows, newline), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 82])
def test_sizes_around_whole_subtrees(spark, n):
    rows = [(k, f"t\n{k}", "en", "s", k) for k in range(n)]
    got = mk.manifest(frame(spark, rows), tampered=mk.newline_tampering())
    assert sorted(map(tuple, got.select(NAMES).collect())) == sorted(plain(rows, newline))


def test_other_arity_and_an_untouched_copy(spark):
    rows = [(k, f"t\n{k}", "en", f"s{k % 5}", k) for k in range(60)]
    got = mk.manifest(frame(spark, rows), arity=2, step=2)
    assert got.filter("not verified").count() == 0
    assert sorted(map(tuple, got.select(NAMES).collect())) == sorted(plain(rows, lambda r: r[1], 2))


def test_empty_table(spark):
    got = mk.manifest(frame(spark, []), tampered=mk.newline_tampering())
    assert got.collect() == [] and got.select("verified").dtypes == [("verified", "boolean")]


def test_only_every_third_level_is_stored(spark):
    rows = spark.range(800).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("i"), mk.levels_above(F.lit(800)).alias("levels"),
                                   F.struct(F.sha2(F.col("id").cast("string"), 256).alias("digest")).alias("node"))
    stored, root = mk.stored_levels(rows)
    assert [(x.count(), x.agg(F.sum(F.size("nodes"))).first()[0]) for x in stored] == [(30, 800), (2, 30), (1, 2)]
    assert root.first()["subroot"] == tree([h(str(k)) for k in range(800)], 3)[0]
