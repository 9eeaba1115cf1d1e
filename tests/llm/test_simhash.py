import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ranklab.llm import simhash as sh
from ranklab.llm.words import slices


def brute_fp(text, width=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=2):
    ids = [i for i, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(ids[i])
    low = {r: min([x for x in g if x is not None], default=None) for r, g in groups.items()}
    return [low[find(i)] for i in range(len(rows))]


def texts(seed, n):
    r = random.Random(seed)
    vocab = ["a", "Bé", "ccc", "ÀÉ", "x" * 9, "longer", "y" * 40, "z" * 90, "Q q", "end."]
    out = [" ".join(r.choices(vocab, k=r.choice([0, 1, 2, 3, 4, 30, 300, 700]))) for _ in range(n)]
    return out + ["", None, "   ", "one", "one two", "one two three", "ONE  two\tthree", "w" * 5000]


def test_xxh64_of_spans():
    data = bytes(random.Random(1).randbytes(5000))
    buf = np.frombuffer(data, np.uint8)
    lo = np.arange(0, 900)
    hi = lo + np.arange(900) % 211
    lo, hi = np.append(lo, 0), np.append(hi, 4999)
    got = sh.xxh64(buf, lo, hi)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(lo, hi)]


@pytest.mark.parametrize("limit", [1, 300, 1 << 20])
def test_fingerprints_match_the_definition(limit):
    t = texts(2, 60)
    got = np.concatenate([sh.slice_fingerprints(s, 3) for s in slices(pa.array(t), lower=True, limit=limit)])
    assert [int(x) for x in got] == [brute_fp(x) for x in t]


@pytest.mark.parametrize("parts", [4, 6, 10])
def test_near_edges_equal_brute_force(spark, parts):
    r = random.Random(parts)
    base = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base[:25]:
        x = b
        for _ in range(6):
            x ^= 1 << r.randrange(64)
            x ^= 1 << r.randrange(64) if r.random() < .6 else 0
            fps.add(x)
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    rows = sorted((x, x & ((1 << 64) - 1)) for x in fps)
    want = dict(zip([x for x, _ in rows], brute_components(rows)))
    got = {x: x for x in fps}
    got.update({x["node"]: x["component"] for x in sh.components(sh.near_edges(df, 2, parts, tile=7)).collect()})
    assert got == want


def test_near_duplicates_query(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [r.choices(words, k=400) for _ in range(12)]
    docs = []
    for b in base:
        docs.append(" ".join(b))
        for _ in range(4):
            c = list(b)
            c[r.randrange(400)] = "changed"
            docs.append(" ".join(c))
    docs += texts(3, 10) + [docs[0].upper(), docs[0], docs[7]]
    rows = [(i * 3 % 101 if i != 4 else None, t, "x") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((x["doc_id"], x["f"], x["component_id"]) for x in
                  sh.near_duplicates(df).withColumn("f", sh.as_hex("fp")).collect()), key=str)
    fps = [(i, brute_fp(t)) for i, t, _ in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps))), key=str)
    assert got == want


def test_empty_and_zero_fingerprints(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sh.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(5, None), (3, ""), (9, " \t"), (None, None), (2, "word word")], "doc_id long, text string")
    got = {r["doc_id"]: (r["f"], r["component_id"]) for r in sh.near_duplicates(df).withColumn("f", sh.as_hex("fp")).collect()}
    assert got[5] == got[3] == got[9] == got[None] == ("0" * 16, 3) and got[2][1] == 2


def test_null_id_alone_has_no_component(spark):
    df = spark.createDataFrame([(None, "alone here now"), (1, "some thing else entirely")], "doc_id long, text string")
    assert sorted(r["component_id"] or -1 for r in sh.near_duplicates(df).select(F.col("component_id")).collect()) == [-1, 1]
