"""``run`` against plain Python versions of its stages, on a corpus with planted cases."""

import hashlib
import random
import tempfile

import corpus_pipeline as cp
from ranklab.llm import toxicity
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_decontaminate import words as match_words
from tests.llm.test_mixing import water_fill
from tests.llm.test_simhash import brute_components, brute_fp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    passage = r.choices(vocab, k=70)
    items = [(i, " ".join(f"b{i}_{k}" for k in range(30))) for i in range(5)]
    docs = []
    for i in range(260):
        t = r.choices(vocab, k=r.randint(3, 250))
        if i % 11 == 0:
            at = r.randint(0, len(t))
            t[at:at] = passage
        if i % 17 == 0:
            t += items[i % 5][1].split()
        if i % 6 == 0:
            t.insert(r.randint(0, len(t)), r.choice(["vilename", "rotgut"]))
        docs.append([i, " ".join(t), "en", r.choice(["a", "b", "c", None]), 0])
    base = r.choices(vocab, k=9000)
    for k in range(6):
        c = list(base)
        if k:
            c[k * 50] = "changed"
        docs.append([300 + k, " ".join(c), None, "copies", None])
    docs += [[400, docs[7][1], "en", "a", 1], [401, None, None, None, None], [402, "", "en", "a", 0], [403, "w1\nw2  w3", "en", "b", 9], [None, "no id here at all", "en", "b", 1],
             list(docs[9])]
    labels = [(i, 0, int(i % 6 == 0)) for i in range(0, 260)]
    return [tuple(d[:4]) + (len(d[1]) if d[1] is not None else None,) for d in docs], labels, items


def order(i):
    return (1 << 63) if i is None else i


def test_run_equals_plain_stages(spark):
    docs, labels, items = corpus()
    sf = tempfile.mkdtemp(prefix="ranklab-pipeline-")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")

    score = {r["doc_id"]: r["score"] for r in toxicity.scored(d, toxicity.fit(d, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    left = [x for x in docs if score[x[0]] < 0.5]
    assert {x[0] for x in docs if x[0] is not None and x[0] < 260 and x[0] % 6 == 0} == {x[0] for x in docs} - {x[0] for x in left}

    comps = brute_components([(x[0], brute_fp(x[1])) for x in left])
    kept = {}
    for x, c in zip(left, comps):
        if x[0] == c:
            kept[x[0]] = x
    left = sorted(kept.values(), key=lambda x: order(x[0]))
    assert 400 not in kept and 300 in kept and len({301, 302, 303, 304, 305} & set(kept)) < 3

    first = {}
    split = [(x[1] or "").encode().split() for x in left]
    for x, w in zip(left, split):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i:i + 50]), order(x[0]))
    cut = []
    for x, w in zip(left, split):
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < order(x[0]) for j in range(i, i + 50)}
        text = b" ".join(t for i, t in enumerate(w) if i not in gone).decode() if gone else x[1]
        cut.append((x[0], text, x[2], x[3], len(text) if gone else x[4]))
    assert any(a[1] != b[1] for a, b in zip(cut, left))

    bad = {h[0] for h in brute_hits([(x[0], x[1]) for x in cut], items) if h[4]}
    clean = [x for x in cut if x[0] not in bad]
    assert bad and len(clean) > 100

    sizes = {}
    for x in clean:
        sizes[x[3]] = sizes.get(x[3], 0) + len((x[1] or "").split())
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    target = water_fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)})
    want = {}
    for s in names:
        rows = sorted(((hashlib.md5(f"{'null' if x[0] is None else x[0]}|mix-1".encode()).hexdigest(), x[0], len((x[1] or "").split())) for x in clean if x[3] == s),
                      key=lambda t: t[0])
        epochs, rest = divmod(round(target[s]), sizes[s]) if sizes[s] else (0, 0)
        for _, doc, n in rows:
            part = max(0, min(n, rest))
            want[doc] = (n, sizes[s], epochs * n + part)
            rest -= n
    got = {r["doc_id"]: (r["size"], r["source_size"], r["taken"]) for r in cp.run(spark, sf).collect()}
    assert got == want
    assert all(f(spark, d.limit(0), sf).columns == d.columns for _, f in cp.STAGES[:4])


def test_empty_documents(spark):
    sf = tempfile.mkdtemp(prefix="ranklab-pipeline-")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert cp.run(spark, sf).count() == 0


def test_extra_columns_may_have_any_name(spark):
    """Names of the stages' helper columns are no case apart: same mix, and each extra value stays with its document."""
    docs, labels, items = corpus()
    extra = ["id", "row", "gone", "text2", "doc", "kept", "score", "_row", "_ID", "_row2", "_keep_row", "_keep_id", "_bad_row", "_bad_id", "_toxicity", "toxic"]
    sf = tempfile.mkdtemp(prefix="ranklab-pipeline-")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    plain = spark.createDataFrame(docs[:60], SCHEMA)
    wide = spark.createDataFrame([(*x, *[f"{n}:{x[0]}" for n in extra]) for x in docs[:60]], SCHEMA + "".join(f", `{n}` string" for n in extra))
    for _, stage in cp.STAGES[:4]:
        rows = stage(spark, wide, sf)
        assert rows.columns == wide.columns
        rows = rows.collect()
        assert rows and all(tuple(r)[5:] == tuple(f"{n}:{r['doc_id']}" for n in extra) for r in rows)
        assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r) for r in stage(spark, plain, sf).collect())
    wide.write.parquet(f"{sf}/documents.parquet")
    assert cp.run(spark, sf).count() > 0
