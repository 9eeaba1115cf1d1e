import random
import re

import pytest

from ranklab.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found is not None:
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((doc, len(w), len(hit), tuple(sorted(str(i) for i in ids if i is not None)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "É", "é", "Zw", "x9", "naïve"] + [f"t{i}" for i in range(40)]
    items = [(i % 11 if i else None, r.choice([" ", ", ", "\n"]).join(r.choices(vocab, k=r.choice([1, 2, 12, 13, 14, 30, 60])))) for i in range(14)]
    items += [(20, None), (21, ""), (22, " ... "), (23, "the of and the of and the of and the of and the of"), (24, "unseen words here only"), items[3]]
    docs = []
    for i in range(70):
        parts = []
        for _ in range(r.randint(0, 5)):
            t = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(t) - 1))
            parts += r.choice([r.choices(vocab, k=r.randint(0, 50)), t, t[a:a + 20], ["the", "of", "and"] * r.randint(1, 8)])
        docs.append((r.randint(0, 50) if i % 8 else None, r.choice([" ", ". ", "-"]).join(p.upper() if r.random() < .2 else p for p in parts)))
    docs += [(90, None), (91, ""), (92, "!!"), docs[5], docs[5], (93, "." + " ".join(words(items[5][1])) + ".")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item string").repartition(3)
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, row string")
    got = sorted(((r["id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["bad"]) for r in
                  dc.contamination(d, b).withColumn("bad", dc.contaminated(dc.F.col("n_hit"), dc.F.col("n_words"))).collect()), key=str)
    assert got == brute(docs, items)
    clean = sorted((r["doc_id"], r["text"]) for r in dc.without_contaminated(d, b).collect() if r["doc_id"] is not None)
    bad = {(x[0], x[1], x[2]) for x in brute(docs, items) if x[4]}
    assert clean == sorted((i, t) for i, t in docs if i is not None and (i, len(words(t)), brute([(i, t)], items)[0][2]) not in bad)


def test_no_python_in_the_plan(spark):
    docs, items = corpus(1)
    out = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_empty_tables(spark):
    docs, items = corpus(2)
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    got = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), no_items).collect()
    assert len(got) == len(docs) and {r["n_hit"] for r in got} == {0}


def test_proximity(spark):
    far = " ".join(["pad"] * 80)
    docs = [(1, "alpha x beta y gamma"), (2, f"alpha {far} beta gamma"), (3, "gamma pad beta pad pad alpha"), (4, "alpha beta")]
    items = [(7, "gamma beta alpha"), (8, "zeta alpha")]
    got = dc.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span=10)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect() if r["item_id"] == "7"} == {(1, "7"), (3, "7")}


def near_brute(docs, items, span):
    freq = {}
    for _, t in docs:
        for w in words(t):
            freq[w] = freq.get(w, 0) + 1
    out = set()
    for item, t in items:
        terms = set(words(t))
        if not terms or not terms <= freq.keys():
            continue
        rarest = min(terms, key=lambda w: (freq[w], w))
        for doc, text in docs:
            w = words(text)
            out |= {(doc, str(item)) for p, x in enumerate(w) if x == rarest and terms <= set(w[max(0, p - span):p + span + 1])}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_proximity_needs_all_terms(spark, seed):
    docs, items = corpus(seed)
    docs, items = [x for x in docs if x[0] is not None], [x for x in items if x[0] is not None]
    items += [(50, "the unseenword of"), (51, "x9"), (52, "t1 t2 t3 t4 t5 t6")]
    got = dc.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span=12)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == near_brute(docs, items, 12)


def test_a_long_document_of_one_repeated_item(spark):
    item = " ".join(f"w{k}" for k in range(13))
    docs = [(1, " ".join([item] * 20_000)), (2, "a " * 200_000), (3, "clean text"), (4, "b a a b")]
    items = [(1, item), (2, "a " * 300), (3, "a a")]
    got = {r["id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in dc.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (260_000, 260_000, ["1"]), 2: (200_000, 200_000, ["2", "3"]), 3: (2, 0, []), 4: (4, 2, ["3"])}
