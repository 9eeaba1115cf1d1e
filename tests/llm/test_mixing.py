import random

import pytest

from ranklab.llm import mixing as mx


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target string")


def water_fill(sizes, weights, cap=3):
    left, total, out = set(sizes), sum(sizes.values()), {}
    while left:
        w = sum(weights[s] for s in left)
        over = {s for s in left if total * weights[s] / w > cap * sizes[s]}
        if not over:
            out |= {s: total * weights[s] / w for s in left}
            break
        out |= {s: cap * sizes[s] for s in over}
        total -= sum(cap * sizes[s] for s in over)
        left -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_exact_cut(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        source = r.choice([None, "a", "Z", "é", "hot", "hot", "hot", "tiny" if i < 9 else "hot"])
        text = r.choice([None, "", " ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 60)))])
        rows.append((i if i % 50 else 7, text, source, "clash", "clash"))
    got = mx.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    want = water_fill(sizes, weights)
    taken = {}
    for x in got:
        assert x["target"] == pytest.approx(want[x["source"]]) and x["source_size"] == sizes[x["source"]]
        assert 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_reruns_agree_and_empty(spark):
    rows = [(i % 90, "a b c " * (i % 7), f"s{i % 4}", None, None) for i in range(120)]
    runs = [sorted(map(tuple, mx.mix(frame(spark, rows).repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
    assert mx.mix(frame(spark, [])).count() == 0
    zero = mx.mix(frame(spark, [(1, None, None, None, None), (2, "  ", "x", None, None)])).collect()
    assert {(x["size"], x["target"], x["taken"]) for x in zero} == {(0, 0.0, 0)}


def test_mixed_texts_hold_the_taken_words(spark):
    docs = frame(spark, [(i, " ".join(f"w{i}_{k}" for k in range(5 + i)), "big" if i < 8 else "small", None, None) for i in range(10)])
    mixed = mx.mix(docs)
    words = {}
    for x in mx.mixed_texts(docs, mixed).collect():
        words[x["doc_id"]] = words.get(x["doc_id"], 0) + len(x["text"].split())
    assert words == {x["doc_id"]: x["taken"] for x in mixed.collect() if x["taken"]}


def test_mixed_texts_with_repeated_ids(spark):
    rows = [(1, "a b c", "s", None, None), (1, "d e f", "s", None, None), (1, "a b c", "s", None, None), (1, "x y", "t", None, None),
            (None, "n m", "t", None, None), (2, None, "t", None, None)]
    rows += [(10 + k, "w " * 9, "big", None, None) for k in range(5)]
    docs = frame(spark, rows)
    mixed = mx.mix(docs)
    texts = mx.mixed_texts(docs, mixed).collect()
    assert sum(len(x["text"].split()) for x in texts) == sum(x["taken"] for x in mixed.collect())
    per_id = {}
    for x in texts:
        per_id[x["doc_id"]] = per_id.get(x["doc_id"], 0) + len(x["text"].split())
    want = {}
    for x in mixed.collect():
        if x["taken"]:
            want[x["doc_id"]] = want.get(x["doc_id"], 0) + x["taken"]
    assert per_id == want
