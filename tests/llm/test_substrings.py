import hashlib
import random

import pytest

from ranklab.llm import substrings as ss


def brute(rows, width):
    order = [(1 << 63) if i is None else i for i, _ in rows]
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for o, w in zip(order, words):
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            first[k] = min(first.get(k, o), o)
    out = []
    for (doc, _), o, w in zip(rows, order, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < o:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "Wörter,", "x" * 60]
    passage = [r.choices(vocab, k=n) for n in (8, 12, 30, 90)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += r.choice([r.choices(vocab, k=r.randint(0, 40)), r.choice(passage), ["same"] * r.randint(1, 30)])
        rows.append([r.randint(0, 60) if i % 9 else None, r.choice([" ", "  ", "\n"]).join(parts)])
    rows += [rows[3], rows[3], [5, None], [6, ""], [7, " \t"], [8, "w1 " * 400], [9, "w1 " * 400]]
    return [tuple(x) for x in rows]


@pytest.mark.parametrize("seed,hot,cells,shard", [(1, 2000, 1 << 12, 1 << 20), (2, 3, 1 << 12, 1 << 20), (3, 5, 16, 40), (4, 0, 1, 1 << 20)])
def test_equals_brute_force(spark, seed, hot, cells, shard):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, row string").repartition(3)
    got = ss.deduplicated(df, window=10, inner=4, hot_key=hot, cells=cells, shard_keys=shard).collect()
    got = sorted(((None if r["id"] == ss.NO_ID else r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str)
    assert got == brute(rows, 10)


def test_without_repeats_keeps_columns_and_clean_texts(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a, "en", "s", len(a)), (2, "x\ny  z", None, None, 6), (3, "new words\n" + a, "en", "s", 9), (None, None, "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = ss.without_repeats(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["lang"]) for r in out.collect()}
    assert got == {1: (a, len(a), "en"), 2: ("x\ny  z", 6, None), 3: ("new words", 9, "en"), None: (None, None, "en")}


def test_empty(spark):
    assert ss.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [2000, 3])
def test_texts_that_repeat_themselves(spark, hot):
    rows = [(i, "same " * (400 + 7 * i)) for i in range(40)] + [(50, "a b " * 300), (51, "x " + "a b " * 300), (52, "b a " * 100 + "same " * 60)]
    got = ss.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), hot_key=hot)
    got = sorted(((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str)
    assert got == brute(rows, 50)


def test_stretches_are_bounded():
    import pyarrow as pa

    from ranklab.llm.words import slices

    s, = slices(pa.array(["same " * 100_000]), limit=1 << 20)
    at, n, key, hashes = ss.stretches(s, 50, 16)
    assert n.max() == 35 and n.sum() == 100_000 - 49 and len(set(key.tolist())) == 1


def test_memory_of_equal_words_is_bounded():
    """A usual key's windows: at most the threshold times a stretch, however long the texts are."""
    assert ss.HOT_KEY * (ss.WINDOW - ss.INNER + 1) * 8 < 1 << 20
