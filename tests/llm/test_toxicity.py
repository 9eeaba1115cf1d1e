import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ranklab.llm import toxicity as tx
from ranklab.llm.words import code_of, slices


def corpus(n=900, seed=4):
    r = np.random.default_rng(seed)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = list(r.choice(vocab, r.integers(5, 120)))
        if bad:
            for _ in range(r.integers(1, 4)):
                words.insert(r.integers(0, len(words)), r.choice(["you", ""]) + " " + r.choice(["vilename", "rotgut", "VILENAME!", "r0tgut"]))
        docs.append((i, " ".join(words), "x", "src"))
        if i % 4 != 3:
            labels.append((i, int(bad)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (None, "vilename rotgut", None, None), (0, docs[0][1], "x", "src"), (n + 2, "z" * 200_000, None, None)]
    labels += [(n, None), (None, 1), (0, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, score string, toxic string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    d, y = frames(spark, docs, labels)
    model = tx.fit(d, y)
    got = tx.scored(d, model).withColumn("held", tx.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: i % 5 == 0 for i in range(900)}
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert len(held) > 100 and np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.98
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[900] == by[901] and by[None] >= 0.5
    again = tx.scored(d.repartition(7), tx.fit(d.repartition(5), y)).collect()
    assert sorted((r["doc_id"] or -1, r["score"]) for r in again) == sorted((r["doc_id"] or -1, r["score"]) for r in got)
    full = tx.with_scores(d, model, score_col="s")
    assert full.columns == [*d.columns, "s"] and full.count() == len(docs)


def test_held_out_rows_are_not_learned(spark):
    docs, labels = corpus()
    import zlib
    flipped = [(i, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d, y1 = frames(spark, docs, labels)
    _, y2 = frames(spark, docs, flipped)
    a, b = tx.fit(d, y1), tx.fit(d, y2)
    assert (a.lexicon.codes == b.lexicon.codes).all() and (a.trees.value == b.trees.value).all() and (a.probabilities == b.probabilities).all()


def test_without_labels(spark):
    docs, _ = corpus(50)
    d, y = frames(spark, docs, [])
    assert {r["score"] for r in tx.scored(d, tx.fit(d, y)).collect()} == {0.0}
    assert tx.scored(d.limit(0), tx.fit(d, y)).count() == 0


def test_isotonic_rises_and_pools():
    m, y = np.array([0., 1, 2, 2, 3, 4]), np.array([0., 1, 0, 0, 1, 1])
    k, p = tx.isotonic(m, y)
    assert (np.diff(p) >= 0).all() and (np.diff(k) >= 0).all()
    assert np.interp(1.5, k, p) == np.interp(2, k, p) == 1 / 3


def test_features_see_obfuscation_and_second_person():
    lexicon = tx.Lexicon(np.sort(np.array([code_of(b"idiot")], np.uint64)), np.array([5.0]))
    person = np.array([code_of(b"you")], np.uint64)
    col = pa.array(["you 1d10t", "an idiot", "clean text", "", None, "IDIOT you pad pad"])
    x = np.concatenate([tx.slice_features(s, lexicon, person) for s in slices(col, limit=9)])
    f = dict(zip(tx.FEATURES, x.T))
    assert f["hits"].tolist() == [1, 1, 0, 0, 0, 1] and f["second_person"][0] == 0.5
    assert f["min_distance"].tolist()[:2] == [1, 100] and f["obfuscated"][0] > 0 and f["caps_words"][5] > 0
