import math

import numpy as np

from ranklab.llm import importance as im


def frames(spark):
    r = np.random.default_rng(2)
    good, junk = [f"good{i}" for i in range(60)], [f"#{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(good if i % 2 else junk, r.integers(3, 60))), "x") for i in range(400)]
    docs += [(400, None, None), (401, "", None), (None, "good1 good2", None), docs[3]]
    labels = [(i, i % 2) for i in range(0, 400, 3)] + [(None, 1), (5, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, rank string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_target_like_rows_are_drawn(spark):
    d, y = frames(spark)
    got = im.resample(d, y, share=0.25).collect()
    assert len(got) == 404 and sum(r["selected"] for r in got) == 101
    chosen = [r["doc_id"] % 2 for r in got if r["selected"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean(chosen) > 0.95
    by_rank = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1, 405))
    assert all(a["gumbel_key"] >= b["gumbel_key"] for a, b in zip(by_rank, by_rank[1:]))
    empty = [r for r in got if r["n_grams"] == 0]
    assert len(empty) == 2 and all(r["log_weight"] == 0 for r in empty)


def test_counts_and_weights_match_the_definition(spark):
    d, _ = frames(spark)
    n = sum(max(0, 2 * len((r["text"] or "").split()) - 1) for r in d.collect())
    assert im.counts_of(im.gram_counts(d)).sum() == n
    raw, target = np.array([5, 3, 2, 0]), np.array([1, 0, 1, 0])
    model = np.exp(im.log_ratio(target, raw)) * raw / raw.sum()      # the target model
    assert math.isclose(model.sum(), 1, rel_tol=1e-6) and np.allclose(model, 0.5 * raw / 10 + 0.5 * target / 2)
    assert (im.log_ratio(np.zeros(4), raw) == 0).all()


def test_without_target_the_sample_is_uniform(spark):
    d, y = frames(spark)
    got = im.resample(d, y.limit(0)).collect()
    assert {r["log_weight"] for r in got} == {0.0}
    half = np.mean([r["doc_id"] % 2 for r in got if r["selected"] and r["doc_id"] is not None])
    assert 0.35 < half < 0.65
    assert im.resample(d.limit(0), y).count() == 0


def test_query_equals_plain_models(spark):
    """Weights and ranks against dictionaries of hashed n-grams."""
    from ranklab.llm.toxicity import held_out
    from ranklab.llm.words import code_of

    def mix(x):
        m = (1 << 64) - 1
        x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & m
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & m
        return x ^ (x >> 32)

    def grams(text):
        c = [code_of(w.lower()) for w in (text or "").encode().split()]
        return [x % im.BUCKETS for x in c] + [mix((a * 0x9E3779B97F4A7C15 + b) & ((1 << 64) - 1)) % im.BUCKETS for a, b in zip(c, c[1:])]
    d, y = frames(spark)
    held = {r["doc_id"] for r in d.filter(held_out(d["doc_id"])).collect()}
    good = {r["doc_id"] for r in y.collect() if r["quality"] == 1} - held - {r["doc_id"] for r in y.collect() if r["quality"] != 1} - {None}
    docs = d.collect()
    raw, target = {}, {}
    for r in docs:
        for b in grams(r["text"]):
            raw[b] = raw.get(b, 0) + 1
            if r["doc_id"] in good:
                target[b] = target.get(b, 0) + 1

    def ratio(b):
        return math.log(0.5 * (target.get(b, 0) / sum(target.values())) / (raw[b] / sum(raw.values())) + 0.5)
    got = im.resample(d, y).collect()
    want = sorted((r["doc_id"] or -1, len(grams(r["text"])), round(sum(ratio(b) for b in grams(r["text"])), 3))
                  for r in docs)
    assert sorted((r["doc_id"] or -1, r["n_grams"], round(r["log_weight"], 3)) for r in got) == want
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    assert all(r["gumbel_key"] == keys[r["rank"] - 1] for r in got) and {r["selected"] for r in got if r["rank"] <= 202} == {True}


def test_buckets_follow_the_corpus(spark):
    d = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50), x -> concat('w', id * 50 + x))) AS text").repartition(7)
    n = 4000 * 99
    assert abs(im.distinct_grams(d) - n) < 0.1 * n and im.bucket_count(d) == 1 << 19
    assert im.bucket_count(d.limit(3)) == im.BUCKETS and im.bucket_count(d.limit(0)) == im.BUCKETS
    assert im.counts_of(im.gram_counts(d, 1 << 19), 1 << 19).sum() == n


def test_mean_a_gram_is_an_option(spark):
    d, y = frames(spark)
    total = {r["doc_id"]: (r["log_weight"], r["n_grams"]) for r in im.resample(d, y).collect()}
    mean = {r["doc_id"]: r["log_weight"] for r in im.resample(d, y, per_gram=True, sharpness=2.0).collect()}
    assert all(math.isclose(mean[i], 2 * w / max(1, n), abs_tol=1e-9) for i, (w, n) in total.items())
