"""Operator 4: quality selection by importance resampling.

Texts are bags of hashed word unigrams and bigrams. The number of buckets follows the corpus: a power of two from its approximate
number of distinct n-grams, ``BUCKETS`` at least and ``MOST_BUCKETS`` at most, so that the table of log ratios stays
small enough to travel to every task. Two generative models are estimated: the raw one from every document (each task's dense counts,
packed by shard and added up by Spark), the target one from the labelled good rows of the learning folds (``SAMPLE`` at most, the
first by a hash of the id). A document's log weight is the log of the ratio of the two models' likelihoods, the sum over its n-grams; with
``per_gram`` it is the mean a gram times ``sharpness`` instead, which does not favour long texts. Adding Gumbel noise, hashed
from the id, and keeping the ``k`` greatest keys samples without replacement in proportion to the weights. The rank comes
from a range sort and per-piece counts over the written weights; no task sees all rows.

Defined results: null and empty texts have no n-grams and log weight 0; without labelled good rows all weights are 0 (a uniform
sample); repeated rows get equal noise, so ties in rank are broken arbitrarily between equal rows; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.llm.align import pack, unpack
from ranklab.llm.common import bounded_batches, in_tasks, register, table, written
from ranklab.llm.toxicity import held_out
from ranklab.llm.words import Slice, mix64, slices
from ranklab.operators.ordered import range_pieces, with_running_sums

BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 22
REGISTERS = 12                # bits: 4096 registers, an error of about 2 %
SHARD = 1 << 15               # buckets a shard of counts
SAMPLE = 20_000
SHARE = 0.5
SHARPNESS = 16.0
BLEND = 0.5                   # of the raw model in the target model


def gram_codes(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit code) of every unigram and bigram of the slice."""
    c, row = s.codes(), s.row_of_word()
    two = np.flatnonzero(row[1:] == row[:-1])
    pair = mix64(c[two] * np.uint64(0x9E3779B97F4A7C15) + c[two + 1])
    return np.concatenate((row, row[two])), np.concatenate((c, pair))


def slice_grams(s: Slice, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every unigram and bigram of the slice."""
    rows, codes = gram_codes(s)
    return rows, (codes % np.uint64(buckets)).astype(np.int64)


def _registers(batches):
    """HyperLogLog registers of a task's n-grams."""
    top = np.zeros(1 << REGISTERS, np.int32)
    rest = 64 - REGISTERS
    for batch in batches:
        for s in slices(batch.column("text"), lower=True):
            codes = mix64(gram_codes(s)[1])
            low = (codes & np.uint64((1 << rest) - 1)).astype(np.float64)
            np.maximum.at(top, (codes >> np.uint64(rest)).astype(np.int64), rest + 1 - np.frexp(low)[1])
    at = np.flatnonzero(top)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(top[at])], ["register", "top"])


def distinct_grams(texts: DataFrame) -> float:
    """Approximate number of distinct n-grams (HyperLogLog; 4096 small rows reach the driver)."""
    bounded_batches(texts.sparkSession)
    m = 1 << REGISTERS
    top = np.zeros(m)
    for r in texts.select("text").mapInArrow(_registers, "register int, top int").groupBy("register").agg(F.max("top").alias("top")).collect():
        top[r["register"]] = r["top"]
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-top).sum()
    empty = (top == 0).sum()
    return float(m * np.log(m / empty) if raw < 2.5 * m and empty else raw)


def bucket_count(texts: DataFrame) -> int:
    """A power of two not below the number of distinct n-grams, within the two bounds."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << max(0, int(np.ceil(np.log2(max(1.0, distinct_grams(texts))))))))


def gram_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(shard, counts) over all texts: dense counts in each task, cut into packed shards, added up by shard."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for s in slices(batch.column("text"), lower=True):
                total += np.bincount(slice_grams(s, buckets)[1], minlength=buckets)
        parts = [(i // SHARD, pack(total[i:i + SHARD])) for i in range(0, buckets, SHARD) if total[i:i + SHARD].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["shard", "counts"])

    def added(group):
        total = sum(unpack(x.as_py())[0] for x in group.column("counts"))
        return pa.table({"shard": group.column("shard")[:1].combine_chunks(), "counts": pa.array([pack(total)], pa.binary())})
    bounded_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "shard int, counts binary").groupBy("shard").applyInArrow(added, "shard int, counts binary")


def counts_of(shards: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The counts of all buckets: at most ``MOST_BUCKETS`` numbers, packed."""
    n = np.zeros(buckets, np.int64)
    for r in shards.collect():
        part, = unpack(r["counts"])
        n[r["shard"] * SHARD:r["shard"] * SHARD + len(part)] = part
    return n


def log_ratio(target: np.ndarray, raw: np.ndarray, blend: float = BLEND) -> np.ndarray:
    """Log of the target model's probability over the raw model's, by bucket.

    The raw model is the corpus itself, which holds every n-gram that is weighed. The target model is the good rows' share of a bucket, blended
    with the raw model, so that n-grams which the sample of good rows lacks cost a bounded amount. Without good rows the models are equal.
    """
    if not target.any():
        return np.zeros(len(raw), np.float32)
    p, q = target / target.sum(), raw / max(1, raw.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(raw > 0, np.log((1 - blend) * p / q + blend), 0).astype(np.float32)


def _weights(batch, ratio):
    weight, size = [], []
    for s in slices(batch.column("text"), lower=True):
        row, bucket = slice_grams(s, len(ratio))
        weight.append(np.bincount(row, ratio[bucket], minlength=s.hi - s.lo))
        size.append(np.bincount(row, minlength=s.hi - s.lo))
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(size)), pa.array(np.concatenate(weight))],
                                     ["doc_id", "n_grams", "total"])


def target_texts(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    good = labels.groupBy(id_col).agg(F.min(label_col).alias("_y")).filter((F.col("_y") == 1) & ~held_out(F.col(id_col))) \
        .orderBy(F.xxhash64(F.col(id_col), F.lit("target")), id_col).limit(sample).select(id_col)
    return docs.join(F.broadcast(good), id_col, "left_semi")  # at most ``sample`` ids


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             share: float = SHARE, sample: int = SAMPLE, buckets: int | None = None, per_gram: bool = False, sharpness: float = SHARPNESS,
             seed: str = "gumbel-1") -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, rank, selected) for every row; ``share`` of the rows is selected."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = buckets or bucket_count(d)
    good = target_texts(d, labels.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else labels, "doc_id", label_col, sample)
    ratio = log_ratio(counts_of(gram_counts(good, buckets), buckets), counts_of(gram_counts(d, buckets), buckets))
    kind = d.schema["doc_id"].dataType.simpleString()
    w = d.transform(in_tasks(_weights, f"doc_id {kind}, n_grams long, total double", ratio))
    weight = F.col("total") / F.greatest(F.col("n_grams"), F.lit(1)) * sharpness if per_gram else F.col("total")
    # a uniform number in (0, 1) from 53 bits of the id's hash
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    w = w.select("doc_id", "n_grams", weight.alias("log_weight")) \
        .withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    w = written(w, "weights")                   # the range sort samples its input: texts are weighed once
    w = w.select("*", (-F.col("gumbel_key")).alias("_neg"), F.lit(0).alias("_g"), F.lit(1).alias("_1"))
    order = ["_neg", "doc_id", "n_grams"]
    pieces = range_pieces(w, ["_g"], order)
    k = round(share * pieces.count())
    ranked = with_running_sums(pieces, ["_g"], order, {"rank": "_1"})
    return ranked.select("doc_id", "n_grams", "log_weight", "gumbel_key", F.col("rank").cast("long").alias("rank"),
                         (F.col("rank") <= k).alias("selected"))


@register("op4_importance_resampling")
def op4_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
