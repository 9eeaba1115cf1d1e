"""Operator 5: toxicity by gradient-boosted trees over dense features.

A bounded sample of labelled rows of the learning folds (``SAMPLE`` of each class at most, the
first by a hash of the id, equal texts once) is dealt by another hash into three parts:

* the *lexicon* part: document frequencies of words and word stems (byte prefixes) by class, counted in Spark;
  the terms with the highest log odds become the lexicon (``LEXICON`` terms at most);
* the *tree* part: boosted regression trees on dense features of each text;
* the *calibration* part: isotonic regression from the trees' margin to a probability.

Features: lexicon hits (count, density, distinct, weights), second-person words and their distance to lexicon
hits, capitals, punctuation, obfuscated and stretched words, and length. Leet spellings
(digits and signs for letters) are undone before lexicon look-up. Every whole text of the table is then scored in one
map-only pass. Id, source, language and label are never features.

Defined results: null and empty texts score what a text without words scores; a null id counts as
held out; several labels of one id count as toxic if one is; without labelled rows of both classes every
score is the share of toxic ones (0 without any); repeated rows score alike; an empty table gives an empty result; only the
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.llm.common import in_tasks, register, table
from ranklab.llm.words import Slice, code_of, slices

SAMPLE = 6000            # labelled rows of each class that the fit reads at most
LEXICON = 3000           # terms kept at most
MIN_DOCS = 3             # toxic documents that hold a term
MIN_ODDS = 2.5           # log odds of a lexicon term
PREFIXES = (4, 5, 6)     # stem lengths in bytes
TREES, DEPTH, RATE, BINS, LEAF_L2 = 60, 3, 0.2, 32, 1.0

# Second-person words (English, French, German, Spanish).
SECOND_PERSON = ("you your yours yourself yourselves ya u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen "
                 "deiner ihr euch euer sie ihnen ti tus usted ustedes vosotros vuestro vuestra os")
# Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = ("log_words", "hits", "density", "weight", "top", "distinct", "second_person", "nearness", "min_distance",
            "capitals", "caps_words", "exclaims", "punctuation", "obfuscated", "stretched")


def _tables():
    letter = np.zeros(256, bool)
    letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    sign = np.zeros(256, bool)
    sign[[ord(c) for c in LEET]] = True
    plain = np.full(256, 0x20, np.uint8)       # letters lower-cased, the rest separates words
    loose = np.full(256, 0x20, np.uint8)       # the same with signs as letters
    for b in range(256):
        if letter[b]:
            plain[b] = loose[b] = b + 32 if 0x41 <= b <= 0x5A else b
        elif sign[b]:
            loose[b] = ord(LEET[chr(b)])
    punct = np.zeros(256, bool)
    punct[[b for b in range(0x21, 0x7F) if not letter[b] and not 0x30 <= b <= 0x39]] = True
    return letter, sign, plain, loose, punct


LETTER, SIGN, PLAIN, LOOSE, PUNCT = _tables()


@dataclasses.dataclass
class Lexicon:
    """Sorted term codes with their weights, and a bit table that passes most other words by."""

    codes: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.codes >> np.uint64(48)] = True

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        i = np.flatnonzero(self.seen[codes >> np.uint64(48)])
        if len(i) and len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes[i]), len(self.codes) - 1)
            out[i] = np.where(self.codes[at] == codes[i], self.weights[at], 0)
        return out


def view(s: Slice, mapping: np.ndarray) -> Slice:
    return Slice(mapping[s.buf], s.offsets, s.lo)


def term_codes(w: Slice):
    """(word index, code) of all words and stems: stems are told from words by their length."""
    size = w.ends - w.starts
    yield np.arange(len(size)), w.codes()
    for p in PREFIXES:
        i = np.flatnonzero(size > p)
        yield i, w.codes(w.starts[i], w.starts[i] + p) ^ np.uint64(p * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def _nearest(hits: np.ndarray, marks: np.ndarray, far: int = 100) -> np.ndarray:
    """Distance of each position in ``hits`` to the nearest of the sorted ``marks``."""
    if not len(marks):
        return np.full(len(hits), far)
    i = np.searchsorted(marks, hits)
    left = np.where(i > 0, hits - marks[np.maximum(i - 1, 0)], far)
    right = np.where(i < len(marks), marks[np.minimum(i, len(marks) - 1)] - hits, far)
    return np.minimum(np.minimum(left, right), far)


def slice_features(s: Slice, lexicon: Lexicon, person: np.ndarray) -> np.ndarray:
    """(rows, features) of one slice."""
    n_rows = s.hi - s.lo
    w = view(s, LOOSE)
    row = w.row_of_word()
    n = np.maximum(w.n_words, 1)
    weight = np.zeros(len(row))
    for i, code in term_codes(w):
        weight[i] = np.maximum(weight[i], lexicon.of(code))
    hit = np.flatnonzero(weight)
    codes = w.codes()
    mark = np.flatnonzero(np.isin(codes, person))
    hits = np.bincount(row[hit], minlength=n_rows)
    sums = np.bincount(row[hit], weight[hit], minlength=n_rows)
    top = np.zeros(n_rows)
    np.maximum.at(top, row[hit], weight[hit])
    different = np.unique(np.stack((row[hit].astype(np.uint64), codes[hit])), axis=1)[0].astype(np.int64) if len(hit) else hit
    # 1000 * row keeps words of other texts far away
    near = _nearest(hit + 1000 * row[hit], mark + 1000 * row[mark])
    nearness = np.bincount(row[hit], np.exp(-near / 10), minlength=n_rows)
    closest = np.full(n_rows, 100.0)
    np.minimum.at(closest, row[hit], near)
    upper = (s.buf >= 0x41) & (s.buf <= 0x5A)
    letters = np.maximum(_per_row(LETTER[s.buf], s.offsets), 1)
    size = np.maximum(np.diff(s.offsets), 1)
    inside = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
    caps = (inside[w.ends] - inside[w.starts] >= 2) & (inside[w.ends] - inside[w.starts] == w.ends - w.starts)
    # words of letters and signs that stand for letters, and a letter three times in a row
    inside = np.concatenate(([0], np.cumsum(SIGN[s.buf], dtype=np.int64)))
    signs = inside[w.ends] - inside[w.starts]
    odd = (signs > 0) & (signs < w.ends - w.starts)
    thrice = np.zeros(len(s.buf), bool)
    thrice[2:] = LETTER[s.buf[2:]] & (s.buf[2:] == s.buf[1:-1]) & (s.buf[1:-1] == s.buf[:-2])
    return np.column_stack((
        np.log1p(w.n_words), hits, hits / n, sums / n, top, np.bincount(different, minlength=n_rows),
        np.bincount(row[mark], minlength=n_rows) / n, nearness, closest, _per_row(upper, s.offsets) / letters,
        np.bincount(row[caps], minlength=n_rows) / n, _per_row((s.buf == 0x21) | (s.buf == 0x3F), s.offsets) / size,
        _per_row(PUNCT[s.buf], s.offsets) / size, np.bincount(row[odd], minlength=n_rows) / n, _per_row(thrice, s.offsets) / n)).astype(float)


# ------------------------------------------------------------------ trees and calibration

@dataclasses.dataclass
class Trees:
    """Boosted trees of one depth as arrays: node k's children are 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray      # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray        # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2 ** DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss with histogram splits, level by level."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin, inner = np.full(len(y), base), 2 ** DEPTH - 1
    feats, cut_values, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                k = (node - first) * BINS + bins[:, j]
                hg = np.bincount(k, g, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                hh = np.bincount(k, h, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = (hg ** 2 / (hh + LEAF_L2) + (tg - hg) ** 2 / (th - hh + LEAF_L2) - tg ** 2 / (th + LEAF_L2))[:, :len(cuts[j])]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                f[first:first + width][better] = j
                c[first:first + width][better] = cuts[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        leaf = node - inner
        v = -RATE * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + LEAF_L2)
        margin += v[leaf]
        feats.append(f)
        cut_values.append(c)
        values.append(v)
    return Trees(base, np.array(feats), np.array(cut_values), np.array(values))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (knots, probabilities), rising; equal margins are pooled first."""
    knots, inverse = np.unique(margin, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / n
    blocks: list[list[float]] = []
    for k, m, w in zip(knots, mean, n):
        blocks.append([m, w, k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, hi = blocks.pop()
            m1, w1, lo, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    return np.array([x for b in blocks for x in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


@dataclasses.dataclass
class Model:
    lexicon: Lexicon
    person: np.ndarray
    trees: Trees | None
    knots: np.ndarray
    probabilities: np.ndarray
    prior: float

    def score(self, s: Slice) -> np.ndarray:
        if self.trees is None:
            return np.full(s.hi - s.lo, self.prior)
        return np.interp(self.trees.margin(slice_features(s, self.lexicon, self.person)), self.knots, self.probabilities)


# ------------------------------------------------------------------ fit and apply

def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")), F.lit(0)) % 5 == 0


def _term_counts(batch):
    rows, codes = [], []
    toxic = batch.column("toxic").to_numpy()
    for s in slices(batch.column("text")):
        w = view(s, LOOSE)
        row = w.row_of_word()
        for i, code in term_codes(w):
            rows.append(s.lo + row[i])
            codes.append(code)
    order = np.lexsort((r := np.concatenate(rows), c := np.concatenate(codes)))
    r, c = r[order], c[order]
    once = np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1]))) if len(r) else np.zeros(0, bool)
    r, c = r[once], c[once]
    terms, at = np.unique(c, return_inverse=True)
    bad = np.bincount(at, toxic[r], minlength=len(terms)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(terms)) - bad)],
                                     ["term", "bad", "good"])


def _features(batch, lexicon, person):
    x = np.concatenate([slice_features(s, lexicon, person) for s in slices(batch.column("text"))])
    yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("part"), pa.array(list(x), pa.list_(pa.float64()))],
                                     ["toxic", "part", "x"])


def learning_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, toxic, part 0..9): the bounded sample; part by a hash of the id."""
    y = labels.groupBy(id_col).agg(F.max(label_col).alias("toxic")).filter(~held_out(F.col(id_col)) & F.col("toxic").isNotNull())
    ids = docs.select(id_col).join(y, id_col).distinct().withColumn("order", F.xxhash64(F.col(id_col), F.lit("fit")))
    few = [ids.filter(F.col("toxic") == c).orderBy("order", id_col).limit(sample) for c in (0, 1)]
    chosen = few[0].unionByName(few[1])
    # at most 2 * sample ids: a proven bound for the broadcast
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    return rows.groupBy(F.xxhash64("text").alias("same")).agg(
        F.first("text").alias("text"), F.max("toxic").cast("long").alias("toxic"),
        F.pmod(F.min(F.xxhash64(F.col("order"), F.lit("part"))), F.lit(10)).cast("int").alias("part"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """The terms of ``rows`` (text, toxic) with the highest log odds."""
    counts = rows.select("text", "toxic").transform(in_tasks(_term_counts, "term long, bad long, good long")) \
        .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = rows.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).first()
    bad, good = n["bad"] or 0, n["all"] - (n["bad"] or 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    top = counts.filter(F.col("bad") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS) \
        .orderBy(F.desc(F.col("odds") * F.log1p("bad")), "term").limit(LEXICON).collect()
    terms = np.array([r["term"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(terms)
    return Lexicon(terms[order], np.array([r["odds"] for r in top], float)[order])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE) -> Model:
    """The model, from learning folds only."""
    rows = learning_sample(docs, labels, id_col, text_col, label_col, sample).persist()
    person = np.sort(np.array([code_of(w.encode()) for w in SECOND_PERSON.split()], np.uint64))
    none = Lexicon(np.empty(0, np.uint64), np.empty(0))
    try:
        totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        prior = totals.get(1, 0) / max(1, sum(totals.values()))
        if not totals.get(0) or not totals.get(1):
            return Model(none, person, None, np.zeros(1), np.zeros(1), prior)
        lexicon = learn_lexicon(rows.filter("part < 5"))
        rest = rows.filter("part >= 5").select("text", "toxic", "part").transform(
            in_tasks(_features, "toxic long, part int, x array<double>", lexicon, person)).toPandas()
    finally:
        rows.unpersist()
    rest = rest.assign(key=[tuple(v) for v in rest["x"]]).sort_values(["part", "toxic", "key"])  # the fit must not depend on row order
    x, y = np.array(rest["key"].tolist(), float).reshape(len(rest), -1), rest["toxic"].to_numpy(float)
    tree = rest["part"].to_numpy() < 8
    if len(set(y[tree])) < 2 or len(set(y[~tree])) < 2:
        return Model(none, person, None, np.zeros(1), np.zeros(1), prior)
    trees = fit_trees(x[tree], y[tree])
    knots, probabilities = isotonic(trees.margin(x[~tree]), y[~tree])
    return Model(lexicon, person, trees, knots, probabilities, prior)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batch, m):
        score = np.concatenate([m.score(s) for s in slices(batch.column("text"))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])
    return d.transform(in_tasks(run, f"doc_id {kind}, score double", model))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score (a column of that name is replaced)."""
    d = docs.drop(score_col)
    schema = d.withColumn(score_col, F.lit(0.0)).schema

    def run(batch, m):
        score = np.concatenate([m.score(s) for s in slices(batch.column(text_col))])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, score_col])
    return d.transform(in_tasks(run, schema, model))


@register("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    s = scored(docs, model)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
