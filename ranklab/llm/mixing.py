"""Operator 8: mixing sources to target weights.

Every document gets a hash-random key. Rows are range-sorted by (source, key)
over all partitions, so that one source, however large, is spread over
many tasks; word counts are summed along that order with per-piece totals;
and each source is cut at its exact budget. A budget above the source's size
takes whole epochs first and cuts the last one.

Defined results: a null text has size 0 and is taken 0 times; a null source is a
source of its own, after all others; repeated rows each get a row; an empty
table gives an empty result; equal keys (repeated ids) are ordered by id and size, and
rows that are equal there too are interchangeable. Extra columns are not carried, so
names cannot clash.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.llm.common import register, table, written
from ranklab.operators.ordered import range_pieces, with_running_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> + pos, target.

    Sources in code-point order (null last) weigh ``weights`` in turn. Targets share the
    total by weight; none exceeds ``max_epochs`` times its source, and the excess is shared
    again by weight: the level L with ``sum(min(max_epochs * size, L * weight)) = total``. In
    order of size / weight, a source is capped while its cap is below the level that
    the rest would get; the level is that of the first source not capped.
    """
    s = sizes.select("source", "source_size", F.lit(0).alias("_g"), F.lit(1).alias("_1"), F.col("source").isNull().alias("_null"))
    p = range_pieces(s, ["_g"], ["_null", "source"])
    s = with_running_sums(p, ["_g"], ["_null", "source"], {"pos": "_1"}).drop("_rp")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("_w", w.cast("double")).withColumn("_cap", F.col("source_size") * max_epochs) \
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    p = range_pieces(s, ["_g"], ["_ratio", "pos"])
    s = with_running_sums(p, ["_g"], ["_ratio", "pos"], {"_caps": "_cap", "_ws": "_w"}).drop("_rp")
    total, weight = s.agg(F.sum("source_size"), F.sum("_w")).first()
    total, weight = total or 0, weight or 0.0
    level = (F.lit(total) - (F.col("_caps") - F.col("_cap"))) / (F.lit(weight) - (F.col("_ws") - F.col("_w")))
    s = s.withColumn("_level", level)
    found = s.filter("_ratio > _level").agg(F.min_by("_level", F.struct("_ratio", "pos"))).first()[0]
    share = F.col("_w") * F.lit(found if found is not None else 0.0)
    return s.select("source", "source_size", F.col("pos").cast("long").alias("pos"),
                    F.least(F.col("_cap").cast("double"), share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words the mix takes of the document, repeats included: all epochs
    in full, and of the last one the documents first in key order, the last of
    them cut so that the source's sum is its rounded target exactly.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                         word_count(F.col(text_col)).alias("size"),
                         F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f"|{seed}"))).alias("_key"))
    narrow = written(narrow, "sizes")            # the range sort samples its input: texts are read once
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    t = targets.withColumnRenamed("source", "_source")
    rows = narrow.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = ["_key", "doc_id", "size"]
    pieces = range_pieces(rows, ["pos"], order)
    rows = with_running_sums(pieces, ["pos"], order, {"_cum": "size"})
    budget = F.round("target").cast("long")
    some = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / some)
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_cum") - F.col("size"))))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (epochs * F.col("size") + last).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: one row per document row and epoch (doc_id, epoch, text), the last text cut at its words.

    A row is found by its id, source and size; rows that agree in all three share what the mix takes of them in the order of their texts,
    so that each takes one of the amounts.
    """
    key = ["doc_id", "source", "size"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), word_count(F.col(text_col)).alias("size"))
    # rows equal in text as well are counted, not numbered: they are interchangeable
    rows = rows.groupBy(*key, "text").agg(F.count(F.lit(1)).alias("copies"))
    place = Window.partitionBy(*key).orderBy("text")            # different texts of one id, source and size
    rows = rows.withColumn("last", F.sum("copies").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select(*key, "text", (F.col("last") - F.col("copies")).alias("before"), "last")
    amounts = mixed.groupBy(*key, "taken").agg(F.count(F.lit(1)).alias("copies"))
    taken = Window.partitionBy(*key).orderBy("taken")
    amounts = amounts.withColumn("_last", F.sum("copies").over(taken.rowsBetween(Window.unboundedPreceding, 0)))
    amounts = amounts.select(*[F.col(c).alias(f"_{c}") for c in key], "taken", (F.col("_last") - F.col("copies")).alias("_before"), "_last")
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    j = rows.join(amounts, same & (F.col("before") < F.col("_last")) & (F.col("_before") < F.col("last")))
    j = j.withColumn("_n", F.least("last", "_last") - F.greatest("before", "_before")).filter("taken > 0")
    j = j.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    j = j.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    part = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    cut = F.concat_ws(" ", F.slice(words, F.lit(1), part.cast("int")))
    return j.select("doc_id", "epoch", F.when(part >= F.col("size"), F.col("text")).otherwise(cut).alias("text"))


@register("op8_mix_sources", f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|{SEED}') AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos
       FROM d GROUP BY source),
s AS (SELECT *, CAST([1, 2, 3][CAST((pos - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, source_size * {MAX_EPOCHS} AS cap FROM s0),
f AS (SELECT *, cap / w AS ratio,
        ((SELECT sum(source_size) FROM s) - (sum(cap) OVER o - cap)) / ((SELECT sum(w) FROM s) - (sum(w) OVER o - w)) AS level
      FROM s WINDOW o AS (ORDER BY cap / w, pos)),
l AS (SELECT coalesce(min_by(level, (ratio, pos)), 0.0) AS level FROM f WHERE ratio > level),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * l.level) AS target FROM f, l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((budget // greatest(source_size, 1)) * size + greatest(0, least(size,
            budget - (budget // greatest(source_size, 1)) * source_size - (cum - size))) AS BIGINT) AS taken
FROM c""")
def op8_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
