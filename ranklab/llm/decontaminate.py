"""Operator 3: benchmark decontamination by a distributed positional inverted index.

All of it is DataFrame operations (no Python in tasks):

1. Corpus frequency of every test term (partial counts in each task, then added up).
2. Distinct windows of the test items. Equal windows, of one item or of many, are looked up once: each has one place that represents it.
3. The index: postings (term, document, position) of the terms that the test set looks up first, the
   ``LOOKUPS`` rarest of each window. It is range-partitioned by term and document, so a frequent term spans
   partitions, and stored as Parquet in the shared folder. A window with a term that the corpus does not hold is
   dropped at once.
4. Posting lists are adjusted by the term's offset in the item: equal (document, item, position - offset) means the
   terms stand on one diagonal. Lists are intersected on that diagonal: a window stays only if its rarest terms
   all do.
5. For the places left, the document's words are read off and compared with the windows in full, so matches are exact
   phrases. A place is a row of its own that carries the words of one window, never those of the document.

``proximity_matches`` answers the unordered question from the same index: all terms of an item within a span of words of its rarest one.
Candidates come from the rarest terms, and every other term is then looked for in the words around.

Which side of a join is broadcast is left to Spark, which knows the sizes: the tables of the test side are written first.

Defined results: null and empty texts have no words and no hits; an item without words has no window; a
shorter item is one window; repeated documents get equal rows; items with equal ids count once; a null item id marks hit words but
is not listed; empty tables give no rows or no hits; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.llm.common import free_names, register, shared_path, shuffle_partitions, table, written

WINDOW = 13
LOOKUPS = 2
SPAN, RAREST = 50, 3          # proximity: words around the rarest term, terms looked up
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text) -> F.Column:
    """Lower-cased (A-Z) words; an empty string stands at either end where the text has separators there."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), SEPARATORS)


def count_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text); ``row`` identifies the row's content, so equal rows share it."""
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("string").alias("text"))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, item_id, terms, size): the words of each item and its window size."""
    w = F.filter(words_of(F.col(text_col)), lambda x: x != "")
    i = items.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("item"), F.col(id_col).cast("string").alias("item_id"), w.alias("terms"))
    return i.filter(F.size("terms") > 0).distinct().withColumn("size", F.least(F.size("terms"), F.lit(window)))


def corpus_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq) over all documents, of the given terms that occur."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item, item_id, at, size, words, phrase): every window of every item; ``phrase`` is its words joined."""
    starts = F.sequence(F.lit(0), F.size("terms") - F.col("size"))
    w = items.select("item", "item_id", "size", F.explode(F.transform(starts, lambda a: F.struct(
        a.alias("at"), F.slice("terms", a + 1, F.col("size")).alias("words")))).alias("w"))
    return w.select("item", "item_id", "size", "w.at", "w.words", F.array_join("w.words", " ").alias("phrase"))


def window_terms(windows: DataFrame, freq: DataFrame) -> DataFrame:
    """(item, at, size, phrase, terms): per distinct window its representative place and its terms (freq, q = position in the
    item, term), rarest first; windows with an unseen term are left out."""
    one = windows.groupBy("phrase").agg(F.min_by(F.struct("item", "at", "size", "words"), F.struct("item", "at")).alias("w"))
    t = one.select("phrase", "w.item", "w.at", "w.size", F.posexplode("w.words").alias("k", "term")).join(freq, "term")
    g = t.groupBy("item", "at", "size", "phrase").agg(F.sort_array(F.collect_list(F.struct("freq", (F.col("at") + F.col("k")).alias("q"), "term"))).alias("terms"))
    return g.filter(F.size("terms") == F.col("size"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, row, id, pos) of the given terms."""
    p = docs.select("row", "id", F.posexplode(words_of(F.col("text"))).alias("pos", "term")).join(terms, "term")
    spark = docs.sparkSession
    path = shared_path(spark, "postings")
    p.select("term", "row", "id", "pos").repartitionByRange(shuffle_partitions(spark), "term", "row").sortWithinPartitions("term", "row", "pos") \
        .write.parquet(path)
    return spark.read.parquet(path)


def intersect(index: DataFrame, windows: DataFrame, lookups: int = LOOKUPS) -> DataFrame:
    """(row, id, start, size): where the ``lookups`` rarest terms of some window all stand at its offsets.

    A posting of a term at item position q adjusts to diagonal pos - q; per diagonal the positions that
    stand there are gathered, and those with enough of them are held against the windows.
    """
    rare = windows.select("item", "at", "size", F.slice("terms", 1, lookups).alias("terms"))
    needs = rare.select("item", "at", "size", F.size("terms").alias("need"), F.explode("terms.q").alias("q"))
    offsets = rare.select("item", F.explode("terms").alias("t"), F.size("terms").alias("need")) \
        .groupBy("item", F.col("t.term").alias("term"), F.col("t.q").alias("q")).agg(F.min("need").alias("least"))
    needs, offsets = written(needs, "needs"), written(offsets, "offsets")
    adjusted = index.join(offsets, "term").select("row", "id", "item", (F.col("pos") - F.col("q")).alias("diagonal"), "q", "least")
    on = adjusted.groupBy("row", "id", "item", "diagonal").agg(F.collect_set("q").alias("qs"), F.min("least").alias("least"))
    on = on.filter(F.size("qs") >= F.col("least")).select("row", "id", "item", "diagonal", F.explode("qs").alias("q"))
    full = on.join(needs, ["item", "q"]).groupBy("row", "id", "item", "diagonal", "at", "size", "need").agg(F.count(F.lit(1)).alias("n")).filter("n = need")
    return full.select("row", "id", (F.col("diagonal") + F.col("at")).alias("start"), "size").distinct()


def _with_words(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, id, found, words): the words of the documents in ``found`` (row, id, ...), with their rows of it as one array."""
    f = found.groupBy(F.col("row").alias("_row"), F.col("id").alias("_id")).agg(
        F.collect_list(F.struct(*[c for c in found.columns if c not in ("row", "id")])).alias("found"))
    j = docs.dropDuplicates(["row", "id"]).join(f, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")))
    return j.select("row", "id", "found", words_of(F.col("text")).alias("words"))


def phrase_hits(docs: DataFrame, windows: DataFrame, places: DataFrame) -> DataFrame:
    """(row, id, start, size, phrase): the exact occurrences of windows (phrase) among the places."""
    texts = _with_words(docs, places.filter("start >= 0"))
    read = texts.select("row", "id", F.explode(F.transform("found", lambda f: F.struct(
        f["start"].alias("start"), f["size"].alias("size"),
        F.array_join(F.slice("words", f["start"] + 1, f["size"]), " ").alias("phrase")))).alias("r"))
    return read.select("row", "id", "r.start", "r.size", "r.phrase").join(windows.select("phrase", "size").distinct(), ["phrase", "size"])


def words_covered(hits: DataFrame) -> DataFrame:
    """(row, id, n_hit): number of words inside any of the document's (start, size) stretches."""
    before = Window.partitionBy("row", "id").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)   # one document's hits
    h = hits.select("row", "id", "start", "size").distinct().withColumn("end", F.col("start") + F.col("size"))
    h = h.withColumn("done", F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start"))))
    return h.groupBy("row", "id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("done"))).alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, span: int | None = None) -> DataFrame:
    """Per document: row, id, n_words, n_hit, item_ids (sorted strings); with a ``span`` also near_ids (see ``proximity_matches``)."""
    d = keyed(docs, id_col, text_col)
    i = written(item_terms(items, item_col, item_text, window), "items")
    freq = written(corpus_frequency(d, written(i.select(F.explode("terms").alias("term")).distinct(), "terms")), "frequencies")
    windows = written(item_windows(i), "windows")
    ranked = written(window_terms(windows, freq), "window-terms")
    rare = ranked.select(F.explode(F.slice("terms", 1, LOOKUPS)).alias("t")).select("t.term")
    if span is not None:
        wanted = written(rarest_terms(i, freq), "rarest")
        rare = rare.unionByName(wanted.select("term"))
    index = build_index(d, written(rare.distinct(), "rare"))
    hits = written(phrase_hits(d, ranked, intersect(index, ranked)), "hits")
    ids = hits.select("row", "id", "phrase").distinct().join(windows.select("phrase", "item_id").distinct(), "phrase") \
        .groupBy("row", "id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    found = [(words_covered(hits), {"n_hit": F.lit(0)}), (ids, {"item_ids": F.array().cast("array<string>")})]
    if span is not None:
        near = near_places(d, i, wanted, index, span).groupBy("row", "id").agg(F.sort_array(F.collect_set("item_id")).alias("near_ids"))
        found.append((near, {"near_ids": F.array().cast("array<string>")}))
    out = d.select("row", "id", count_words(F.col("text")).alias("n_words"))
    for side, empty in found:
        (name, none), = empty.items()
        b = side.select(F.col("row").alias("_row"), F.col("id").alias("_id"), name)
        out = out.join(b, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")), "left") \
            .drop("_row", "_id").withColumn(name, F.coalesce(name, none))
    return out


def contaminated(n_hit, n_words) -> F.Column:
    """The contamination rule: at least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                         item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with all columns, without the documents that the contamination rule rejects."""
    c = contamination(docs, items, id_col, text_col, item_col, item_text, window)
    row, bad_row, bad_id = free_names(docs, "_row", "_bad_row", "_bad_id")
    bad = c.filter(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("row").alias(bad_row), F.col("id").alias(bad_id))
    d = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col)))
    return d.join(bad, (F.col(row) == F.col(bad_row)) & F.col(id_col).eqNullSafe(F.col(bad_id)), "left_anti").drop(row)


def rarest_terms(items: DataFrame, freq: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(item, term, rank, need): the least frequent distinct terms of every item whose terms all occur."""
    terms = items.select("item", F.explode(F.array_distinct("terms")).alias("term"))
    ranked = terms.join(freq, "term", "left").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("freq", "term"))).alias("t"), F.count(F.lit(1)).alias("n"), F.count("freq").alias("known"))
    ranked = ranked.filter("n = known").select("item", F.posexplode(F.slice("t", 1, rarest)).alias("rank", "t"), F.least("n", F.lit(rarest)).alias("need"))
    return ranked.select("item", F.col("t.term").alias("term"), (F.col("rank") + 1).alias("rank"), "need")


def near_places(docs: DataFrame, items: DataFrame, wanted: DataFrame, index: DataFrame, span: int) -> DataFrame:
    """(row, id, item_id, pos): where all distinct terms of an item stand within ``span`` words of its rarest term at ``pos``."""
    p = index.join(wanted, "term").withColumn("cell", F.floor(F.col("pos") / span))
    anchor = p.filter("rank = 1").select("row", "id", "item", "need", F.col("pos").alias("at"),
                                         F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = anchor.join(p.select("row", F.col("id").alias("_id"), "item", "cell", "pos", "rank"), ["row", "item", "cell"]) \
        .filter(F.col("id").eqNullSafe(F.col("_id")) & (F.abs(F.col("pos") - F.col("at")) <= span))
    found = near.groupBy("row", "id", "item", "need", "at").agg(F.count_distinct("rank").alias("n")).filter("n = need").select("row", "id", "item", "at")
    texts = _with_words(docs, found)
    around = texts.select("row", "id", F.explode(F.transform("found", lambda f: F.struct(
        f["item"].alias("item"), f["at"].alias("at"),
        F.array_distinct(F.slice("words", F.greatest(f["at"] - span, F.lit(0)) + 1, F.least(f["at"], F.lit(span)) + span + 1)).alias("near")))).alias("r"))
    j = around.select("row", "id", "r.item", "r.at", "r.near").join(items.select("item", "item_id", F.array_distinct("terms").alias("terms")), "item")
    return j.filter(F.size(F.array_except("terms", "near")) == 0).select("row", "id", "item_id", F.col("at").alias("pos"))


def proximity_matches(docs: DataFrame, items: DataFrame, span: int = SPAN, rarest: int = RAREST, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, pos): places of an item's least frequent term around which, in any order, all its distinct terms stand within
    ``span`` words. Equal frequencies are ordered by term; an item with a term that the corpus does not hold has no match."""
    d = keyed(docs, id_col, text_col)
    i = written(item_terms(items, item_col, item_text), "items")
    freq = written(corpus_frequency(d, written(i.select(F.explode("terms").alias("term")).distinct(), "terms")), "frequencies")
    wanted = written(rarest_terms(i, freq, rarest), "rarest")
    index = build_index(d, written(wanted.select("term").distinct(), "rare"))
    return near_places(d, i, wanted, index, span).select(F.col("id").alias("doc_id"), "item_id", "pos")


@register("op3_benchmark_decontamination", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least({WINDOW}, len(w)) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
       FROM (SELECT d.*, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l)),
h AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, s)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
it AS (SELECT DISTINCT item_id, unnest(w) AS term FROM b),
fr AS (SELECT term, count(*) AS freq FROM x WHERE term IN (SELECT term FROM it) GROUP BY term),
an AS (SELECT item_id, count(*) AS n, count(freq) AS known, arg_min(term, (freq, term)) AS term FROM it LEFT JOIN fr USING (term) GROUP BY item_id),
ap AS (SELECT doc_id, item_id, n, pos FROM an JOIN x USING (term) WHERE n = known),
nr AS (SELECT ap.doc_id, ap.item_id, ap.pos FROM ap JOIN it ON ap.item_id = it.item_id
       JOIN x ON x.doc_id = ap.doc_id AND x.term = it.term AND x.pos BETWEEN ap.pos - {SPAN} AND ap.pos + {SPAN}
       GROUP BY ap.doc_id, ap.item_id, ap.pos, ap.n HAVING count(DISTINCT it.term) = ap.n),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nn USING (doc_id)""")
def op3_benchmark_decontamination(spark, sf_dir):
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=SPAN)
    return c.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                    contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), F.size("near_ids").cast("long").alias("n_near"))
