"""Operator 9: removal of repeated word windows, with a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document; each word that lies in a window whose
word sequence also starts in a document with a smaller id goes.

First pass (count-min sketch). Consecutive windows that share their smallest inner
run of ``INNER`` words form a *stretch* with that run's hash as key (of as many windows as can share a run, where equal runs
follow each other). Equal windows have equal keys, so the number of stretches with a window's key is never below the number of documents that
hold the window. Keys are counted in a count-min sketch that is split into shards by key: each
task sends the sparse sketch of its rows (a cell once, with its count), each
shard merges these by addition, and the estimate of a key is the least of its cells. The number of
shards follows the input, so a shard has bounded size and collisions stay rare at every scale.
Only stretches with an estimate of two or more go on; a window's estimate is never
too low, so none is lost.

Second pass (exact). The windows of the stretches left are told apart by 128 bits of two
independent hashes (the key and a hash of the whole window). Stretches meet by key: in a key's sorted
run of stretches the smallest document of every window is found with array operations. A stretch has a bounded number of
windows, so an estimate bounds a key's windows. Keys with an estimate over
``HOT_KEY`` go a different way of equal result: their windows (runs of equal ones as one row) are grouped with partial
aggregation and joined back, so no task holds a whole hot key.

Third pass: the removed word ranges meet their texts, and what is left is joined.

Defined results: null and empty texts have no words; a null id counts as greater than
any other; rows with the same id never remove words of each other (a repeated row is not a smaller
document); an empty table gives an empty result; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.llm.common import in_tasks, register, shuffle_partitions, table, written
from ranklab.llm.words import Rolling, Slice, slices, sliding_min
from ranklab.session import cut_lineage

WINDOW = 50
INNER = 16
HOT_KEY = 2000
SHARD_KEYS = 1 << 18          # stretches a shard is planned for
CELLS = 1 << 20               # cells of each of a shard's two sketch rows
NO_ID = (1 << 63) - 1

_INNER_HASH = Rolling(0xD1342543DE82EF95)
_WINDOW_HASH = Rolling(0xAF251AF3B0F025B5)
STRETCH = np.dtype([("key", "<i8"), ("row", "<i8"), ("id", "<i8"), ("at", "<i4"), ("n", "<i4")])


def stretches(s: Slice, window: int, inner: int):
    """(start word, number of windows, key) of the slice's stretches, and all window hashes by start word."""
    codes = s.codes()
    if len(codes) < window:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    low = sliding_min(_INNER_HASH.windows(codes, inner), window - inner + 1)
    ok = s.windows(window)[:len(low)]
    row = s.row_of_word()[:len(low)]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    # in a text that repeats itself neighbouring runs are equal, and a stretch could go on without end
    place = np.arange(len(new))
    new |= ok & ((place - np.maximum.accumulate(np.where(new, place, 0))) % (window - inner + 1) == 0)
    at = np.flatnonzero(new)
    n = np.add.reduceat(ok.astype(np.int64), at) if len(at) else at
    return at, n, low[at], _WINDOW_HASH.windows(codes, window)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): ``row`` tells rows apart together with ``id``; a null id becomes the greatest id."""
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.col(text_col).cast("string").alias("text"))


# ------------------------------------------------------------------ first pass

def _cells(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    k = keys.view(np.uint64)
    return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(cells), \
        ((k * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(38)) % np.uint64(cells)


def _shard_rows(found: np.ndarray, shards: int):
    shard = (found["key"].view(np.uint64) >> np.uint64(44)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    found, shard = found[order], shard[order]
    cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    for a, b in zip(cut, [*cut[1:], len(found)]):
        yield int(shard[a]), found[a:b].tobytes()


def _first_pass(batch, window: int, inner: int, shards: int):
    rows, ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
    parts = []
    for s in slices(batch.column("text")):
        at, n, key, _ = stretches(s, window, inner)
        if len(at):
            r = s.row_of_word()[at]
            f = np.empty(len(at), STRETCH)
            f["key"], f["row"], f["id"] = key.view(np.int64), rows[s.lo + r], ids[s.lo + r]
            f["at"], f["n"] = at - s.first[r], n
            parts.append(f)
    if parts:
        out = list(_shard_rows(np.concatenate(parts), shards))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())],
                                         ["shard", "found"])


def _partition_sketches(cells: int):
    """Per task and shard: the touched cells of both sketch rows with their counts."""
    def run(batches):
        sketch: dict[int, list] = {}
        size = 0

        def flush():
            ids = sorted(sketch)
            out = []
            for i in ids:
                keys = np.concatenate(sketch[i])
                row = [np.unique(c, return_counts=True) for c in _cells(keys, cells)]
                out.append([x.astype(t).tobytes() for c, k in row for x, t in ((c, np.uint32), (np.minimum(k, 1 << 30), np.uint32))])
            sketch.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array([o[j] for o in out], pa.binary()) for j in range(4)]],
                                              ["shard", "c0", "n0", "c1", "n1"])
        for batch in batches:
            for shard, found in zip(batch.column("shard").to_pylist(), batch.column("found")):
                keys = np.frombuffer(found.as_py(), STRETCH)["key"].copy()
                sketch.setdefault(shard, []).append(keys)
                size += len(keys)
                if size > 1_000_000:
                    yield flush()
                    size = 0
        if sketch:
            yield flush()
    return run


def _merge(cells: int):
    """One shard: its partial sketches added up."""
    def run(table):
        rows = [np.zeros(cells, np.uint32), np.zeros(cells, np.uint32)]
        for j in (0, 1):
            for c, n in zip(table.column(f"c{j}"), table.column(f"n{j}")):
                at, n = np.frombuffer(c.as_py(), np.uint32), np.frombuffer(n.as_py(), np.uint32)
                rows[j][at] += np.minimum(n, np.uint32(1 << 31) - rows[j][at])
        at = [np.flatnonzero(r > 1).astype(np.uint32) for r in rows]  # cells that can raise an estimate over one
        return pa.table({"shard": table.column("shard")[:1].combine_chunks()} | {
            name: pa.array([x.tobytes()], pa.binary())
            for j in (0, 1) for name, x in ((f"c{j}", at[j]), (f"n{j}", rows[j][at[j]]))})
    return run


def _estimates(keys, cells, c, n):
    est = None
    for cell, at, count in zip(_cells(keys, cells), c, n):
        i = np.minimum(np.searchsorted(at, cell), max(len(at) - 1, 0))
        k = np.where(at[i] == cell, count[i], 1) if len(at) else np.ones(len(keys), np.uint32)
        est = k if est is None else np.minimum(est, k)
    return est


def _repeated(batch, cells: int):
    """Stretches with an estimate over one."""
    out, ests = [], []
    for i in range(batch.num_rows):
        found = np.frombuffer(batch.column("found")[i].as_py(), STRETCH)
        sk = [np.frombuffer(batch.column(c)[i].as_py(), np.uint32) for c in ("c0", "n0", "c1", "n1")]
        est = _estimates(found["key"].copy(), cells, sk[0::2], sk[1::2])
        out.append(found[est > 1])
        ests.append(est[est > 1])
    f, e = np.concatenate(out), np.concatenate(ests)
    yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(f[c])) for c in ("row", "id", "at", "n")], pa.array(e.astype(np.int64))],
                                     ["row", "id", "at", "n", "est"])


def repeated_stretches(keyed_docs: DataFrame, window: int, inner: int, shard_keys: int = SHARD_KEYS, cells: int = CELLS) -> DataFrame:
    """(row, id, at, n, est): the stretches whose count-min estimate is two or more."""
    size = keyed_docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + int(size / 6 * 2 / (window - inner + 2) / shard_keys)  # about six bytes a word
    found = cut_lineage(keyed_docs.transform(in_tasks(_first_pass, "shard int, found binary", window, inner, shards)))
    sketches = found.mapInArrow(_partition_sketches(cells), "shard int, c0 binary, n0 binary, c1 binary, n1 binary")
    sketch = sketches.groupBy("shard").applyInArrow(_merge(cells), "shard int, c0 binary, n0 binary, c1 binary, n1 binary")
    return found.join(sketch, "shard").transform(in_tasks(_repeated, "row long, id long, at int, n int, est long", cells))


# ------------------------------------------------------------------ second pass

def _window_hashes(batch, window: int, inner: int):
    """For the wanted stretches of each text: key and window hashes."""
    rows, ids, want = batch.column("row").to_numpy(), batch.column("id").to_numpy(), batch.column("want")
    out = []
    size = 0

    def flush():
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()),
             pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.int64())], ["key", "row", "id", "at", "hashes", "est"])
    for s in slices(batch.column("text")):
        at, n, key, hashes = stretches(s, window, inner)
        if not len(at):
            continue
        r = s.row_of_word()[at]
        rel = at - s.first[r]
        for row in np.unique(r):
            wanted = {x["at"]: x["est"] for x in want[s.lo + int(row)].as_py()}
            for i in range(*np.searchsorted(r, (row, row + 1))):
                est = wanted.get(int(rel[i]))
                if est is not None:
                    out.append((int(key[i].view(np.int64)), int(rows[s.lo + row]), int(ids[s.lo + row]), int(rel[i]),
                                hashes[at[i]:at[i] + n[i]].tobytes(), est))
                    size += n[i]
        if size > 200_000:
            yield flush()
            out, size = [], 0
    if out:
        yield flush()


def _later_windows(keys: list, ids: np.ndarray, starts: np.ndarray, blobs: list):
    """Of whole keys' stretches: index, start and number of consecutive windows that a smaller id holds too."""
    n = np.array([len(b) // 8 for b in blobs])
    hashes = np.frombuffer(b"".join(blobs), np.uint64)
    owner = np.repeat(np.arange(len(blobs)), n)
    group = np.unique(np.array(keys), return_inverse=True)[1]
    order = np.lexsort((ids[owner], hashes, group[owner]))
    g, h, i = group[owner][order], hashes[order], ids[owner][order]
    first = np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])))
    least = i[first][np.cumsum(first) - 1]
    late = np.zeros(len(order), bool)
    late[order] = i > least
    pos = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    run = late.copy()
    run[1:] &= ~late[:-1] | (owner[1:] != owner[:-1])
    a = np.flatnonzero(run)
    length = np.add.reduceat(late.astype(np.int64), a) if len(a) else a
    # a run ends at its stretch's end or its first window that stays, so the sum up to the next run is its length
    return owner[a], pos[a], length


def _by_key(batches):
    """Sorted by key: whole keys at a time, several keys together."""
    held: list = []
    size = 0

    def resolve(rows):
        ids, at = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        o, pos, n = _later_windows([r[0] for r in rows], ids, at, [r[4] for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in o], pa.int64()), pa.array(ids[o], pa.int64()), pa.array(pos.astype(np.int32)),
             pa.array(n.astype(np.int32))], ["row", "id", "at", "n"])
    for batch in batches:
        for r in zip(*[batch.column(c).to_pylist() for c in ("key", "row", "id", "at", "hashes")]):
            if size > 200_000 and r[0] != held[-1][0]:
                yield resolve(held)
                held, size = [], 0
            held.append(r)
            size += len(r[4]) // 8
    if held:
        yield resolve(held)


def _unpacked(batch):
    """One row for each run of equal windows of a stretch."""
    n = np.array([len(b.as_py()) // 8 for b in batch.column("hashes")])
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + batch.column("at").to_numpy()[owner]
    hashes = np.frombuffer(b"".join(b.as_py() for b in batch.column("hashes")), np.int64)
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))[:len(hashes)])
    yield pa.RecordBatch.from_arrays([*[pa.array(batch.column(c).to_numpy()[owner[new]]) for c in ("key", "row", "id")],
                                      pa.array(at[new].astype(np.int32)), pa.array(hashes[new]), pa.array(np.diff(np.append(new, len(hashes))).astype(np.int32))],
                                     ["key", "row", "id", "at", "hash", "n"])


def later_windows(keyed_docs: DataFrame, window: int = WINDOW, inner: int = INNER, hot_key: int = HOT_KEY,
                  shard_keys: int = SHARD_KEYS, cells: int = CELLS) -> DataFrame:
    """(row, id, at, n): ``n`` windows from word ``at`` on whose words also start in a document with a smaller id."""
    found = repeated_stretches(keyed_docs, window, inner, shard_keys, cells)
    want = found.groupBy("row", "id").agg(F.collect_list(F.struct("at", "est")).alias("want"))
    hashed = written(keyed_docs.join(want, ["row", "id"]).transform(
        in_tasks(_window_hashes, "key long, row long, id long, at int, hashes binary, est long", window, inner)), "windows")
    n = shuffle_partitions(keyed_docs.sparkSession)
    usual = hashed.filter(F.col("est") <= hot_key).drop("est").repartition(n, "key").sortWithinPartitions("key") \
        .mapInArrow(_by_key, "row long, id long, at int, n int")
    hot = hashed.filter(F.col("est") > hot_key).drop("est").transform(
        in_tasks(_unpacked, "key long, row long, id long, at int, hash long, n int"))
    least = hot.groupBy("key", "hash").agg(F.min("id").alias("least"))
    # a written table: both sides of the join are then shuffled, so that Spark can split a hot window's rows
    hot = hot.join(cut_lineage(least), ["key", "hash"]).filter("id > least").select("row", "id", "at", "n")
    return usual.unionByName(hot)


# ------------------------------------------------------------------ third pass

def _kept(batch, window: int):
    gone = batch.column("gone")
    n_words, n_removed, texts = [], [], []
    for s in slices(batch.column("text")):
        for row in range(s.hi - s.lo):
            words = s.text(row).split()
            keep = np.ones(len(words), bool)
            ranges = gone[s.lo + row].as_py()
            if ranges:
                for x in ranges:
                    keep[x["at"]:x["at"] + x["n"] + window - 1] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            n_words.append(len(keep))
            n_removed.append(len(keep) - len(words))
            texts.append(b" ".join(words))
    yield pa.RecordBatch.from_arrays(
        [batch.column("row"), batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
         pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
        ["row", "id", "n_words", "n_removed", "kept", "kept_sha256"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, inner: int = INNER,
                 hot_key: int = HOT_KEY, shard_keys: int = SHARD_KEYS, cells: int = CELLS) -> DataFrame:
    """(row, id, n_words, n_removed, kept, kept_sha256) per row of ``docs``; ``kept`` as UTF-8 bytes."""
    k = keyed(docs, id_col, text_col)
    gone = later_windows(k, window, inner, hot_key, shard_keys, cells).distinct() \
        .groupBy("row", "id").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    return k.join(gone, ["row", "id"], "left").transform(
        in_tasks(_kept, "row long, id long, n_words long, n_removed long, kept binary, kept_sha256 string", window))


def _rewritten(batch, window: int, text_col: str, size_col: str | None, names: list):
    cols = batch.column("doc").flatten()
    old = cols[names.index(text_col)]
    done = next(_kept(pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("gone"), old], ["row", "id", "gone", "text"]), window))
    texts, removed = done.column("kept"), done.column("n_removed").to_pylist()
    new = pa.array([texts[i].as_py().decode("utf-8", "replace") if k else old[i].as_py() for i, k in enumerate(removed)], pa.string())
    cols[names.index(text_col)] = new
    if size_col in names:
        kept = cols[names.index(size_col)]
        cols[names.index(size_col)] = pa.array([len(new[i].as_py()) if k else kept[i].as_py() for i, k in enumerate(removed)], kept.type)
    yield pa.RecordBatch.from_arrays(cols, names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` with all columns; texts that lose words hold the kept words joined by one space (and their new length in ``size_col``),
    other texts stay as they are. The columns travel as one struct, so their names cannot clash."""
    k = keyed(docs, id_col, text_col)
    gone = later_windows(k, window).distinct().groupBy("row", "id").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    d = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
                    F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"))
    j = d.join(gone, ["row", "id"], "left")
    return j.transform(in_tasks(_rewritten, docs.schema, window, text_col, size_col, docs.columns))


@register("op9_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM h),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM m, (SELECT unnest(range(0, 50)) AS k) WHERE least < doc_id),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT a.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY a.i) FILTER (WHERE g.i IS NULL) AS kept
      FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id""")
def op9_substring_dedup(spark, sf_dir):
    d = deduplicated(table(spark, sf_dir, "documents"))
    return d.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
