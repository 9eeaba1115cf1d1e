"""Operator 2: SimHash near-duplicates by tiled exact comparison.

1. Each text gets a 64-bit fingerprint: bit i is set if it is set in over half of the
   XXH64 values of its word shingles. Words, hashes and bit counts are array
   operations over slices of the column.
2. Equal fingerprints become one row. Distinct fingerprints are sorted by the
   population counts of their ``blocks`` equal parts and cut into tiles of at most ``TILE`` rows.
3. Two fingerprints within the radius have part counts whose differences sum to the
   radius at most, so a tile meets only the tiles whose counts are that near; all other
   tile pairs are skipped, none of them could hold a link. Each remaining pair of tiles is compared
   in full with exclusive-or and bit counts.
4. A tile pair sends one edge a linked fingerprint, and connected components of these edges are
   the groups.

More parts skip more pairs but make smaller tiles; ``parts_for`` takes more of them
as the corpus grows, so that the number of fingerprints that share their counts stays
bounded. The links are the same for every choice.

Defined results: null and empty texts, and texts without words, have fingerprint zero and
are linked like any other; a null id is never the smallest id of a group (component_id is
null if the group has no other); repeated rows are in one group; an empty table gives an
empty result. Only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.llm.common import components, free_names, in_tasks, link_labels, register, shuffle_partitions, table
from ranklab.llm.words import Slice, slices
from ranklab.session import cut_lineage

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
TILE = 4096

# XXH64's published primes.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                             0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x, r: int):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the byte spans ``buf[lo:hi]``, all at once."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    words = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    seed = np.uint64(seed)
    size = (hi - lo).astype(np.int64)
    at = lo.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(lo), seed + P5, np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            v = [np.full(len(long), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            stripes = size[long] // 32
            active, k = np.arange(len(long)), 0
            while len(active):
                base = at[long[active]] + 32 * k
                for j in range(4):
                    v[j][active] = _round(v[j][active], words[base + 8 * j])
                k += 1
                active = active[stripes[active] > k]
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                x = (x ^ _round(np.uint64(0), v[j])) * P1 + P4
            h[long] = x
            at[long] += 32 * stripes
        h += size.astype(np.uint64)
        rest = lo + size - at
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * (k + 1))
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ _round(np.uint64(0), words[at[i] + 8 * k]), 27) * P1 + P4
        at += rest // 8 * 8
        rest = rest % 8
        i = np.flatnonzero(rest >= 4)
        h[i] = _rotl(h[i] ^ (words[at[i]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at[i] += 4
        rest[i] -= 4
        for k in range(3):
            i = np.flatnonzero(rest > k)
            h[i] = _rotl(h[i] ^ padded[at[i] + k].astype(np.uint64) * P5, 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def joined_words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the slice's words with one space after each."""
    size = s.ends - s.starts
    ends = np.cumsum(size + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    gap = np.zeros(len(out), bool)
    gap[ends] = True
    inside = np.zeros(len(s.buf) + 1, np.int8)
    inside[s.starts] += 1
    inside[s.ends] -= 1
    out[~gap] = s.buf[np.cumsum(inside[:-1]) > 0]
    return out, ends - size, ends


_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``counts`` hashes: the bits set in over half of each group (0 for none)."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    start = np.cumsum(n) - n
    blocks = -(-n // 255)  # 255 hashes fit a byte lane
    first = np.cumsum(blocks) - blocks
    at = np.repeat(start - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], at, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)
    out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def slice_fingerprints(s: Slice, width: int) -> np.ndarray:
    buf, starts, ends = joined_words(s)
    n = s.n_words
    index = np.arange(len(starts))
    row = s.row_of_word()
    begins = s.windows(width) | ((index == s.first[:-1][row]) & (n < width)[row])
    i = np.flatnonzero(begins)
    last = np.minimum(i + width - 1, s.first[1:][row[i]] - 1)
    return majority_bits(xxh64(buf, starts[i], ends[last]), np.bincount(row[i], minlength=len(n)))


def _fingerprints(batch, width: int):
    out = [slice_fingerprints(s, width) for s in slices(batch.column("text"), lower=True)]
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.concatenate(out).view(np.int64))],
                                     ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row, fp): one row per document, the fingerprint as a signed long; ``row`` is a hash of id and text."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                    F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"))
    return d.transform(in_tasks(_fingerprints, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, row long, fp long", width))


def parts_for(n: int) -> int:
    """Parts whose counts tell about n / 512 classes apart (10 at most: six bits a count)."""
    for parts in (4, 6, 8):
        if n <= 512 * (2 * math.sqrt(math.pi) * math.sqrt(64 / parts) / 2) ** parts:
            return parts
    return 10


def part_masks(parts: int) -> list[int]:
    edge = [64 * i // parts for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]


def near_counts(parts: int, radius: int) -> list[int]:
    """Packed differences of part counts that sum to the radius at most: zero, and one of each pair of opposites."""
    found = {0: 0}
    for b in range(parts):
        step = 1 << (6 * b)
        found = {v + d * step: used + abs(d) for v, used in found.items()
                 for d in range(used - radius, radius - used + 1)}
    return sorted(v for v in found if v >= 0)


def _tiles(batch, tile: int):
    counts, fp = batch.column("counts").to_numpy(), batch.column("fp").to_numpy()
    new = np.flatnonzero(np.concatenate(([True], counts[1:] != counts[:-1])))
    end = np.append(new[1:], len(counts))
    cuts = [(a, min(a + tile, hi)) for lo, hi in zip(new, end) for a in range(lo, hi, tile)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([int(counts[a]) for a, _ in cuts], pa.int64()), pa.array([int(fp[a]) for a, _ in cuts], pa.int64()),
         pa.array([fp[a:b].tobytes() for a, b in cuts], pa.binary())], ["counts", "first", "fps"])


def _compare(batch, radius: int):
    us, vs = [], []
    for a, b in zip(batch.column("fps"), batch.column("fps2")):
        a, b = np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)
        near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= radius
        if len(a) == len(b) and (a == b).all():
            near &= ~np.eye(len(a), dtype=bool)
        if near.any():
            node, label = link_labels(near, a, b)
            us.append(node[node != label])
            vs.append(label[node != label])
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def near_edges(fps: DataFrame, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    parts = parts or parts_for(fps.count())
    counts = sum((F.shiftleft(F.bit_count(F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))).cast("long"), 6 * b)
                  for b, m in enumerate(part_masks(parts))), F.lit(0).cast("long"))
    n = shuffle_partitions(fps.sparkSession)
    tiles = fps.select("fp", counts.alias("counts")).repartitionByRange(n, "counts", "fp").sortWithinPartitions("counts", "fp") \
        .transform(in_tasks(_tiles, "counts long, first long, fps binary", tile))
    tiles = cut_lineage(tiles)
    left = tiles.select("counts", "first", "fps", F.explode(F.array(*[F.lit(d).cast("long") for d in near_counts(parts, radius)])).alias("d"))
    left = left.select((F.col("counts") + F.col("d")).alias("counts"), "first", "fps", "d")
    right = tiles.select("counts", F.col("first").alias("first2"), F.col("fps").alias("fps2"))
    pairs = left.join(right, "counts").filter("d <> 0 or first <= first2").select("fps", "fps2")
    return pairs.transform(in_tasks(_compare, "u long, v long", radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """(doc_id, row, fp, component_id, kept): the smallest doc_id that a document reaches over links, and whether the document
    stands for its group (the smallest id, null last; of one id, the smallest ``row``; equal rows alike)."""
    d = cut_lineage(fingerprints(docs, id_col, text_col, width))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    low = d.groupBy("fp").agg(best.alias("low"))
    groups = components(near_edges(low.select("fp"), radius))
    linked = groups.join(low, groups["node"] == low["fp"]).select("fp", "component", "low")
    least = linked.groupBy("component").agg(F.min("low").alias("least"))
    linked = linked.join(least, "component").select("fp", "least")
    ids = low.join(linked, "fp", "left").select("fp", F.coalesce("least", "low").alias("least"))
    # a written table: both sides of the join are then shuffled, so that Spark can split a hot fingerprint's rows
    found = d.join(cut_lineage(ids), "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))
    return found.select("doc_id", "row", "fp", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS,
                            radius: int = RADIUS) -> DataFrame:
    """One document of each group, with all its columns."""
    keep_id, keep_row, row = free_names(docs, "_keep_id", "_keep_row", "_row")
    keep = near_duplicates(docs, id_col, text_col, width, radius).filter("kept").select(
        F.col("doc_id").alias(keep_id), F.col("row").alias(keep_row)).distinct()
    d = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col)))
    j = d.join(keep, (F.col(row) == F.col(keep_row)) & F.col(id_col).eqNullSafe(F.col(keep_id)))
    return j.dropDuplicates([row, keep_id]).select(*docs.columns)


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@register("op2_simhash_near_duplicates")
def op2_simhash_near_duplicates(spark, sf_dir):
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")
