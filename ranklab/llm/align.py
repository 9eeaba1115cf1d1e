"""Operator 11: cross-tokenizer alignment by external spill counting.

Two public tokenizers, A and B, cut the same bytes (a space and the text). Where tokens of both end, the bytes fall into
groups; every pair of an A and a B token whose byte ranges overlap is a link. Each document is told how many of its links
are the most frequent of their B token over the whole corpus, and the sum of its links' counts.

1. Tasks tokenize. Both tokenizers treat text between *unit* bounds (a space after a character that is not white space) apart, so each
   distinct unit is tokenized once a task and looked up afterwards; memory for that is bounded by ``UNITS``. Every
   ``RUN_LINKS`` links, the pair-document records held are sorted by pair with the B token as the major side, radix-partitioned by
   the low bits of the B token, and written as one zstd run a radix partition: pairs with their counts in blocks, and the documents of each pair.
2. The pair counts of a radix partition's runs are merged by a k-way heap merge, ``FAN_IN`` runs at a time until one is left. Its
   order is B-major, so the maximum of each B token is known as its pairs stream by. What a partition
   holds of pairs is bounded by the two vocabularies, whatever the corpus.
3. Runs meet the pair table of their radix partition; every run streams through it and sends back, for the documents of the run, how many
   links are best and the sum of counts. A run meets its partition by a join, so a frequent token's runs are dealt to many tasks. Contributions
   return to the run, then to the documents.

The runs are written to the shared folder: a lost executor costs a read. No task holds more than a few runs.

Defined results: null and empty texts, and texts whose bytes a tokenizer does not give back (joined token bytes differ from
space + text), have no tokens and zeros; repeated rows count as often as they stand and get equal rows; an empty
table gives an empty result; only id and text are read, so other columns cannot clash. A very long text is split at
its units; a single unit is tokenized whole.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.llm.common import bounded_batches, in_tasks, register, table, written

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
RADIX_BITS = 7
RUN_LINKS = 3_000_000
FAN_IN = 48
BLOCK = 1 << 15               # pairs a block of a run
UNITS = 300_000               # distinct units a task remembers
TAKE, PIECE = 1 << 20, 100_000    # characters of texts looked up together, units of one text expanded together
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BOUND = re.compile("(?<=[^\\s▁]) (?=[^ ])")
_ODD = re.compile("[\\s▁] |^ | $")


# ------------------------------------------------------------------ packed arrays

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 up as one zstd frame, each in its narrowest type and byte planes."""
    import zstandard

    out = []
    for a in arrays:
        width = 1 if not len(a) or a.max() < 1 << 8 else 2 if a.max() < 1 << 16 else 4 if a.max() < 1 << 32 else 8
        planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
        out += [np.array([len(a), width], "<u8").tobytes(), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, width = (int(x) for x in np.frombuffer(data, "<u8", 2, at))
        planes = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64))
        at += 16 + n * width
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first as it is; ``cumsum`` undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def blocks_of(keys: np.ndarray, counts: np.ndarray, size: int = BLOCK) -> list[bytes]:
    return [pack(gaps(keys[i:i + size]), counts[i:i + size]) for i in range(0, len(keys), size)]


def read_blocks(blobs: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in blobs:
        k, n = unpack(b)
        yield np.cumsum(k), n


# ------------------------------------------------------------------ tokenizers

def byte_symbols() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself, or one from U+0100 up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A from the text of its JSON file: ids and the bytes of an id."""

    def __init__(self, text: str):
        j = json.loads(text)
        symbol, model = byte_symbols(), j["model"]
        self.bytes = [b""] * (1 + max(model["vocab"].values()))
        special = {t["content"] for t in j.get("added_tokens", [])}
        for piece, i in model["vocab"].items():
            self.bytes[i] = piece.encode() if piece in special else bytes(symbol[c] for c in piece)
        joined = [(m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)) for m in model["merges"]]
        base = len(model["vocab"]) - len(joined) - len(special & model["vocab"].keys())
        pre = j.get("pre_tokenizer") or {}
        ranked = base == 256 and not j.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) \
            and not pre.get("add_prefix_space") and all(model["vocab"].get(p) == base + k for k, p in enumerate(joined))
        if ranked:   # merges in the order of ids: ranks say the same, and are faster to apply
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes[:base + len(joined)])}
            one = tiktoken.Encoding("a", pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [one.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(text)
            t.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B from the bytes of its model file; it puts a space before the text by itself."""

    def __init__(self, proto: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(p.vocab_size())]
        self.encode = lambda texts: p.encode(texts, num_threads=1)
        #: no piece goes over a unit's bound
        self.by_unit = not any(re.search("[^▁]▁", p.id_to_piece(i)) for i in range(p.vocab_size()))


def read_tokenizers(folder: str = TOKENIZERS, file_a: str = FILE_A, file_b: str = FILE_B) -> tuple[str, bytes]:
    """The two files, read where the driver runs; they travel to the tasks with the code."""
    with open(f"{folder}/{file_a}", encoding="utf-8") as a, open(f"{folder}/{file_b}", "rb") as b:
        return a.read(), b.read()


def units_of(text: str) -> list[str]:
    """The text cut at spaces after a character that is not white space and before one that is not a space; those spaces go."""
    return text.split(" ") if not _ODD.search(text) else _BOUND.split(text)


class Units:
    """Remembered units: tokens, groups and links of each. ``links`` are pair codes with B as the major side, radix digits first."""

    def __init__(self, files: tuple[str, bytes], radix_bits: int, most: int | None = None):
        self.a, self.b = ByteLevel(files[0]), Pieces(files[1])
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.split = units_of if self.b.by_unit else (lambda text: [text])
        self.radix_bits, self.most = radix_bits, UNITS if most is None else most
        self.a_bits = int(len(self.len_a) - 1).bit_length()
        self.b_bits = max(int(len(self.len_b) - 1).bit_length(), radix_bits)
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.ok = np.empty(0, bool)
        self.sizes = np.empty((0, 4), np.int64)      # tokens of A, of B, groups, links
        self.first = np.empty(0, np.int64)
        self.links = np.empty(0, np.uint32 if self.a_bits + self.b_bits <= 32 else np.uint64)

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = b & ((1 << self.radix_bits) - 1), b >> self.radix_bits
        return (low << (self.a_bits + self.b_bits - self.radix_bits)) | (high << self.a_bits) | a

    def learn(self, units: Iterable[str]) -> None:
        if len(self.index) > self.most:
            self.clear()
        new = [u for u in units if u not in self.index]
        while new:
            part, size = [], 0
            while new and size < 1 << 20:
                part.append(new.pop())
                size += len(part[-1])
            self._learn(part)

    def _learn(self, new: list[str]) -> None:
        spaced = [" " + u for u in new]
        ids_a, ids_b = self.a.encode(spaced), self.b.encode(new)
        want = [u.encode("utf-8", "surrogatepass") for u in spaced]
        ok = np.array([b"".join([self.b.bytes[i] for i in b]) == w and b"".join([self.a.bytes[i] for i in a]) == w
                       for a, b, w in zip(ids_a, ids_b, want)], bool)
        good = np.flatnonzero(ok)
        n_a, n_b = (np.array([len(x[i]) for i in good], np.int64) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(x[i] for i in good), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        end = np.cumsum(np.array([len(want[i]) for i in good], np.int64))   # units end where tokens of both end
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        # between two neighbouring ends of either side lies one overlap, so one link
        cuts = np.union1d(end_a, end_b)
        links = self.code(flat_a[np.searchsorted(end_a, cuts)], flat_b[np.searchsorted(end_b, cuts)])
        n_groups = np.diff(np.searchsorted(both, end, "right"), prepend=0)
        n_links = np.diff(np.searchsorted(cuts, end, "right"), prepend=0)
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        to_a, to_b = np.searchsorted(end_a, both, "right").tolist(), np.searchsorted(end_b, both, "right").tolist()
        groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        texts = [b""] * len(new)
        at = 0
        for i, n in zip(good.tolist(), n_groups.tolist()):
            texts[i] = ";".join(groups[at:at + n]).encode()
            at += n
        sizes = np.zeros((len(new), 4), np.int64)
        sizes[good] = np.stack([n_a, n_b, n_groups, n_links], 1)
        base = len(self.index)
        self.index.update(zip(new, range(base, base + len(new))))
        self.groups += texts
        self.ok, self.sizes = np.concatenate((self.ok, ok)), np.concatenate((self.sizes, sizes))
        self.first = np.concatenate((self.first, len(self.links) + np.cumsum(sizes[:, 3]) - sizes[:, 3]))
        self.links = np.concatenate((self.links, links.astype(self.links.dtype)))

    def links_of(self, units: np.ndarray) -> np.ndarray:
        n = self.sizes[units, 3]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[units], n)
        return self.links[at]


# ------------------------------------------------------------------ runs

def _spill(files, radix_bits: int, run_links: int):
    """Task: rows of documents (``radix`` null) and rows of runs."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "run", "radix", "pairs", "docs"]

    def run(batches):
        from pyspark import TaskContext

        units = Units(files, radix_bits)
        row = TaskContext.get().partitionId() << 36
        held, held_rows, size = [], [], 0            # pair codes and rows of the run to be
        high = units.a_bits + units.b_bits - radix_bits

        def spilled():
            nonlocal held, held_rows, size
            base = held_rows[0][0]
            code = np.concatenate(held).astype(np.int64)
            local = np.repeat(*(np.array(x) for x in zip(*held_rows))) - base
            bits = max(1, int(local.max()).bit_length())
            key, n = np.unique((code << bits) | local, return_counts=True)
            code, local = key >> bits, key & ((1 << bits) - 1)
            held, held_rows, size = [], [], 0
            out = []
            cuts = np.searchsorted(code, np.arange((1 << radix_bits) + 1) << high)
            for radix in np.flatnonzero(np.diff(cuts)).tolist():
                s = slice(cuts[radix], cuts[radix + 1])
                c, d, k = code[s], local[s], n[s]
                at = np.flatnonzero(np.diff(c, prepend=-1))
                width = np.diff(at, append=len(c))
                step = np.diff(d, prepend=0)
                step[at] = d[at]
                out.append((radix, blocks_of(c[at], np.add.reduceat(k, at)), pack(width, step, k)))
            none = pa.nulls(len(out), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([base] * len(out), pa.int64()), none.cast(id_type), none, none, none, none, pa.nulls(len(out), pa.string()), pa.array([run_id] * len(out), pa.int64()),
                 pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.binary())), pa.array([x[2] for x in out], pa.binary())], names)

        run_id, id_type = row, None
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            id_type = ids.type
            docs = []
            while texts:                                     # about TAKE characters of texts at a time
                n, chars = 0, 0
                while n < len(texts) and chars < TAKE:
                    chars += len(texts[n] or "")
                    n += 1
                parts = [units.split(t) if t else [] for t in texts[:n]]
                texts = texts[n:]
                units.learn({u for p in parts for u in p})
                for words in parts:
                    found = np.array([units.index[u] for u in words], np.int64)
                    if not len(found) or not units.ok[found].all():
                        docs.append((row, 0, 0, 0, 0, ""))
                        row += 1
                        continue
                    h = hashlib.sha256()
                    for i in range(0, len(found), PIECE):    # a long text may span runs
                        piece = found[i:i + PIECE]
                        h.update((b";" if i else b"") + b";".join([units.groups[u] for u in piece.tolist()]))
                        got = units.links_of(piece)
                        held.append(got)
                        held_rows.append((row, len(got)))
                        size += len(got)
                        if size >= run_links:
                            yield spilled()
                            run_id += 1
                    docs.append((row, *units.sizes[found].sum(0).tolist(), h.hexdigest()))
                    row += 1
            c = list(zip(*docs))
            none = pa.nulls(len(docs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), ids, *[pa.array(x, pa.int64()) for x in c[1:5]], pa.array(c[5], pa.string()), none,
                                              none.cast(pa.int32()), pa.nulls(len(docs), pa.list_(pa.binary())), pa.nulls(len(docs), pa.binary())], names)
        if held:
            yield spilled()
    return run


# ------------------------------------------------------------------ counting

def merged(streams: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way heap merge of ascending (keys, counts) streams: keys in order, counts added up.

    The heap holds the last key of each stream's block; up to the least of them, the blocks held know every
    key, so that much goes out at once.
    """
    heap, held = [], {}
    for i, s in enumerate(streams):
        if (block := next(s, None)) is not None:
            held[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))
    while heap:
        top = heap[0][0]
        keys, counts = [], []
        for i, (k, n) in held.items():
            cut = int(np.searchsorted(k, top, "right"))
            if cut:
                keys.append(k[:cut])
                counts.append(n[:cut])
                held[i] = (k[cut:], n[cut:])
        while heap and heap[0][0] == top:
            _, i = heapq.heappop(heap)
            if (block := next(streams[i], None)) is not None:
                held[i] = block
                heapq.heappush(heap, (int(block[0][-1]), i))
            else:
                del held[i]
        k, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        at = np.flatnonzero(np.diff(k, prepend=-1))
        yield k[at], np.add.reduceat(n, at)


def _merge_runs(group):
    """The runs of one radix partition and lot as one run."""
    out = []
    for k, n in merged([read_blocks(x.as_py() for x in blobs) for blobs in group.column("pairs")]):
        out += blocks_of(k, n)
    return pa.table({"radix": group.column("radix")[:1].combine_chunks(), "run": pa.array([group.column("run")[0].as_py()], pa.int64()),
                     "pairs": pa.array([out], pa.list_(pa.binary()))})


def _pair_table(batch, a_bits: int):
    """A merged run as (keys, counts, best): best where the count is the highest of its B token, known when its pairs have streamed by."""
    out = []
    for blobs in batch.column("pairs"):
        parts, k0, n0 = [], np.empty(0, np.int64), np.empty(0, np.int64)
        for k, n in itertools.chain(read_blocks(x.as_py() for x in blobs), [(None, None)]):
            if k is not None:
                k0, n0 = np.concatenate((k0, k)), np.concatenate((n0, n))
            side = k0 >> a_bits
            done = len(k0) if k is None else int(np.searchsorted(side, side[-1]))   # the last B token may go on in the next block
            if done:
                at = np.flatnonzero(np.diff(side[:done], prepend=-1))
                top = np.maximum.reduceat(n0[:done], at)
                best = n0[:done] == np.repeat(top, np.diff(at, append=done))
                parts.append(pack(gaps(k0[:done]), n0[:done], best.astype(np.uint8)))
                k0, n0 = k0[done:], n0[done:]
        out.append(parts)
    yield pa.RecordBatch.from_arrays([batch.column("radix"), pa.array(out, pa.list_(pa.binary()))], ["radix", "table"])


def pair_table(runs: DataFrame, a_bits: int, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, table) from (radix, run, pairs): one row a radix partition, bounded by the vocabularies."""
    n = runs.select("run").distinct().count()
    while n > 1:
        lots = max(1, -(-n // fan_in))
        by_lot = runs.select("radix", "pairs", F.pmod(F.xxhash64("run"), F.lit(lots)).alias("run"))
        runs = written(by_lot.groupBy("radix", "run").applyInArrow(_merge_runs, "radix int, run long, pairs array<binary>"), "merged-runs")
        n = lots
    return written(runs.transform(in_tasks(_pair_table, "radix int, table array<binary>", a_bits)), "pair-table")


# ------------------------------------------------------------------ contributions

def _contributions(batches):
    """Of each run of a radix partition: for the rows it names, how many links are best and the sum of counts."""
    radix, keys, counts, best = None, None, None, None
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            if batch.column("radix")[i].as_py() != radix:
                radix = batch.column("radix")[i].as_py()
                t = [unpack(x.as_py()) for x in batch.column("table")[i]]
                keys, counts, best = np.concatenate([np.cumsum(x[0]) for x in t]), np.concatenate([x[1] for x in t]), np.concatenate([x[2] for x in t])
            mine = np.concatenate([k for k, _ in read_blocks(x.as_py() for x in batch.column("pairs")[i])])
            width, step, n = unpack(batch.column("docs")[i].as_py())
            at = np.searchsorted(keys, mine)
            # rows ascend within a pair; the running sum starts anew at each pair
            start = np.cumsum(width) - width
            total = np.cumsum(step)
            local = total - np.repeat(total[start] - step[start], width)
            sums = np.zeros((2, int(local.max()) + 1), np.int64)
            np.add.at(sums[0], local, np.repeat(best[at], width) * n)
            np.add.at(sums[1], local, np.repeat(counts[at], width) * n)
            some = np.flatnonzero(sums[1])
            out.append(pack(gaps(some), sums[0][some], sums[1][some]))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("row"), pa.array(out, pa.binary())], ["run", "row", "sums"])


def _returned(group):
    """All contributions to a run's rows, added up."""
    parts = [unpack(x.as_py()) for x in group.column("sums")]
    local = [np.cumsum(p[0]) for p in parts]
    sums = np.zeros((2, max(int(x[-1]) for x in local) + 1), np.int64)
    for at, (_, best, count) in zip(local, parts):
        sums[0][at] += best
        sums[1][at] += count
    some = np.flatnonzero(sums[1])
    return pa.table({"row": pa.array(some + group.column("row")[0].as_py(), pa.int64()), "n_best": sums[0][some], "count_sum": sums[1][some]})


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, file_a: str = FILE_A, file_b: str = FILE_B,
              radix_bits: int = RADIX_BITS, run_links: int = RUN_LINKS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    files = read_tokenizers(folder, file_a, file_b)
    a_bits = (len(ByteLevel(files[0]).bytes) - 1).bit_length()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    spilled = written(d.mapInArrow(_spill(files, radix_bits, run_links), f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                   "groups_sha256 string, run long, radix int, pairs array<binary>, docs binary"), "runs")
    runs = spilled.filter("radix is not null")
    pairs = pair_table(runs.select("radix", "run", "pairs"), a_bits, fan_in)
    sent = runs.select("radix", "run", "row", "pairs", "docs").join(pairs, "radix").mapInArrow(
        _contributions, "run long, row long, sums binary")
    back = sent.groupBy("run").applyInArrow(_returned, "row long, n_best long, count_sum long")
    back = back.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = spilled.filter("radix is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.join(back, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                                                 F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


@register("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"))
