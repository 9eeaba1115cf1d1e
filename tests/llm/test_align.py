import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ranklab.llm import align

COLS = "doc_id long, text string, row string, run string, radix string, n_a string"


@pytest.fixture(scope="module")
def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{align.TOKENIZERS}/{align.FILE_A}")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{align.TOKENIZERS}/{align.FILE_B}")


def plain(rows, encoders):
    a, b = encoders
    symbol = align.byte_symbols()
    docs, count = [], Counter()
    for i, text in rows:
        ta = a.encode(" " + text, add_special_tokens=False).ids if text else []
        tb = b.encode(text) if text else []
        ba = [bytes(symbol[c] for c in a.id_to_token(t)) for t in ta]
        bb = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in tb]
        if not text or not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            docs.append((i, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        links = [(y, x) for x, e, w in zip(ta, ea, ba) for y, f, v in zip(tb, eb, bb) if e - len(w) < f and f - len(v) < e]
        groups, x, y = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = ea.index(end) + 1, eb.index(end) + 1
            groups.append(f"{','.join(map(str, ta[x:p]))}|{','.join(map(str, tb[y:q]))}")
            x, y = p, q
        count.update(links)
        docs.append((i, ta, tb, groups, links))
    top = {}
    for (y, _), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return sorted(((i, len(ta), len(tb), len(g), len(links), sum(count[k] == top[k[0]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, ta, tb, g, links in docs), key=str)


WORDS = ["the", "The", "cat", "don't", "naïve", "日本語の文", "Привет,", "12345", "a\nb", "tab\tx", "<|endoftext|>", "<s>", "<0x0A>", "x" * 70, "é", "🙂", "　", " z"]
FIXED = [None, "", " ", "  two", "end ", "a  b", "▁", "a ▁b", "\n", "\n x", "x \n y", "ok", "ok", "\x00", "  a", "a  b", "q　 r", "\x1c y", "no\u0085 way"]


@pytest.mark.parametrize("seed, run_links, fan_in, most", [(0, 3_000_000, 48, 300_000), (1, 200, 3, 50), (2, 1, 2, 0)])
def test_equals_plain_alignment(spark, encoders, monkeypatch, seed, run_links, fan_in, most):
    r = random.Random(seed)
    monkeypatch.setattr(align, "UNITS", most)
    rows = [(i, t) for i, t in enumerate(FIXED)] + [(None, "null id"), (7, "ok"), (7, "ok")]
    rows += [(100 + k, r.choice(["", " "]).join(" ".join(r.choices(WORDS, k=5)) for _ in range(r.randint(1, 4)))) for k in range(30)]
    rows += [(900, " ".join(r.choices(WORDS[:6], k=3000)))] if seed else []
    d = spark.createDataFrame([(*x, "c", "c", "c", "c") for x in rows], COLS).repartition(5)
    got = align.alignment(d, run_links=run_links, fan_in=fan_in)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == plain(rows, encoders)


def test_a_hot_text_and_an_empty_table(spark, encoders):
    rows = [(i, "same words here") for i in range(300)] + [(1000, "same")]
    got = align.alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(20))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == plain(rows, encoders)
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_units_are_tokenized_alike_alone_and_in_the_text(encoders):
    a, b = encoders
    r = random.Random(5)
    for _ in range(300):
        text = r.choice(["", " ", "\n"]).join(r.choices([*WORDS, " ", "\n", "  ", ".", "▁"], k=12))
        if not text:
            continue
        units = align.units_of(text)
        assert " ".join(units) == text
        assert [i for u in units for i in a.encode(" " + u, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
        assert [i for u in units for i in b.encode(u)] == b.encode(text)


def test_heap_merge_adds_up_counts():
    r = np.random.default_rng(1)
    total, streams = Counter(), []
    for _ in range(7):
        keys = np.unique(r.integers(0, 500, 200))
        n = r.integers(1, 9, len(keys))
        total.update(dict(zip(keys.tolist(), n.tolist())))
        streams.append(align.read_blocks(align.blocks_of(keys, n, 16)))
    got = [(int(k), int(c)) for ks, cs in align.merged(streams) for k, c in zip(ks, cs)]
    assert got == sorted(total.items())


def test_packed_arrays_come_back():
    for a in ([], [0], [255, 0], [256], [1 << 20, 3], [1 << 40]):
        assert [x.tolist() for x in align.unpack(align.pack(np.array(a, np.int64), np.array([1, 2])))] == [a, [1, 2]]


def test_ranks_are_used_only_when_they_say_the_same(encoders):
    text, _ = align.read_tokenizers()
    t = align.ByteLevel(text)
    words = [" " + w for w in WORDS]
    assert t.encode(words) == [encoders[0].encode(w, add_special_tokens=False).ids for w in words]
