import random

import numpy as np
import pyarrow as pa
import pytest

from ranklab.llm import common
from ranklab.llm.words import Rolling, code_of, slices, sliding_min

TEXTS = ["héllo  wörld a\tb", "", None, " x ", " q nbsp word", "\x0b\x0c\r\nend", "a" * 900, "one two three four"]


@pytest.mark.parametrize("limit", [1, 7, 40, 1 << 18])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary()])
def test_slices_split_like_bytes_split(limit, kind):
    column = pa.array([t if t is None or kind != pa.binary() else t.encode() for t in TEXTS], kind)
    for col, texts in ((column, TEXTS), (column.slice(2, 5), TEXTS[2:7]), (column.slice(8), [])):
        got = []
        for s in slices(col, limit=limit):
            assert len(s.n_words) == s.hi - s.lo and s.lo == len(got)
            words = [s.buf[a:b].tobytes() for a, b in zip(s.starts, s.ends)]
            assert [int(c) for c in s.codes()] == [code_of(w) for w in words]
            got += [words[a:b] for a, b in zip(s.first, s.first[1:])]
            assert [s.text(i) for i in range(s.hi - s.lo)] == [(t or "").encode() for t in texts[s.lo:s.hi]]
        assert got == [(t or "").encode().split() for t in texts]


def test_lower_only_touches_a_to_z():
    s = next(slices(pa.array(["ÀB É zZ"]), lower=True))
    assert s.buf.tobytes() == "Àb É zz".encode()
    assert list(slices(pa.array([], pa.string()))) == []
    assert [s.n_words.tolist() for s in slices(pa.nulls(3))] == [[0, 0, 0]]


def test_rolling_hashes_tell_windows_apart():
    r = random.Random(3)
    v = np.array([r.choice([5, 9, 1 << 63]) for _ in range(400)], np.uint64)
    for width in (1, 2, 17, 400, 401):
        h = Rolling(0xD1342543DE82EF95).windows(v, width)
        runs = [tuple(v[i:i + width]) for i in range(len(v) - width + 1)]
        assert len(h) == len(runs) and len(set(zip(h.tolist(), runs))) == len(set(runs)) == len(set(h.tolist()))


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 35])
def test_sliding_min(width):
    x = np.random.default_rng(1).integers(0, 1000, 60)
    assert sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(61 - width)]
    assert len(sliding_min(x[:width - 1], width)) == 0


def _closure(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(-50, 400), r.randint(-50, 400)) for _ in range(250)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)] + edges[:9] + [(7, 7)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = _closure([e for e in edges if e[0] != e[1]])
    assert got == want
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_link_labels_reach_over_a_block():
    linked = np.zeros((4, 5), bool)
    linked[0, 0] = linked[1, 0] = linked[1, 2] = linked[3, 4] = True
    node, label = common.link_labels(linked, np.array([10, 11, 12, 13]), np.array([20, 21, 22, 23, 5]))
    assert dict(zip(node.tolist(), label.tolist())) == {10: 10, 11: 10, 20: 10, 22: 10, 13: 5, 5: 5}
