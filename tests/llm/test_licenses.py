import math
import random
import re

import pytest

from ranklab.llm import licenses as lc
from ranklab.llm.words import code_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
COLS = "doc_id long, text string, labels string, score string, matches string"
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows):
    """The docstring's rules, word by word."""
    docs = [words_of(t) for _, t in rows]
    idf = {w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1)) for w in lc.vocabulary()}
    rarest = lambda ws: sorted(set(ws), key=lambda w: (-idf[w], w))
    seen = {w for d in docs for w in d}
    index = [set(rarest(set(t.split()) & seen)[:lc.RARE]) for _, t, _ in lc.NOTICES]
    known = {w for x in index for w in x} | {w for _, t in lc.BASE for w in t.split()}
    out = []
    for (i, _), d in zip(rows, docs):
        places, base, labels, score = [], set(), set(), 0.0
        for label, phrase in lc.BASE:
            p = phrase.split()
            at = [k for k in range(len(d)) if d[k:k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        up = {k for a in range(0, len(d), lc.STRETCH) for top in [rarest(w for w in d[a:a + lc.STRETCH] if w in known)[:lc.LOOKUPS]]
              for k in range(a, min(a + lc.STRETCH, len(d))) if d[k] in top}
        for (label, text, keys), rare in zip(lc.NOTICES, index):
            t = text.split()
            votes = {}
            for k in up:
                for q, w in enumerate(t):
                    if w == d[k] and w in rare:
                        votes[k - q] = votes.get(k - q, 0) + 1
            for diagonal, n in votes.items():
                if n < min(lc.AGREE, sum(w in rare for w in t)):
                    continue
                ok = True
                for key in keys:
                    p = key.split()
                    q = next(q for q in range(len(t)) if t[q:q + len(p)] == p)
                    ok &= any(k >= 0 and d[k:k + len(p)] == p for k in range(diagonal + q - lc.SLACK, diagonal + q + lc.SLACK + 1))
                if ok:
                    labels.add(label)
                    total = sum(idf[w] for w in t)
                    same = [0 <= diagonal + q < len(d) and d[diagonal + q] == w for q, w in enumerate(t)]
                    score = max(score, sum(idf[w] for q, w in enumerate(t) if same[q]) / total if total > 0 else sum(same) / len(t))
        score = max(score, lc.BASE_SCORE if base else 0)
        out.append(((i, len(d), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                     ",".join(sorted(base | labels))), score))
    return sorted(out, key=str)


def check(spark, rows):
    got = sorted(((tuple(r[c] for c in NAMES), r["score"]) for r in lc.scan(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], COLS)).collect()), key=str)
    want = plain(rows)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
    return {k[0]: k for k, _ in got}


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_rules_in_plain_python(spark, seed):
    r = random.Random(seed)
    vocab = [*lc.vocabulary(), *(f"w{k}" for k in range(200))]
    rows = [(0, None), (1, ""), (2, " .,;"), (None, "CC-BY cc by"), (3, "cc"), (4, "by cc by"), (5, "All rights, reserved. all RIGHTS reserved")]
    for k in range(120):
        parts = []
        for _ in range(r.randint(1, 6)):
            x = r.choices(vocab, k=r.randint(0, 60))
            if r.random() < 0.6:
                notice = r.choice(lc.NOTICES)[1].split()
                for _ in range(r.choice([0, 0, 1, 3])):
                    notice.insert(r.randrange(len(notice)), r.choice(vocab))
                if r.random() < 0.3:
                    notice = notice[r.randrange(len(notice)):]
                x += notice
            parts += x
        rows.append((10 + k, r.choice([" ", "\n", "-", ", "]).join(w.upper() if r.random() < 0.1 else w for w in parts)))
    rows += [rows[-1], rows[-1]]
    check(spark, rows)


def test_labels_of_real_notices(spark):
    rows = [(1, "x " * 500 + "Released under the MIT License. " + "y " * 100), (2, "Licensed under CC BY-NC 4.0."), (3, "All rights reserved."),
            (4, "Licensed under the Apache License, Version 2.0."), (5, "This work is licensed under the GNU General Public License, version 3."),
            (6, "The license of the MIT press, an apache of the public."), (7, "Permission is hereby granted, free of charge, to any person obtaining "
             "a copy of this program and its associated documentation files (the “Software”), to deal in the Software without restriction")]
    rows += [(100 + k, "plain prose about nothing at all, by the sea") for k in range(50)]
    got = check(spark, rows)
    assert [got[k][6] for k in range(1, 8)] == ["mit", "cc-by,cc-by-nc-4.0", "reserved", "apache-2.0", "gpl,gpl-3.0", "", "mit"]


def test_a_long_text_and_an_empty_table(spark):
    long = "word " * 300_000 + "released under the mit license " + "cc by " * 50_000
    got = {r["doc_id"]: r for r in lc.scan(spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string")).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (400_005, 50_000, 300_005, 400_003)
    assert got[1]["labels"] == "cc-by,mit"
    assert lc.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_word_codes_differ():
    assert len({code_of(w.encode()) for w in lc.vocabulary()}) == len(lc.vocabulary())
