"""Operator 12: licence scans with a positional rare-token index.

Licence notices are templates with mandatory key phrases. One pass over the corpus counts in how many documents each
licence word stands; each template is then indexed by its ``RARE`` words of highest IDF (of those that occur), with their positions. A second
pass scans the files, with the index in hand:

1. Of every ``STRETCH`` words of a file, the ``LOOKUPS`` indexed words of highest IDF are looked up.
2. Their postings are intersected by relative position: a posting at template position q of a word at file
   position p votes for the diagonal p - q. ``AGREE`` votes make a candidate.
3. A candidate stands if every mandatory key phrase of its template is found, word for word, within ``SLACK`` words of where the
   template has it. Its coverage is the share of the template's IDF whose words stand at their places.

The base phrases are templates whose words are all indexed, all looked up everywhere and all have to agree, so their places
are found exactly. A license that is present so often that its words lose their IDF is still found: ranks, not thresholds, choose the words.

The index and the word statistics are bounded by the templates, so both passes are maps over the texts; only counts of licence words are shuffled.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows get equal rows; equal IDF is ordered by
word; a template at a text's edge matches with the words that are there; an empty table gives an empty
result; only id and text are read, so other columns cannot clash. ``score`` is the highest coverage of a label found, and
``BASE_SCORE`` at least where a base phrase stands.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.llm.common import bounded_batches, in_tasks, register, table
from ranklab.llm.words import code_of, slices

RARE = 6
STRETCH = 64
LOOKUPS = 6
AGREE = 2
SLACK = 8
BASE_SCORE = 0.5

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: (label, notice, mandatory key phrases); a label may have several notices
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
            "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
            "sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
                   "obtain a copy of the license at", ("apache license version 2 0", "except in compliance with the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
            "are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                     "from this software without specific prior written permission", ("endorse or promote products", "prior written permission")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
                "by the free software foundation either version 3 of the license or at your option any later version",
     ("gnu general public license", "either version 3 of the license")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
                "by the free software foundation either version 2 of the license or at your option any later version",
     ("gnu general public license", "either version 2 of the license")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "with or without fee is hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
     ("waived all copyright and related or neighboring rights",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution noncommercial 4 0",)),
)


@dataclass
class Index:
    """The positional index: words by code, their IDF rank, and postings (template, position) of the indexed ones."""
    labels: list[str]
    base: np.ndarray          # template is a base phrase
    words: list[np.ndarray]   # word numbers of each template
    phrases: list[list]       # (place in the template, word numbers) of each template's key phrases
    codes: np.ndarray         # sorted word codes
    idf: np.ndarray
    rank: np.ndarray          # 0: highest IDF
    always: np.ndarray        # looked up wherever it stands
    first: np.ndarray         # postings of word w: first[w] .. first[w + 1]
    template: np.ndarray
    place: np.ndarray
    need: np.ndarray          # votes that a template needs


def vocabulary(notices=NOTICES, base=BASE) -> list[str]:
    return sorted({w for _, text, *_ in (*notices, *base) for w in text.split()})


def document_frequency(texts: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """(number of rows, rows with each of the words): counted in tasks, summed by word."""
    codes = np.array([code_of(w.encode()) for w in words], np.uint64)
    order = np.argsort(codes)
    codes = codes[order]

    def run(batches):
        total, rows = np.zeros(len(codes), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for s in slices(batch.column("text"), lower=True, space=_SEPARATOR):
                c = s.codes()
                at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
                hit = np.flatnonzero(codes[at] == c)
                seen = np.unique(s.row_of_word()[hit] * len(codes) + at[hit])
                total += np.bincount(seen % len(codes), minlength=len(codes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *order[some].tolist()], pa.int32()), pa.array([rows, *total[some].tolist()], pa.int64())], ["word", "n"])

    bounded_batches(texts.sparkSession)
    # one row a licence word: bounded by the templates
    found = {r["word"]: r["n"] for r in texts.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), {w: found.get(i, 0) for i, w in enumerate(words)}


def build_index(n_docs: int, freq: dict[str, int], notices=NOTICES, base=BASE, rare: int = RARE, agree: int = AGREE) -> Index:
    vocab = sorted(freq, key=lambda w: code_of(w.encode()))
    number = {w: i for i, w in enumerate(vocab)}
    idf = np.array([np.log((n_docs + 1) / (freq[w] + 1)) for w in vocab])
    by_idf = sorted(range(len(vocab)), key=lambda i: (-idf[i], vocab[i]))
    rank = np.empty(len(vocab), np.int64)
    rank[by_idf] = np.arange(len(vocab))
    templates = [(label, text.split(), [p.split() for p in phrases]) for label, text, phrases in notices] + [(label, text.split(), []) for label, text in base]
    is_base = np.arange(len(templates)) >= len(notices)
    postings, need, always, phrases = [], [], np.zeros(len(vocab), bool), []
    for t, (_, words, keys) in enumerate(templates):
        nums = [number[w] for w in words]
        chosen = set(nums) if is_base[t] else set(sorted({i for i in nums if freq[vocab[i]]}, key=lambda i: rank[i])[:rare])
        mine = [(w, t, q) for q, w in enumerate(nums) if w in chosen]
        postings += mine
        need.append(len(words) if is_base[t] else min(agree, len(mine)))
        if is_base[t]:
            always[nums] = True
        places = [next(q for q in range(len(words)) if words[q:q + len(k)] == k) for k in keys]
        phrases.append([(q, np.array([number[w] for w in k])) for q, k in zip(places, keys)])
    postings.sort()
    w, t, q = (np.array(x, np.int64) for x in zip(*postings))
    return Index([x for x, *_ in templates], is_base, [np.array([number[x] for x in words]) for _, words, _ in templates], phrases,
                 np.array([code_of(x.encode()) for x in vocab], np.uint64), idf, rank, always,
                 np.searchsorted(w, np.arange(len(vocab) + 1)), t, q, np.array(need))


def _votes(ix: Index, word, row, pos, stretch: int, lookups: int):
    """(template, row, diagonal) candidates of one slice: ``word`` is -1 where no licence word stands."""
    indexed = np.append(np.diff(ix.first) > 0, False)
    at = np.flatnonzero(indexed[word])
    n_words = len(ix.codes)
    part = np.cumsum(np.concatenate(([True], (np.diff(row[at]) != 0) | (np.diff(pos[at] // stretch) != 0)))[:len(at)])
    key = part * n_words + ix.rank[word[at]]
    seen = np.unique(key)
    begins = np.concatenate(([True], np.diff(seen // n_words) != 0))[:len(seen)]
    nth = np.arange(len(seen)) - np.maximum.accumulate(np.where(begins, np.arange(len(seen)), 0)) if len(seen) else seen
    highest = nth[np.searchsorted(seen, key)] < lookups if len(seen) else np.zeros(0, bool)
    found = []
    for chosen, base in ((highest, False), (ix.always[word[at]], True)):
        g = at[chosen]
        n = np.diff(ix.first)[word[g]]
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ix.first[word[g]], n)
        g = np.repeat(g, n)
        own = ix.base[ix.template[p]] == base
        g, p = g[own], p[own]
        found.append((ix.template[p], row[g], pos[g] - ix.place[p]))
    t, r, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((d, t, r))
    t, r, d = t[order], r[order], d[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(t) != 0) | (np.diff(r) != 0) | (np.diff(d) != 0)))[:len(t)])
    votes = np.diff(np.append(new, len(t)))
    keep = new[votes >= ix.need[t[new]]] if len(new) else new
    return t[keep], r[keep], d[keep]


def _verified(ix: Index, words: np.ndarray, t: int, d: int, slack: int) -> float | None:
    """Coverage of template ``t`` at diagonal ``d`` of a file's word numbers, or None if a key phrase is missing."""
    for place, phrase in ix.phrases[t]:
        lo, hi = max(0, d + place - slack), d + place + slack + len(phrase)
        near = words[lo:max(hi, 0)]
        if len(near) < len(phrase) or not (np.lib.stride_tricks.sliding_window_view(near, len(phrase)) == phrase).all(1).any():
            return None
    mine = ix.words[t]
    lo, hi = max(0, -d), min(len(mine), len(words) - d)
    same = words[d + lo:d + hi] == mine[lo:hi]
    total = ix.idf[mine].sum()
    return float(ix.idf[mine[lo:hi]][same].sum() / total) if total > 0 else float(same.sum() / len(mine))


def _scan(batch, ix: Index, stretch: int, lookups: int, slack: int):
    out = []
    for s in slices(batch.column("text"), lower=True, space=_SEPARATOR):
        codes, row = s.codes(), s.row_of_word()
        at = np.minimum(np.searchsorted(ix.codes, codes), len(ix.codes) - 1)
        word = np.where(ix.codes[at] == codes, at, -1)
        pos = np.arange(len(codes)) - s.first[row]
        found: dict[int, list] = {}
        for t, r, d in zip(*(x.tolist() for x in _votes(ix, word, row, pos, stretch, lookups))):
            found.setdefault(r, []).append((t, d))
        for r, n in enumerate(s.n_words.tolist()):
            places, base, labels, matches, score = [], set(), set(), [], 0.0
            for t, d in found.get(r, ()):
                if ix.base[t]:
                    places.append(d)
                    base.add(ix.labels[t])
                    cover = None
                    score = max(score, BASE_SCORE)
                else:
                    cover = _verified(ix, word[s.first[r]:s.first[r + 1]], t, d, slack)
                    if cover is None:
                        continue
                    score = max(score, cover)
                labels.add(ix.labels[t])
                matches.append({"label": ix.labels[t], "at": d, "coverage": cover})
            out.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
                        min(1.0, score), matches))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64()), ("coverage", pa.float64())]))]
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(zip(*out), kinds)]],
                                     ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, base=BASE, rare: int = RARE, stretch: int = STRETCH,
         lookups: int = LOOKUPS, agree: int = AGREE, slack: int = SLACK) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, at = where the notice would
    begin, coverage; no coverage for a base phrase)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ix = build_index(*document_frequency(d, vocabulary(notices, base)), notices, base, rare, agree)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.transform(in_tasks(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                "score double, matches array<struct<label:string,at:long,coverage:double>>", ix, stretch, lookups, slack))


@register("op12_license_scan")
def op12_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("matches")
