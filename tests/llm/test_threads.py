import random
import re

import pytest

from ranklab.llm import threads as th

CONV = [
    (1, 0, "user", "Hello there everyone\nHow does the engine start today?"),
    (1, 1, "assistant", "A second topic without any relation"),
    (1, 2, "user", "On Monday, X wrote:\n> How does the engine   START today?\nTurn the key slowly.\n\nThen wait."),
    (1, 3, "assistant", "> A second topic without any relation\nI agree on the topic."),
    (1, 4, "user", "> > How does the engine start today?\n> Turn the key slowly.\n>\n> Then wait.\nThat worked for me."),
    (1, 5, "user", "> nobody ever said this at all\nAn answer to nothing."),
    (2, 0, "user", "Turn the key slowly."),
    (2, None, "user", None),
    (None, 3, None, "> Turn the key slowly.\nx"),
    (2, 0, "user", "Turn the key slowly."),
]


def got(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {(r["conv_id"], r["position"]): r for r in th.reply_ordered(df).collect()}


def test_threads(spark):
    g = got(spark, CONV)
    assert len(g) == len(CONV)
    one = [g[1, i] for i in range(1, 7)]
    assert [r["turn"] for r in one] == [0, 2, 4, 1, 3, 5]
    assert [r["parent_turn"] for r in one] == [None, 0, 2, None, 1, None]
    assert [r["root_turn"] for r in one] == [0, 0, 0, 1, 1, 5]
    assert one[1]["text"] == "Turn the key slowly.\n\nThen wait."
    assert one[2]["text"] == "That worked for me." and one[2]["n_linked"] == 2
    assert one[5]["n_quotes"] == 1 and one[5]["n_linked"] == 0
    assert [g[2, i]["turn"] for i in (1, 2, 3)] == [None, 0, 0]
    assert g[None, 1]["parent_turn"] is None       # other conversations are not linked


def test_frequent_line_takes_the_latest_earlier_message(spark):
    rows = [(1, t, "user", "the very same line" if t % 2 == 0 else "> the very same line\nanswer %d" % t) for t in range(60)]
    g = got(spark, rows)
    assert {r["turn"]: r["parent_turn"] for r in g.values() if r["turn"] % 2} == {t: t - 1 for t in range(1, 60, 2)}


def test_long_reply_chain_and_empty(spark):
    rows = [(1, t, "user", ("> unique text number %d here\n" % (t - 1) if t else "") + "unique text number %d here" % t) for t in range(40)]
    g = got(spark, rows)
    assert {r["root_turn"] for r in g.values()} == {0} and [g[1, i + 1]["turn"] for i in range(40)] == list(range(40))
    assert got(spark, []) == {}


def _level(line):
    m = re.match(r"^((?:[ \t]{0,3}>)*)", line)
    return m[1].count(">"), line[m.end():]


def _norm(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def brute(rows):
    """(conv, turn) -> (parent turn, position, linked passages), unique turns in each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        msgs = sorted((r[1], r[3]) for r in rows if r[0] == conv)
        own, parent, linked = {}, {}, {}
        for turn, text in msgs:
            lines = [_level(x) for x in re.split(r"\r?\n", text)]
            mine = [x for i, (lv, x) in enumerate(lines) if lv == 0 and not (
                re.search(th.ATTRIBUTION, x) and i + 1 < len(lines) and lines[i + 1][0] > 0)]
            passages, last = [], None
            for lv, x in lines:
                if lv != last:
                    passages.append((lv, []))
                passages[-1][1].append(x)
                last = lv
            votes, n = {}, 0
            for lv, part in passages:
                if lv == 0:
                    continue
                units = ([" ".join(part)] if len(part) > 1 else []) + part
                found = {}
                for u in {_norm(u) for u in units if len(_norm(u)) >= th.MIN_CHARS}:
                    hits = [t for t in own if t < turn and u in own[t]]
                    if hits:
                        found[max(hits)] = max(found.get(max(hits), 0), len(u))
                n += bool(found)
                if lv == 1:
                    for t, c in found.items():
                        votes[t] = votes.get(t, 0) + c
            linked[turn] = n
            if votes:
                parent[turn] = max(votes, key=lambda t: (votes[t], t))
            whole = "\n".join(mine)
            own[turn] = {_norm(u) for u in [whole, *re.split(r"\n\s*\n", whole), *mine] if len(_norm(u)) >= th.MIN_CHARS}

        def root(t):
            while t in parent:
                t = parent[t]
            return t
        order = sorted((root(t), t) for t, _ in msgs)
        for t, _ in msgs:
            out[conv, t] = (parent.get(t), order.index((root(t), t)) + 1, linked[t])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [f"Sentence number {i} about {w}." for i, w in enumerate("rain snow wind sun fog hail storm heat".split())] + ["short", ""]
    rows = []
    for conv in range(4):
        texts = []
        for turn in range(25):
            parts = []
            if texts and r.random() < .7:
                for _ in range(r.randint(1, 2)):
                    quoted = r.choice(texts).split("\n")
                    a = r.randrange(len(quoted))
                    mark = r.choice(["> ", ">", " > "])
                    if r.random() < .3:
                        parts.append("Anna wrote:")
                    parts += [mark + x.upper() if r.random() < .2 else mark + x for x in quoted[a:a + r.randint(1, 4)]]
                    parts += [r.choice(pool)] * r.randint(0, 1)
            parts += r.choices(pool, k=r.randint(0, 3))
            texts.append("\n".join(parts))
            rows.append((conv, turn, r.choice(["user", "assistant"]), texts[-1]))
    g = {(c, x["turn"]): (x["parent_turn"], p, x["n_linked"]) for (c, p), x in got(spark, rows).items()}
    assert g == brute(rows)


SHORT = ["Yes.", "Why?", "No", "k", "Ok thanks", "好的。", "为什么？", "はい", "A longer line that is quoted.", "", "  "]


def test_short_messages_are_linked(spark):
    rows = [(1, 0, "user", "Yes."), (1, 1, "assistant", "好的。"), (1, 2, "user", "> Yes.\nWhy?"), (1, 3, "assistant", "> 好的。\nk"),
            (1, 4, "user", "> > Yes.\n> WHY?\nno"), (1, 5, "assistant", ">\n> \nempty quote"), (1, 6, "user", "> k\n\n> A longer line\nx"),
            (1, 7, "assistant", "A longer line"), (1, 8, "user", "> k\n> A longer line\ny")]
    g = {r["turn"]: r for r in got(spark, rows).values()}
    assert [g[t]["parent_turn"] for t in range(9)] == [None, None, 0, 1, 2, None, 3, None, 7]
    assert [g[t]["root_turn"] for t in range(9)] == [0, 1, 0, 1, 0, 5, 1, 7, 7]
    assert [g[t]["n_linked"] for t in range(9)] == [0, 0, 1, 1, 2, 0, 1, 0, 1]
    assert [g[t]["position"] for t in (0, 2, 4, 1, 3, 6, 5, 7, 8)] == list(range(1, 10))


@pytest.mark.parametrize("seed", range(2))
def test_short_messages_equal_brute_force_without_threshold(spark, monkeypatch, seed):
    r = random.Random(seed)
    rows = []
    for conv in range(3):
        texts = []
        for turn in range(20):
            quoted = [f"{r.choice(['>', '> ', '> > '])}{x}" for x in r.choice(texts).split("\n")[:2]] if texts and r.random() < .8 else []
            texts.append("\n".join(quoted + r.choices(SHORT, k=r.randint(0, 2))))
            rows.append((conv, turn, "user", texts[-1]))
    g = {(c, x["turn"]): (x["parent_turn"], p, x["n_linked"]) for (c, p), x in got(spark, rows).items()}
    monkeypatch.setattr(th, "MIN_CHARS", 1)         # no threshold but the empty text
    assert g == brute(rows)
