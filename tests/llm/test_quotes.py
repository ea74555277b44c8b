"""Quotation linking against a version with dictionaries."""

import random

import pytest

from coppice.llm import quotes


def plain(rows):
    """thread, depth, parent of every (conv, turn), with one row each."""
    said = {}
    for conv, turn, _, text in sorted(rows):
        _, _, mine = quotes.passages(text)
        for x in [*mine, *(y for m in mine for y in m.split("\n")), "\n".join(mine)]:
            if h := quotes.normal_hash(x):
                said.setdefault(h, []).append((conv, turn))
    parent, linked = {}, {}
    for conv, turn, _, text in rows:
        best = None
        for level, passage in quotes.passages(text)[1]:
            found = said.get(quotes.normal_hash(passage), [])
            to = next((x for x in found if x[0] == conv and x < (conv, turn)), None)
            to = to or (found[0] if found and found[0] < (conv, turn) else None)
            if to:
                best = min(best or (99,), (level, -to[1], to))
        earlier = [t for c, t, _, _ in rows if c == conv and t < turn]
        linked[conv, turn] = best is not None
        parent[conv, turn] = best[2] if best else (conv, max(earlier)) if earlier else None
    out = {}
    for node in parent:
        top, depth = node, 0
        while parent[top]:
            top, depth = parent[top], depth + 1
        out[node] = (*top, depth, parent[node], linked[node])
    return out


def messages(seed):
    r = random.Random(seed)
    rows, said = [], ["Hello there, friend."]
    for conv in range(12):
        for turn in range(r.randint(1, 9)):
            own = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 30)) for _ in range(r.randint(1, 8)))
            text = own
            if r.random() < 0.5:
                q = r.choice(said)
                text = "On Monday, A wrote:\n> " + q.upper().replace(" ", "  ") + "\n>> " + r.choice(said) + "\n\n" + own
            rows.append((conv, 2 * turn, "user", text if r.random() < 0.9 else None))
            said.append(own)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_plain(spark, seed):
    rows = messages(seed)
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    expected = plain(rows)
    assert len(got) == len(rows)
    assert any(x[4] for x in expected.values())
    for node, (conv, turn, depth, parent, linked) in expected.items():
        r = got[node]
        assert (r["thread_conv"], r["thread_turn"], r["depth"], r["linked"]) == (conv, turn, depth, linked), node
        assert (r["parent_conv"], r["parent_turn"]) == (parent or (None, None))
        assert "> " not in r["text"] and "wrote:" not in r["text"]


def test_parsing():
    own, quoted, mine = quotes.passages("Am 3. Mai schrieb Eva:\n> a\n> b\n>> c\n\nanswer\nmore\n\nlast")
    assert own == "answer\nmore\n\nlast"
    assert quoted == [(1, "a\nb"), (2, "c")]
    assert mine == ["answer\nmore", "last"]
    assert quotes.passages(None) == ("", [], [])
    assert quotes.normal_hash("A,\n b!") == quotes.normal_hash("a b")
    assert quotes.normal_hash(" -- ") is None


def test_nulls_repeats_and_no_rows(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, None, None), (None, 3, "user", "> x\ny"), (2, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r)[:3] + (r["text"], r["parent_turn"]) for r in quotes.link_quotes(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 0, "x", None), (1, 0, 0, "x", None), (1, 0, 1, "", 0), (None, 3, 0, "y", None),
                                            (2, None, 0, "z", None)], key=repr)
    assert quotes.link_quotes(df.where("false")).count() == 0


def test_conversation_over_many_pieces(spark):
    df = spark.range(500).selectExpr("1L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text")
    got = quotes.link_quotes(df).select("turn", "depth", "thread_turn", "parent_turn").collect()
    assert all(r["depth"] == r["turn"] and r["thread_turn"] == 0 for r in got)
    assert all(r["parent_turn"] == (r["turn"] - 1 if r["turn"] else None) for r in got)
