"""The language model against a dictionary version, and its normalisation."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from coppice.llm import katz


def plain(train, scored, frequent, discounted=katz.DISCOUNTED):
    """Base and model scores, token by token."""
    toks = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [" end"]
    train = [toks(t) for t in train]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    least = max(2, -(-n // frequent))
    common = {w for w, c in counts.items() if c >= least}
    cls = lambda w: w if w in common else None
    rare = n - sum(counts[w] for w in common) + 0.1 * (v - len(common) + 1)
    uni = lambda c: (rare if c is None else counts[c] + 0.1) / (n + 0.1 * (v + 1))
    pairs = Counter()
    for t in train:
        pairs.update(zip([" begin"] + [cls(w) for w in t], [cls(w) for w in t]))
    nr = Counter(pairs.values())
    large = (discounted + 1) * nr[discounted + 1] / nr[1] if nr[1] else 0
    d = {}
    for r in range(1, discounted + 1):
        x = ((r + 1) * nr[r + 1] / (nr[r] * r) - large) / (1 - large) if nr[r] and large < 1 else 0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    after = {}
    for (a, b), r in pairs.items():
        after.setdefault(a, {})[b] = r
    kept = {a: sum(d.get(r, 1) * r for r in s.values()) for a, s in after.items()}
    full = {a for a, s in after.items() if len(s) == len(common) + 1}
    alpha = {a: (1 - kept[a] / sum(s.values())) / (1 - sum(map(uni, s))) for a, s in after.items() if a not in full}

    def p(a, b):
        if a not in after:
            return uni(b)
        if b in after[a]:
            return d.get(after[a][b], 1) * after[a][b] / (kept[a] if a in full else sum(after[a].values()))
        return alpha[a] * uni(b)

    for a in after:
        assert math.isclose(sum(p(a, b) for b in [*common, None]), 1, rel_tol=1e-9)
    out = []
    for t in map(toks, scored):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = sum(math.log10(p(a, cls(b)) * (1 if b in common else (counts[b] + 0.1) / rare))
                    for a, b in zip([" begin"] + [cls(w) for w in t], t))
        out.append((len(t), sum(counts[w] > 0 for w in t), n, base, score))
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = ["The", "the", "of", "and", "a"] + [f"w{i}" for i in range(60)]
    line = lambda: " ".join(r.choice(words[: r.choice([3, 8, 65])]) for _ in range(r.randint(0, 40)))
    return [line() for _ in range(120)] + [None, "", "the\tthe\nof", "é É z z"] + ["w1 w2 the the"] * 5


@pytest.mark.parametrize("frequent", [1 << 20, 40])
@pytest.mark.parametrize("at_once", [katz.AT_ONCE, 300])
def test_as_plain_version(spark, corpus, frequent, at_once, monkeypatch):
    monkeypatch.setattr(katz, "AT_ONCE", at_once)
    rows = [(i, t, "x") for i, t in enumerate(corpus)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    model = katz.fit(docs.where("doc_id % 3 != 0"), frequent=frequent)
    got = {r[0]: tuple(r)[1:] for r in katz.score(docs, model).collect()}
    expected = plain([t for i, t in enumerate(corpus) if i % 3], corpus, frequent)
    assert len(got) == len(corpus)
    for i, want in enumerate(expected):
        assert got[i][:3] == want[:3]
        assert got[i][3:] == pytest.approx(want[3:], rel=1e-9)


def test_only_distinct_words_become_objects(monkeypatch):
    hashed = []
    ids = katz._ids
    monkeypatch.setattr(katz, "_ids", lambda words: hashed.append(len(words)) or ids(words))
    made = ["cut off", None, "", " ", "A  a\tb ", "\x0b\x0cB\x1cb\u00a0É\n", "two words " * 1000]
    hashes, tokens, lengths = katz._tokens(pa.array(made).slice(1))
    words = [[w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in made[1:]]
    words[4] = ["b\x1cb\u00a0É"]
    assert lengths.tolist() == [len(x) + 1 for x in words]
    assert hashes[tokens].tolist() == ids([w.encode() for x in words for w in [*x, " end"]]).tolist()
    assert sum(hashed) < 10
    numbers = np.array([5, 0, 5, 3, 5])
    for below in (6, 1 << 62):
        found, starts, runs, order = katz._grouped(numbers, below)
        assert (found.tolist(), starts.tolist(), runs.tolist(), order.tolist()) == ([0, 3, 5], [0, 1, 2], [1, 1, 3], [1, 3, 0, 2, 4])


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (None, "a b"), (2, None)], "doc_id long, text string")
    model = katz.fit(docs)
    rows = katz.score(docs, model).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 3), (1, 4), (1, 4), (2, 1)]
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    none = docs.where("false")
    assert katz.score(none, model).count() == 0
    nothing = katz.score(docs, katz.fit(none)).collect()
    assert all(r["score"] == r["base_score"] == 0.0 for r in nothing)


def whole(train, scored, discounted=katz.DISCOUNTED):
    """Model scores with every word of the training texts as history and successor, and the unknown word."""
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [" end"]
    counts = Counter(w for t in train for w in toks(t))
    n, v = sum(counts.values()), len(counts)
    uni = lambda w: (counts[w] + 0.1) / (n + 0.1 * (v + 1))
    pairs = Counter(p for t in train for p in zip([" begin"] + toks(t), toks(t)))
    d = dict(enumerate(katz.good_turing(katz.np.bincount([min(r, discounted + 2) for r in pairs.values()], minlength=discounted + 3))))
    after = {}
    for (a, b), r in pairs.items():
        after.setdefault(a, {})[b] = r

    def p(a, b):
        if a not in after:
            return uni(b)
        s = after[a]
        kept, total = sum(d[r] * r if r <= discounted else r for r in s.values()), sum(s.values())
        total += all(r > discounted for r in s.values())
        if b in s:
            return (d[s[b]] if s[b] <= discounted else 1) * s[b] / total
        return (1 - kept / total) / (1 - sum(map(uni, s))) * uni(b)

    for a in after:
        assert math.isclose(sum(p(a, b) for b in [*counts, None]), 1, rel_tol=1e-9)
    return [sum(math.log10(p(a, b)) for a, b in zip([" begin"] + toks(t), toks(t))) for t in scored]


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_every_word_keeps_its_pairs(spark, corpus, frequent, monkeypatch):
    """Words seen once, and words below the share that is broadcast, are histories and successors of their own."""
    monkeypatch.setattr(katz, "FREQUENT", frequent)
    texts = [(t or "").replace("É", "é") for t in corpus] + ["once upon once2", "upon once2", "always next"] + ["always next"] * 8 + ["always w1", "once upon upon unknown"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = texts[:-2]
    model = katz.fit(docs.where(f"doc_id < {len(train)}"))
    got = {r["doc_id"]: r["score"] for r in katz.score(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(whole(train, texts), rel=1e-9)
