"""Components of similar texts against all pairs."""

import random
import re

import pytest

from coppice.llm import components as components_module
from coppice.llm import jaccard_join


def plain(rows, percent=85, width=4):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                links += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr), links


def texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(55)]
    out = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(1, 150))]
        if r.random() < 0.4:
            base += passage
        out.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy).replace("w1", "W1"))
    chain = [r.choice(words) for _ in range(90)]
    for step in range(30):  # neighbours are linked, ends are not
        out.append(" ".join(chain[step : step + 60]))
    crowd = [r.choice(words) for _ in range(70)]
    for _ in range(40):  # a crowd at about the threshold
        copy = list(crowd)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = r.choice(words)
        out.append(" ".join(copy))
    out += [None, "", "  \n", "a", "a b", "A b", "a b c", "one\ttwo three four", "one two three four"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "AT_ONCE", 4000)
    rows = list(enumerate(texts(seed)))
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, cls string")
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(docs.repartition(3)).collect()), key=repr)
    expected, links = plain(rows)
    assert links > 100
    assert got == expected


def test_repeated_and_null_ids_and_no_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (3, "A B C D E"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(docs).collect()), key=repr)
    assert got == plain(rows)[0]
    assert jaccard_join.near_duplicates(docs.where("false")).count() == 0


def test_jobs_of_a_crowd(spark):
    """A crowd of near copies takes few jobs: each costs time, however small its tables."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    crowd = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(150):
        copy = list(crowd)
        for _ in range(r.choice([0, 1, 1, 2])):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.sparkContext.setJobGroup("crowd", "crowd")
    try:
        got = sorted((tuple(r) for r in jaccard_join.near_duplicates(docs).collect()), key=repr)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("crowd"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain(rows)[0]
    assert jobs <= 110


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_by_one_task_and_by_rounds(spark, few, monkeypatch):
    monkeypatch.setattr(components_module, "FEW_LINKS", few)
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    root = {x: x for link in links for x in link}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame([(str(1000 + a).encode(), str(1000 + b).encode()) for a, b in links], "a binary, b binary")
    got = {(int(x["node"]) - 1000, int(x["root"]) - 1000) for x in components_module.components(edges).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {(x, root[x]) for x in linked}
    assert components_module.components(edges.where("false")).count() == 0
