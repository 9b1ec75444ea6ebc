"""The prefix-tree join against brute force, at several thresholds, hot groups and copies included."""

import random
import re
from itertools import combinations

import pytest

from chartloom.llm import neardup

WORD = re.compile(r"[^\W_]+")


def brute(rows, words, share, least):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        if t is not None and len(w) >= max(least, words):
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-9}


def collection(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    base = [[r.choice(vocab) for _ in range(r.randrange(30, 90))] for _ in range(12)]
    rows = []
    for i in range(260):
        t = list(r.choice(base[:1] if i % 3 == 0 else base))
        for _ in range(r.randrange(8)):
            k = r.randrange(len(t))
            t[k : k + r.randrange(2)] = [r.choice(vocab)] * r.randrange(3)
        rows.append((i, " ".join(t)))
    return rows + [(300, rows[0][1]), (301, rows[0][1].upper()), (302, None), (303, ""), (304, "w1 w2"), (0, rows[0][1])]


@pytest.mark.parametrize("words, share, least", [(3, 0.6, 1), (5, 0.8, 1), (2, 0.9, 40)])
@pytest.mark.parametrize("block, heavy", [(8192, 1 << 20), (16, 1 << 20), (16, 40), (8192, 0)])
def test_equals_brute_force(spark, monkeypatch, words, share, least, block, heavy):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "MOST_HEAVY", heavy)
    rows = collection(words)
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, t string, sig string").repartition(3)
    got = [(r.id_a, r.id_b) for r in neardup.similar_pairs(df, "id", "t", words, share, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(dict(rows).items(), words, share, least)


def test_groups(spark):
    rows = collection(1)
    df = spark.createDataFrame(rows, "id bigint, t string")
    pairs = brute(dict(rows).items(), 3, 0.6, 1)
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.id: r for r in neardup.similar_groups(df, "id", "t", 3, 0.6).collect()}
    assert all(g.group_id == root(i) for i, g in got.items())
    assert all(g.n_links == sum(i in p for p in pairs) for i, g in got.items())
    assert got[300].class_id == got[301].class_id == 0


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, t string")
    assert neardup.similar_pairs(df, "id", "t").count() == 0
    assert neardup.similar_groups(df, "id", "t").count() == 0
