"""Canonical values: the metric, the tree against brute force, dirty values."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import canonical as c

WORDS = st.text("abcd", max_size=7)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, WORDS)
def test_distance_is_a_metric(x, y, z):
    d = lambda a, b: c.distance(a, b, 99)
    assert d(x, y) == d(y, x) and (d(x, y) == 0) == (x == y) and d(x, z) <= d(x, y) + d(y, z)


@pytest.mark.parametrize("a, b, n", [("ca", "abc", 2), ("abcd", "abdc", 1), ("", "abc", 3), ("kitten", "sitting", 3), ("a", "a", 0)])
def test_distance_values(a, b, n):
    assert c.distance(a, b, 99) == n
    assert c.distance(a, b, n) == n


def test_tree_finds_all_within():
    r = random.Random(2)
    names = list({"".join(r.choice("abcde") for _ in range(r.randrange(3, 10))) for _ in range(300)})
    tree = c.BKTree([(n, n) for n in names])
    for _ in range(100):
        w = "".join(r.choice("abcde") for _ in range(r.randrange(2, 10)))
        for k in (0, 1, 2, 3):
            found = {n for _, n in tree.within(w, k)} - ({w} if w in names else set())
            assert found <= {n for n in names if c.distance(w, n, 99) <= k}
            if w not in names:
                assert found == {n for n in names if c.distance(w, n, 99) <= k}


REF = [("C1", "acute hepatic abscess", None), ("C2", "lisinopril", "Zestril"), ("C3", "renal haemorrhage", None), ("C4", "bilateral renal colic", None), ("C5", "", None)]


@pytest.mark.parametrize(
    "value, cui",
    [
        ("Acute  Hepatic-Abscess", "C1"), ("abscess, acute hepatic", "C1"), ("acuet hepatic absces", "C1"), ("zestril 10 mg", "C2"), ("oral Lisinopril i.v.", "C2"), ("lisi-nopril*", "C2"), ("lisino pril ?", "C2"),
        ("renal hemorrhage since spring", "C3"), ("renal colic (left)", "C4"), ("renal colic, stable", "C4"), ("oxygen", "UNMAPPED"), ("", "UNMAPPED"), (None, "UNMAPPED"), ("???", "UNMAPPED"),
    ],
)
def test_values(value, cui):
    tree = c.BKTree(c.short_names(sorted((c.plain(n), k) for k, *ns in REF for n in ns if n)))
    got = c.best(tree, value) if value is not None else None
    assert (got[2] if got else "UNMAPPED") == cui


def test_table_and_shards(spark, monkeypatch):
    ref = spark.createDataFrame(REF, "cui string, canonical_name string, synonyms string")
    values = spark.createDataFrame([("Zestrill", 1), ("Zestrill", 2), (None, 3), ("oxygen", 4), ("renal haemorrhage", 5)], "word string, cost int")
    one = {r.word: r.matched_id for r in c.map_values(values, "word", ref, "cui", ["canonical_name", "synonyms"]).collect()}
    assert one == {"Zestrill": "C2", "oxygen": "UNMAPPED", "renal haemorrhage": "C3"}
    monkeypatch.setattr(c, "SHARD", 2)
    assert {r.word: r.matched_id for r in c.map_values(values, "word", ref, "cui", ["canonical_name", "synonyms"]).collect()} == one
    assert c.map_values(values.limit(0), "word", ref, "cui", ["canonical_name"]).count() == 0
    assert {r.matched_id for r in c.map_values(values, "word", ref.limit(0), "cui", ["canonical_name"]).collect()} == {"UNMAPPED"}


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_levenshtein_bounds_the_metric(x, y):
    import functools

    @functools.cache
    def lev(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(lev(a[1:], b) + 1, lev(a, b[1:]) + 1, lev(a[1:], b[1:]) + (a[0] != b[0]))

    if x:
        n = c.levenshtein(c.places(x), len(x), y)
        assert n == lev(x, y) and (n + 1) // 2 <= c.distance(x, y, 99) <= n


def test_a_tree_comes_back_from_its_rows():
    r = random.Random(7)
    names = [("".join(r.choice("abcd") for _ in range(r.randrange(2, 9))), str(k)) for k in range(200)]
    tree = c.BKTree(names)
    again = c.BKTree.of(tree.rows())
    assert again.names == tree.names and again.kids == tree.kids and again.ids == tree.ids
    for _ in range(50):
        w = "".join(r.choice("abcd") for _ in range(r.randrange(1, 9)))
        assert sorted(again.within(w, 2)) == sorted(tree.within(w, 2)) and again.nearest(w, 3) == tree.nearest(w, 3)


def test_short_forms_are_settled_over_the_whole_list(spark, monkeypatch):
    ref = spark.createDataFrame([("C1", "left bundle branch block"), ("C2", "right bundle branch block"), ("C3", "old renal artery stenosis")], "cui string, canonical_name string")
    values = spark.createDataFrame([("bundle branch block",), ("renal artery stenosis",), ("left bundle branch blok",)], "word string")
    whole = {r.word: r.matched_id for r in c.map_values(values, "word", ref, "cui", ["canonical_name"]).collect()}
    assert whole == {"bundle branch block": "UNMAPPED", "renal artery stenosis": "C3", "left bundle branch blok": "C1"}
    for n in (1, 2, 3):
        monkeypatch.setattr(c, "SHARD", n)
        assert {r.word: r.matched_id for r in c.map_values(values, "word", ref, "cui", ["canonical_name"]).collect()} == whole


@pytest.mark.parametrize("shard", [2, 50_000])
def test_every_entry_within_the_threshold(spark, monkeypatch, shard):
    monkeypatch.setattr(c, "SHARD", shard)
    r = random.Random(3)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randrange(5, 9))) for _ in range(60)})
    ref = spark.createDataFrame([(n, f"K{i}") for i, n in enumerate(names)], "canonical_name string, cui string")
    words = ["".join(r.choice("abc") for _ in range(6)) for _ in range(20)]
    got = {(x.word, x.name) for x in c.entries_within(spark.createDataFrame([(w,) for w in words], "word string"), "word", ref, "cui", ["canonical_name"]).collect()}
    assert got == {(w, n) for w in words for n in names if c.distance(w, n, 99) <= c.radius(w)}
