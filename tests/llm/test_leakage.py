"""Leaked passages: full, half, altered, marked up; no false finds; hot items."""

import random

import pytest

from chartloom.llm.leakage import leaked_items

R = random.Random(8)
VOCAB = [f"word{k}" for k in range(3000)]
ITEMS = [(i, " ".join(R.choice(VOCAB) for _ in range(60))) for i in range(20)]


def filler(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def altered(text, seed):
    r = random.Random(seed)
    return " ".join("other" if r.random() < 0.1 else w for w in text.split())


def test_leaks(spark):
    words = ITEMS[3][1].split()
    docs = [
        (1, filler(200, 1) + " " + ITEMS[0][1] + " " + filler(100, 2)),
        (2, filler(50, 3) + " " + " ".join(words[10:45])),
        (3, "<p>" + altered(ITEMS[5][1], 1).replace(" ", "</b> \n") + "</p>"),
        (4, " ".join(words[:15])),
        (5, " ".join(words[:20]) + " " + filler(30, 5) + " " + " ".join(words[30:55]).upper().replace(" ", ", ")),
        (6, None), (7, ""), (8, filler(500, 9)), (1, filler(200, 1) + " " + ITEMS[0][1] + " " + filler(100, 2)),
    ]
    hot = [(100 + k, filler(20, 50 + k) + " " + ITEMS[7][1]) for k in range(60)]
    df = spark.createDataFrame([(*d, 0) for d in docs + hot], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, ""), (97, "too short")], "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(df, items).collect()}
    assert got == {(1, 0), (2, 3), (3, 5), (5, 3)} | {(100 + k, 7) for k in range(60)}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, passage string")
    assert leaked_items(docs, items).count() == 0
    assert leaked_items(docs.limit(0), spark.createDataFrame(ITEMS, "item_id bigint, passage string")).count() == 0


def found(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in leaked_items(df, spark.createDataFrame(items, "item_id bigint, passage string")).collect()}


def test_items_in_several_copies_are_found(spark):
    same = [(k, ITEMS[1][1]) for k in range(5)]
    assert found(spark, [(1, filler(30, 1) + " " + ITEMS[1][1]), (2, filler(30, 2))], same) == {(1, k) for k in range(5)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_short_items_must_stand_whole(spark, n):
    words = [f"short{k}" for k in range(n)]
    docs = [(1, filler(20, 1) + " " + " ".join(words).upper() + " " + filler(20, 2)), (2, filler(20, 3) + " " + " ".join(words[:-1])), (3, " x ".join(words) if n > 1 else "x")]
    assert found(spark, docs, [(7, " ".join(words)), (8, "never there")]) == {(1, 7)}


def test_small_blocks_and_shards_change_nothing(spark, monkeypatch):
    import chartloom.llm.leakage as k

    docs = [(d, filler(30, d) + " " + " ".join(ITEMS[d % 20][1].split()[d % 7 : 50]) + " " + ITEMS[(d + 3) % 20][1]) for d in range(60)]
    items = [*ITEMS, (50, "word1 word2"), (51, ITEMS[4][1])]
    whole = found(spark, docs, items)
    assert len(whole) >= 120
    monkeypatch.setattr(k, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(k, "SHARD_WORDS", 200)
    monkeypatch.setattr(k, "SALTS", 3)
    monkeypatch.setattr(k, "MOST_SPREAD", 50)
    assert found(spark, docs, items) == whole


def test_posting_lists_come_back(spark):
    import numpy as np

    from chartloom.llm.leakage import packed, unpacked

    x = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 34) + 5])
    assert unpacked(packed(x)[0]).tolist() == x.tolist()


def test_all_equal_the_plain_search(spark):
    """Whole passages, found by looking for their words in each document's."""
    from chartloom.llm.leakage import tokens

    r = random.Random(4)
    docs = [(d, filler(100, 200 + d) + (" " + r.choice(ITEMS)[1] if d % 3 else "") + " <b>" + filler(20, 300 + d)) for d in range(50)]
    plain = {(d, i) for d, t in docs for i, p in ITEMS if " ".join(tokens(p)) in " ".join(tokens(t))}
    assert found(spark, docs, ITEMS) == plain


@pytest.mark.parametrize("count", [3, 4, 5])
def test_several_stretches_of_a_passage_with_few_rare_phrases(spark, count):
    shared = [f"stock{k}" for k in range(200)]  # in every item, so that no phrase is rare
    items = [(i, " ".join(shared[i : i + 100])) for i in (0, 100)] + [(10 + k, " ".join(shared[:100])) for k in range(3)]
    words, size = items[0][1].split(), -(-54 // count)
    cut = [" ".join(words[k * 100 // count : k * 100 // count + size]) for k in range(count)]
    docs = [(1, " ".join(f"{filler(20, 70 + k)} {c}" for k, c in enumerate(cut))), (2, filler(40, 90) + " " + cut[0])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(df, spark.createDataFrame(items, "item_id bigint, passage string")).collect()}
    assert got == {(1, 0), (1, 10), (1, 11), (1, 12)}


def test_several_stretches_below_the_share_of_one(spark):
    long = " ".join(f"own{k}" for k in range(130))
    words = long.split()
    doc = " ".join(f"{filler(20, 60 + k)} " + " ".join(words[26 * k : 26 * k + 14]) for k in range(5))
    df = spark.createDataFrame([(1, doc)], "doc_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in leaked_items(df, spark.createDataFrame([(1, long)], "item_id bigint, passage string")).collect()] == [(1, 1)]


def test_stock_phrases_with_a_fifth_of_other_words_are_no_leak(spark):
    words = [f"own{k}" for k in range(100)]
    doc = " ".join(filler(3, k) if k % 10 == 9 else w for k, w in enumerate(words))
    far = " ".join("other" if k % 5 == 4 else w for k, w in enumerate(words))
    df = spark.createDataFrame([(1, doc), (2, far)], "doc_id bigint, text string")
    assert [r.doc_id for r in leaked_items(df, spark.createDataFrame([(1, " ".join(words))], "item_id bigint, passage string")).collect()] == [1]
