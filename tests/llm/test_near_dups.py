"""Near duplicates are just what the whole shingle sets say."""

import os
import random

import pytest

from terrapix.llm import near_dups


def words(seed, n):
    rnd = random.Random(seed)
    return [f"w{rnd.randint(0, 10**9)}" for _ in range(n)]


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in near_dups.drop_near_duplicates(df).collect())


def test_texts_of_one_repeated_phrase_are_not_linked_by_their_fingerprints(spark):
    texts = [" ".join(["spam"] * 400 + words(k, 40)) for k in range(6)]
    assert kept(spark, texts) == list(range(6))


def test_repeats_inside_a_text_do_not_hide_a_near_copy(spark):
    texts = []
    for k in range(8):
        own = words(100 + k, 200)
        texts += [" ".join(own), " ".join(own[:16] * 60 + own)]
    assert kept(spark, texts) == list(range(0, 16, 2))


def test_long_texts_are_decided_on_whole_sets(spark):
    texts = []
    for k in range(12):
        own = words(300 + k, 2000)
        cut = 440 if k % 2 else 420  # 0.78 and 0.79 of the whole
        texts += [" ".join(own), " ".join(own[: 2000 - cut])]
    assert kept(spark, texts) == list(range(24))


def test_short_and_long_pairs_at_the_limit_are_found(spark):
    texts = []
    for k in range(10):
        for n, less in ((9, 1), (14, 2), (24, 4), (1204, 228)):  # 5, 10, 20 and 1,200 shingles
            own = words(1000 * n + k, n)
            texts += [" ".join(own), " ".join(own[: n - less])]
    assert kept(spark, texts) == list(range(0, 80, 2))


def test_links_between_members_of_a_family_are_those_of_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    texts = []
    for k in range(2):
        own = words(5000 + k, 60)
        for _ in range(25):  # a chain of copies, of which only neighbours are near
            texts.append(" ".join(own))
            own[rnd.randrange(60)] = f"x{rnd.randint(0, 10**9)}"
    rnd.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pairs in (near_dups.PAIRS, 0, -1):
        monkeypatch.setattr(near_dups, "PAIRS", pairs)
        got = {r.doc_id: r.component_id for r in near_dups.near_duplicate_groups(df).collect()}
        assert [got[i] for i in range(len(texts))] == label


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_documents_of_the_smallest_tables_are_grouped_as_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i in sets for j in sets if j < i and near(sets[i], sets[j])]
    label = {i: i for i in sets}
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicate_groups(docs).collect()} == label


def test_parities_never_show_more_apart_than_there_is():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, more in ((10, 3), (900, 200), (3000, 10), (70_000, 9_000)):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[more // 2 :], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        apart = near_dups.bits_apart(near_dups.parities(a), near_dups.parities(b))
        assert apart <= len(np.setxor1d(a, b)) and apart == near_dups.bits_apart(near_dups.parities(b), near_dups.parities(a)) > 0
