"""Every item that has enough of its words in place is found, whatever words are substituted."""

import random
from itertools import combinations

import numpy as np
import pytest

from terrapix.llm import decontaminate as D


@pytest.mark.parametrize("least", [0.8, 0.9, 0.6])
def test_no_set_of_substitutions_hits_all_seeds(least):
    rnd = np.random.default_rng(1)
    for n in range(1, 21):
        h = rnd.integers(1, 1 << 62, n).astype(np.uint64)
        lacking = n - max(1, int(np.ceil(least * n - 1e-9)))
        seeds = [{at + o for o in mask} for key, at, w in D.item_seeds(h, least) for k, mask in enumerate(D.masks_of(w)) if at + mask[-1] < n and int(D.seed_keys(h, mask, 2 * w + k)[at]) == key]
        assert len(seeds) == len(D.item_seeds(h, least)) > lacking
        assert sum(map(len, seeds)) == len(set().union(*seeds))  # no word is read twice, so lacking words cannot hit all
        if n <= 15:
            for gone in combinations(range(n), lacking):
                assert any(not s & set(gone) for s in seeds)


def test_short_and_long_items_with_substituted_words_are_found(spark):
    rnd = random.Random(3)
    items, docs = [], []
    for n in [*range(1, 31), 60, 200]:
        own = [f"w{rnd.randint(0, 10**9)}" for _ in range(n)]
        items.append((n, " ".join(own)))
        lacking = n - max(1, int(np.ceil(0.8 * n - 1e-9)))
        for k in range(6):
            for more in (0, 1):
                gone = set(rnd.sample(range(n), min(n, lacking + more)))
                text = [f"x{rnd.randint(0, 10**9)}" if i in gone else w for i, w in enumerate(own)]
                pad = [f"p{rnd.randint(0, 10**9)}" for _ in range(rnd.randint(0, 9))]
                docs.append((1000 * n + 10 * k + more, " ".join([*pad, *text, *pad])))
    found = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, d // 1000) for d, _ in docs if d % 10 == 0}
    for r in found:
        assert r.n_matched == max(1, int(np.ceil(0.8 * r.n_words - 1e-9)))


def test_an_inserted_word_only_shifts_the_rest(spark):
    own = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join([*own[:20], "more", *own[20:]])), (2, " ".join(own[:20]))], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(own)), ("b", " ".join(own))], "item_id string, text string")
    assert sorted((r.doc_id, r.item_id, r.n_matched) for r in D.find_overlaps(docs, items).collect()) == [(1, "a", 40), (1, "b", 40)]


def test_clashing_names_and_text_ids(spark):
    docs = spark.createDataFrame([("x", "one two three four five", 1, 2, {"k": 1}), ("y", None, 3, 4, None)], "doc_id string, text string, h1 int, spread_ int, m map<string,int>")
    items = spark.createDataFrame([(1, "one two three four nine", "k")], "item_id int, text string, key string")
    assert [(r.doc_id, r.item_id, r.n_matched) for r in D.find_overlaps(docs, items).collect()] == [("x", 1, 4)]
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == ["y"]


def test_a_document_that_half_of_the_rows_copy_is_dealt_out(spark):
    own = " ".join(f"w{k}" for k in range(30))
    docs = spark.range(4000).selectExpr("id AS doc_id", f"if(id % 2 = 0, '{own}', concat('clean text ', id)) AS text")
    items = spark.createDataFrame([(1, own)], "item_id int, text string")
    assert D.find_overlaps(docs, items).count() == 2000 and D.drop_contaminated(docs, items).count() == 2000
