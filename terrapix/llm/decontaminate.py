"""Benchmark decontamination by spaced-seed hashing: seeds of items and documents meet in a join by hash."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import BitMap, bit_map
from .scratch import materialise, small_batches
from .skew import hot_keys, salted_join

WEIGHT = 8
"""Words that a seed reads at most."""
NEAR = 8
"""Diagonals so many words apart add up, for inserted and dropped words, if they hold ``RUN`` words of the item."""
RUN = 5
SLICE = 1 << 18
WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode(), 1)
        return h


def word_hashes(text: str | None, seen: _Hashes) -> np.ndarray:
    """Hashes of the lower-cased runs of letters, digits and underscores."""
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def seed_weight(n: int, least: float) -> int:
    """Words that each seed of an item of ``n`` words reads.

    A document that has ``least`` of the words in place lacks m of them at most, so of any m + 1 seeds without a
    word in common one is whole. The weight is the greatest for which the item has that many.
    """
    lacking = n - max(1, math.ceil(least * n - 1e-9))
    return max(1, min(WEIGHT, n // (lacking + 1)))


def masks_of(weight: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The two masks of a weight: one reads every other word, one reads words in a row."""
    return tuple(range(0, 2 * weight, 2)), tuple(range(weight))


def seed_keys(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """A key for every position at which the mask fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    key = np.full(n, number + 1, np.uint64)
    for o in mask:
        key = (key ^ h[o : o + n]) * MIX
        key ^= key >> np.uint64(29)
    return key


def item_seeds(h: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(key, position, weight) of the seeds of an item: pairs of interleaved spaced ones, and a solid one in the rest."""
    w, n = seed_weight(len(h), least), len(h)
    spaced, solid = masks_of(w)
    pairs = n // (2 * w)
    a, b = seed_keys(h, spaced, 2 * w), seed_keys(h, solid, 2 * w + 1)
    out = [(int(a[p]), p, w) for k in range(pairs) for p in (2 * w * k, 2 * w * k + 1)]
    return out + ([(int(b[2 * w * pairs]), 2 * w * pairs, w)] if n - 2 * w * pairs >= w else [])


def seed_hits(index: BitMap, weights: list[int], texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, positions) of every text's seeds that may be in an item, looked up for all texts at once."""
    ends = np.cumsum([len(x) for x in texts])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    h = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    keys, at, own = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for w in weights:
        for k, mask in enumerate(masks_of(w)):
            key = seed_keys(h, mask, 2 * w + k)
            pos = np.flatnonzero(index.may_have(key))
            text = np.searchsorted(ends, pos, "right")
            inside = pos + mask[-1] < ends[text]  # a seed that spans two texts is none
            keys.append(key[pos[inside]])
            at.append(pos[inside] - starts[text[inside]])
            own.append(text[inside])
    keys, at, own = map(np.concatenate, (keys, at, own))
    order = np.argsort(own, kind="stable")
    cut = np.searchsorted(own[order], np.arange(len(texts) + 1))
    for a, b in zip(cut, cut[1:], strict=False):
        yield keys[order[a:b]], at[order[a:b]]


def overlap(item: np.ndarray, h: np.ndarray, starts: np.ndarray, least: float) -> tuple[int, int] | None:
    """(first word, words matched) if ``least`` of the item's words are in ``h``, where it would begin at ``starts``.

    On each diagonal words are compared one by one, so substituted ones only lower the count. The best diagonal
    counts (the first of ties), and with it what is in place on those within ``NEAR`` words that have ``RUN`` words.
    """
    n, best, rows = len(item), None, []
    for k in range(0, len(starts), 4096):
        d = starts[k : k + 4096]
        at = d[:, None] + np.arange(n)
        eq = (h[np.clip(at, 0, len(h) - 1)] == item) & (at >= 0) & (at < len(h))
        count = eq.sum(1)
        i = int(np.lexsort((d, -count))[0])
        if best is None or (-int(count[i]), int(d[i])) < best[:2]:
            best = (-int(count[i]), int(d[i]), eq[i])
        rows += [(int(d[j]), eq[j]) for j in np.flatnonzero((count >= RUN) & (count < least * n - 1e-9))]
    matched = best[2].copy()
    if matched.sum() < least * n - 1e-9:
        for d, eq in rows:
            if abs(d - best[1]) <= NEAR:
                matched |= eq
    total = int(matched.sum())
    return (max(0, best[1]), total) if total >= least * n - 1e-9 else None


def _digests(text: Column, names: tuple[str, str]) -> list[Column]:
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(7), text).alias(names[1])]


def _seeds(benchmark: DataFrame, item_col: str, text_col: str, least: float) -> DataFrame:
    """(g1, g2, own, n, key, at, weight): the seeds of every distinct item text and the text's word hashes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, seen = [], _Hashes()
            for g1, g2, text in zip(b["g1"], b["g2"], b["t"], strict=True):
                if len(h := word_hashes(text, seen)):
                    found = item_seeds(h, least)
                    keys = np.array([x[0] for x in found], np.uint64).view(np.int64)
                    rows.append((g1, g2, h.tobytes(), keys, [x[1] for x in found], found[0][2]))
            yield pd.DataFrame(rows, columns=["g1", "g2", "own", "keys", "ats", "weight"])

    chosen = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    texts = chosen.select(*_digests(F.col(text_col), ("g1", "g2")), F.col(text_col).alias("t")).dropDuplicates(["g1", "g2"])
    return texts.mapInPandas(work, "g1 long, g2 long, own binary, keys array<long>, ats array<int>, weight int")


def _found(docs: DataFrame, benchmark: DataFrame, least: float, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame] | None:
    """((h1, h2, g1, g2, start_word, n_matched, n_words) by distinct document and item text, hot (h1, h2)); None without items."""
    small_batches(docs.sparkSession)
    items = materialise(_seeds(benchmark, item_col, item_text_col, least), "items")
    seeds = items.select("g1", "g2", "weight", F.explode(F.arrays_zip("keys", "ats")).alias("s")).select("g1", "g2", "weight", F.col("s.keys").alias("key"), F.col("s.ats").alias("at"))
    count = seeds.count()
    if not count:
        return None
    index = bit_map(seeds, "key", count)
    weights = sorted(r[0] for r in seeds.select("weight").distinct().collect())

    def touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, held, size = _Hashes(), [], 0

        def flush() -> pd.DataFrame:
            rows = [(*x[:3], k.view(np.int64), p) for x, (k, p) in zip(held, seed_hits(index, weights, [x[3] for x in held]), strict=True) if len(k)]
            return pd.DataFrame(rows, columns=["h1", "h2", "t", "keys", "ats"])

        for b in batches:
            for h1, h2, text in zip(b["h1"], b["h2"], b["t"], strict=True):
                held.append((h1, h2, text, word_hashes(text, seen)))
                size += len(held[-1][3])
                if size > SLICE:
                    yield flush()
                    held, size = [], 0
        yield flush()

    chosen = docs.where(F.col(text_col).isNotNull()).select(*_digests(F.col(text_col), ("h1", "h2")), F.col(text_col).alias("t"))
    touched = materialise(chosen.mapInPandas(touch, "h1 long, h2 long, t string, keys array<long>, ats array<int>"), "touched")
    hot_texts = hot_keys(touched.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")), ["h1", "h2"], "c")
    hits = touched.select("h1", "h2", "keys", "ats").dropDuplicates(["h1", "h2"])
    hits = materialise(hits.select("h1", "h2", F.explode(F.arrays_zip("keys", "ats")).alias("s")).select("h1", "h2", F.col("s.keys").alias("key"), F.col("s.ats").alias("pos")), "hits")
    hot = hot_keys(hits.groupBy("key").agg(F.count(F.lit(1)).alias("c")), ["key"], "c")
    met = salted_join(hits, seeds.select("key", "g1", "g2", "at"), ["key"], hot, "h1")
    pairs = met.groupBy("h1", "h2", "g1", "g2").agg(F.collect_set(F.col("pos") - F.col("at")).alias("starts"))
    pairs = materialise(pairs, "pairs")
    hot = hot_keys(pairs.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("c")), ["g1", "g2"], "c")
    seekers = salted_join(pairs, items.select("g1", "g2", "own"), ["g1", "g2"], hot, "h1")
    needed = touched.select("h1", "h2", "t").dropDuplicates(["h1", "h2"]).join(pairs.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    none = [F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2")]  # a null would make them floats, which lose digits
    none += [F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("binary").alias("own")]
    texts = needed.select("h1", "h2", F.lit(0).alias("role"), *none, "t")
    both = texts.unionByName(seekers.select("h1", "h2", F.lit(1).alias("role"), "g1", "g2", "starts", "own", F.lit(None).cast("string").alias("t")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, h = _Hashes(), np.empty(0, np.uint64)  # a text comes right before what seeks in it
        for b in batches:
            rows = []
            for h1, h2, role, g1, g2, starts, own, text in zip(*(b[c] for c in ("h1", "h2", "role", "g1", "g2", "starts", "own", "t")), strict=True):
                if role == 0:
                    h = word_hashes(text, seen)
                    continue
                item = np.frombuffer(own, np.uint64)
                if (got := overlap(item, h, np.asarray(starts, np.int64), least)) is not None:
                    rows.append((h1, h2, int(g1), int(g2), *got, len(item)))
            yield pd.DataFrame(rows, columns=["h1", "h2", "g1", "g2", "start_word", "n_matched", "n_words"])

    checked = both.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "role").mapInPandas(verify, "h1 long, h2 long, g1 long, g2 long, start_word long, n_matched long, n_words long")
    return materialise(checked, "found"), hot_texts


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document row and benchmark item of which it holds ``least`` of the words, in place.

    Columns: the document's id, the item's id, start_word, n_matched, n_words, similarity (n_matched / n_words).
    Words are lower-cased runs of letters, digits and underscores. Every item of any length that has ``least`` of
    its words in place is found: its seeds read disjoint words, one more than may be lacking, so that one is whole
    in the document. Seeds of all texts are computed once; those that a bit map of the items' seeds lets pass meet
    the items' seeds in a join by hash, and words are compared around the hits. Where a word is inserted or
    dropped, the parts before and after it add up if each has a whole seed.

    Ids may be of any type. Items without words, null texts and items with a null id match nothing, as do null and
    empty documents. Equal texts are searched once; repeated document rows have repeated results. An empty table on
    either side gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id_"), *_digests(F.col(text_col), ("h1", "h2")))
    ids = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_"), *_digests(F.col(item_text_col), ("g1", "g2"))).distinct()
    got = _found(docs, benchmark, least, text_col, item_col, item_text_col)
    if got is None:
        found = ids.join(rows, F.lit(False)).withColumns({c: F.lit(0).cast("long") for c in ("start_word", "n_matched", "n_words")})
    else:
        counts = got[0].groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("c"))
        named = salted_join(got[0], ids, ["g1", "g2"], hot_keys(counts, ["g1", "g2"], "c"), "h1")
        found = salted_join(rows, named, ["h1", "h2"], got[1], "id_")
    return found.select(
        F.col("id_").alias(id_col), F.col("item_").alias(item_col), "start_word", "n_matched", "n_words", (F.col("n_matched") / F.col("n_words")).alias("similarity")
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found (see :func:`find_overlaps`); null texts stay."""
    got = _found(docs, benchmark, least, text_col, item_col, item_text_col)
    if got is None:
        return docs
    spread = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    rows = docs.select(F.struct(*docs.columns).alias("row_"), spread.alias("spread_"), *_digests(F.col(text_col), ("h1", "h2")))
    gone = got[0].select("h1", "h2").distinct().withColumn("gone_", F.lit(True))
    kept = salted_join(rows, gone, ["h1", "h2"], got[1], "spread_", "left").where("gone_ is null")
    return kept.select("row_.*")
