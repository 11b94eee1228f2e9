"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise, small_batches

WORD_SLOTS = 1 << 16
STAT_SLOTS = 1 << 10
SLOTS = WORD_SLOTS + STAT_SLOTS
RANK = 8
SAMPLE_ROWS = 12_000
"""Labelled documents that a model is fitted on at most."""
SAMPLE_FEATURES = 12_000_000
"""Features that the driver holds at most while it fits."""

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123))
BLANKS = b" \t\n\x0b\x0c\r"


def _share(data: bytes, chars: bytes) -> float:
    return (len(data) - len(data.translate(None, chars))) / max(1, len(data))


def statistics(data: bytes, words: Counter, n: int) -> dict[str, float]:
    """Shares and logarithms that describe how a text is built; none of them is a word."""
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    line_counts = Counter(filled)
    plain = len(data.translate(None, LETTERS + DIGITS + BLANKS))
    high = sum(map(len, (x for x in words if not x.isascii())))
    mean = sum(len(w) * c for w, c in words.items()) / max(1, n)
    return {
        "words": np.log2(n + 1),
        "mean_word": mean,
        "distinct": len(words) / max(1, n) ** 0.8,
        "top_word": max(words.values(), default=0) / max(1, n),
        "upper": _share(data, UPPER),
        "digits": _share(data, DIGITS) * 2,
        "symbols": plain / max(1, len(data)) - high / max(1, len(data)) / 8,
        "bangs": _share(data, b"!") * 4,
        "bars": _share(data, b"|") * 4,
        "marks": _share(data, b"#$%&*@^~<>{}[]\\") * 4,
        "stops": _share(data, b".,;:?") * 4,
        "lines": np.log2(len(lines)),
        "line_words": np.log2(n / max(1, len(filled)) + 1),
        "line_repeats": 1 - len(line_counts) / max(1, len(filled)),
    }


def featurise(text: str | None, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text: words by 1 + log of their counts, at unit length; statistics in steps.

    Each statistic falls into one step of a fixed scale, and steps next to it count in part, so that pairs of
    statistics and of words and statistics interact. Metadata are taken like statistics, a null as a step of its own.
    """
    data = (text or "").encode()
    words = Counter(data.lower().split())
    n = sum(words.values())
    slots = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % WORD_SLOTS
    values = 1 + np.log(np.fromiter(words.values(), np.float64, len(words)))
    if len(slots):
        slots, inverse = np.unique(slots, return_inverse=True)
        values = np.bincount(inverse, values)
        values /= np.linalg.norm(values)
    more_s, more_v = [], []
    named = list(statistics(data, words, n).items()) + [(f"meta{i}", m) for i, m in enumerate(metadata)]
    for name, x in named:
        if x is None or not np.isfinite(x):
            more_s.append(zlib.crc32(f"{name}:none".encode()) % STAT_SLOTS)
            more_v.append(0.3)
            continue
        scaled = x * (2 if x > 1 else 24)
        low = int(scaled)
        for step, weight in ((low, 1 - (scaled - low)), (low + 1, scaled - low)):
            if weight > 0:
                more_s.append(zlib.crc32(f"{name}:{x > 1}:{step}".encode()) % STAT_SLOTS)
                more_v.append(0.3 * weight)
    return np.concatenate([slots, np.array(more_s, np.int64) + WORD_SLOTS]).astype(np.int32), np.concatenate([values, more_v]).astype(np.float32)


@dataclass
class FactorisationMachine:
    """score = sigmoid(b + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2)), in time linear in the features."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((SLOTS, RANK), np.float32))

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        vx = self.factors[slots].astype(np.float64) * values[:, None]
        pairs = 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum())
        z = self.bias + float(self.weights[slots].astype(np.float64) @ values) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, rows: list, labels: np.ndarray, steps: int = 1100, batch: int = 64, rate: float = 0.08, decay: float = 1e-5, seed: int = 1) -> FactorisationMachine:
        """Logistic loss by AdaGrad over small batches, ``steps`` of them at least and six rounds of all rows at least.

        The gradient of a pair term comes from the same sums as its value.
        """
        rng = np.random.default_rng(seed)
        mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        self.bias = float(np.log(mean / (1 - mean)))
        if not len(labels) or labels.min() == labels.max():
            return self
        self.factors = rng.normal(0, 0.02, (SLOTS, RANK)).astype(np.float32)
        sum_w, sum_v, sum_b = np.full(SLOTS, 1e-2, np.float32), np.full((SLOTS, RANK), 1e-2, np.float32), 1e-2
        for _ in range(max(6, -(-steps * batch // len(rows)))):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                chosen = order[k : k + batch]
                sizes = np.array([len(rows[i][0]) for i in chosen])
                slots = np.concatenate([rows[i][0] for i in chosen])
                x = np.concatenate([rows[i][1] for i in chosen])
                starts = np.cumsum(sizes) - sizes
                v = self.factors[slots]
                vx = v * x[:, None]
                sums = np.add.reduceat(vx, starts, axis=0)
                z = self.bias + np.add.reduceat(self.weights[slots] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
                gx = np.repeat(g, sizes) * x
                gv = gx[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                by_slot = np.argsort(slots, kind="stable")
                own, first = np.unique(slots[by_slot], return_index=True)
                dw = np.add.reduceat(gx[by_slot], first) + decay * self.weights[own]
                dv = np.add.reduceat(gv[by_slot], first, axis=0) + decay * self.factors[own]
                sum_w[own] += dw**2
                sum_v[own] += dv**2
                sum_b += float(g.sum()) ** 2
                self.weights[own] -= (rate * dw / np.sqrt(sum_w[own])).astype(np.float32)
                self.factors[own] -= (rate * dv / np.sqrt(sum_v[own])).astype(np.float32)
                self.bias -= rate * float(g.sum()) / sum_b**0.5
        return self


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = ("n_chars",),
    sample_rows: int = SAMPLE_ROWS,
    sample_features: int = SAMPLE_FEATURES,
) -> FactorisationMachine:
    """Fit on ``sample_rows`` labelled documents at most, the first by a hash of the id, none of them held out.

    The features of the sample, ``sample_features`` of them at most, come to the driver; a sample with more is
    thinned by the same hash. Null labels and labels without a document are left out, several labels of one id
    are averaged. Without labels, or with labels of one kind only, every score is the share of ones (or one half).
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("key"))
        .agg(F.avg(label_col).alias("y"))
        .orderBy(F.xxhash64("key"))
        .limit(sample_rows)
    )
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        docs[id_col].alias("key"),
        docs[text_col].alias("t"),
        F.array(*[docs[c].cast("double") for c in metadata if c in docs.columns]).cast("array<double>").alias("meta"),
    ).join(F.broadcast(chosen), "key")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [featurise(t, _scaled(m)) for t, m in zip(b["t"], b["meta"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "y": b["y"], "n": [len(s) for s, _ in found], "s": [s.tobytes() for s, _ in found], "v": [v.tobytes() for _, v in found]})

    kept = materialise(rows.mapInPandas(work, f"key {kind}, y double, n long, s binary, v binary"), "features")
    total = kept.agg(F.sum("n")).first()[0] or 0
    if total > sample_features:
        kept = kept.where(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(1_000_000)) < int(1_000_000 * sample_features / total))
    got = kept.orderBy("key", "s", "v", "y").select("s", "v", "y").toArrow()
    found = [(np.frombuffer(s.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for s, v in zip(got["s"], got["v"], strict=True)]
    return FactorisationMachine().fit(found, got["y"].to_numpy())


def _scaled(metadata) -> tuple:
    """Counts as logarithms, nulls as they are."""
    return tuple(None if m is None or m != m else float(np.log2(max(0.0, m) + 1)) for m in metadata)


def score_quality(
    docs: DataFrame,
    model: FactorisationMachine,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = ("n_chars",),
    score_col: str = "score",
) -> DataFrame:
    """All columns of ``docs`` and ``score_col`` (in place of one of that name): 0 to 1, higher for label 1.

    Every whole text is scored; null and empty texts by their statistics alone. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    meta = [c for c in metadata if c in docs.columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # the columns pass as they are
            columns = [b.column(c).to_pylist() for c in meta]
            rows = zip(*columns, strict=True) if columns else ((),) * b.num_rows
            texts = b.column(text_col).to_pylist()
            scores = [model.score(*featurise(t, _scaled(m))) for t, m in zip(texts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, score_col])

    kept = docs.drop(score_col)
    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())]))
