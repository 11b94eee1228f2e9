"""Roles of transcript turns by a hidden Markov model, and their canonical rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapix.operators.ranking import ranked_prefix

from .scratch import materialise

ROLES = ("system", "user", "assistant", "tool")
# Names by which transcripts mark their speakers.
SPEAKERS = {
    "system": ("system", "context"),
    "user": ("user", "human", "customer", "question", "prompt", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "response", "model", "a"),
    "tool": ("tool", "function", "observation"),
}
ROLE_OF = {name: ROLES.index(role) for role, names in SPEAKERS.items() for name in names}
MARKER = re.compile(
    r"^[ \t>*#\[<|]{0,8}(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")[ \t*\]|>]{0,6}(?::[ \t*]{0,4}|(?<=[\]>])[ \t]*$)",
    re.IGNORECASE | re.MULTILINE,
)
SURE = 0.999
"""Probability that a marker names its speaker."""
CHUNK = 64
"""Turns of a conversation in a stretch, which one step of the search takes."""
FOLD = 256
"""Stretches that are one step of the search along a conversation."""
LONG = 1 << 16
"""Turns up to which one task puts a conversation in order."""
NONE = -1e30


def turn_features(text: Column) -> Column:
    """A small number from the line features of a turn: length, lines and whether it ends in a question."""
    t = F.coalesce(text, F.lit(""))
    size = F.least(F.floor(F.log2(F.char_length(t) + 1)), F.lit(15))
    lines = F.least(F.size(F.split(t, "\n")), F.lit(4)) - 1
    asks = F.rtrim(t).endswith("?").cast("int")
    return ((size * 4 + lines) * 2 + asks).cast("int")


N_FEATURES = 16 * 4 * 2


@dataclass
class RoleModel:
    """Log probabilities: of a role after a role (the last row: at the start), and of features given a role."""

    moves: np.ndarray
    features: np.ndarray

    def steps(self, feature: int, markers: list[int | None]) -> list[np.ndarray]:
        """One (roles + 1) x roles matrix for the start of a turn and for every marked line after its first line."""
        n = len(ROLES)
        out = []
        for k, m in enumerate(markers):
            said = np.zeros(n) if m is None else np.where(np.arange(n) == m, np.log(SURE), np.log((1 - SURE) / (n - 1)))
            out.append((self.moves + self.features[:, feature] if k == 0 else np.full((n + 1, n), -np.log(n))) + said)
        return out


def fit_roles(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> RoleModel:
    """Counts over all given turns with a known role, add-one smoothed; they come to the driver as small tables.

    Features are smoothed with those of the same length alone, so that a rare combination is not decisive. Who
    follows whom is counted within stretches of 64 turns, so that no long conversation lies in one task.
    """
    role = F.coalesce(*[F.when(F.lower(role_col) == r, F.lit(k)) for k, r in enumerate(ROLES)])
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), role.alias("r"), turn_features(F.col(text_col)).alias("f"))
    rows = rows.where("r is not null")
    n = len(ROLES)
    counts = np.zeros((n, N_FEATURES))
    for x in rows.groupBy("r", "f").count().collect():
        counts[x.r, x.f] = x["count"]
    by_size = np.repeat(counts.reshape(n, 16, 8).sum(2), 8, axis=1) / 8
    smooth = counts + 2 * by_size / np.maximum(1, by_size.sum(1, keepdims=True)) + 0.5 / N_FEATURES
    features = np.log(smooth / smooth.sum(1, keepdims=True))
    stretch = F.floor(F.coalesce("t", F.lit(0)) / CHUNK)
    before = F.lag("r").over(Window.partitionBy("c", stretch).orderBy("t", "r"))
    pairs = rows.select("r", before.alias("b"), (stretch == 0).alias("first")).groupBy("r", "b", "first").count().collect()
    moves = np.full((n + 1, n), 0.1)
    for x in pairs:
        if x.b is not None or x["first"]:
            moves[n if x.b is None else x.b, x.r] += x["count"]
    moves = 0.98 * moves / moves.sum(1, keepdims=True) + 0.02 / n  # no order of roles is impossible
    moves[:, counts.sum(1) == 0] = 1e-9  # a role without examples needs a marker
    return RoleModel(np.log(moves), features)


def _markers(text: str) -> tuple[list[int | None], list[str]]:
    """Markers and contents of the parts of a turn; a part begins at the turn's start and at each marked line."""
    marks: list[int | None] = [None]
    cuts, ends = [0], [0]
    for m in MARKER.finditer(text):
        who = ROLE_OF[m[1].lower()]
        if not text[: m.start()].strip():
            marks, cuts, ends = [who], [m.start()], [m.end()]
        else:
            marks.append(who)
            cuts.append(m.start())
            ends.append(m.end())
    return marks, [text[a:b].strip("\n") for a, b in zip(ends, [*cuts[1:], len(text)], strict=True)]


def _after(best: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Max-plus product of an (m x roles) score with a step; from then on no role is the start."""
    return (best[:, :, None] + step[None, : best.shape[1], :]).max(1)


def _runs(batches: Iterator[pd.DataFrame], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with equal values in the first ``keys`` columns, with those values."""
    last, held = None, []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if held and row[:keys] != last:
                yield last, held
                held = []
            last = row[:keys]
            held.append(row)
    if held:
        yield last, held


def _batched(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == 4000:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


def best_path(steps: list[np.ndarray], entry: int, end: int | None = None) -> list[tuple[int, int]]:
    """(state before, state after) of every step on the best path from ``entry`` to ``end``, or to the best end."""
    at = np.full(len(ROLES) + 1, NONE)
    at[entry] = 0
    back = []
    for step in steps:
        total = at[:, None] + step[: len(at)]
        back.append(total.argmax(0))
        at = total.max(0)
    state, out = int(at.argmax()) if end is None else end, []
    for b in reversed(back):
        out.append((int(b[state]), state))
        state = int(b[state])
    return out[::-1]


def _product(steps: list[np.ndarray]) -> np.ndarray:
    best = steps[0]
    for step in steps[1:]:
        best = _after(best, step)
    return best


def _in_order(light: DataFrame) -> DataFrame:
    """``light`` with ``r``: the place (from 0) of every turn in its conversation.

    Turns go by number, null first, and turns that repeat by a hash of their texts. Conversations of more than
    ``LONG`` turns that have over one in 1000 of all turns, so fewer than 1000, are ranked in ranges over many tasks.
    """
    counts = light.groupBy("c").agg(F.count(F.lit(1)).alias("k_"))
    total = counts.agg(F.sum("k_").alias("all_"))
    long = F.broadcast(counts.where(F.col("k_") > LONG).crossJoin(total).where(F.col("k_") * 1000 > F.col("all_")).select("c"))
    inside = Window.partitionBy("c").orderBy(F.col("o").asc_nulls_first(), "hx", "rid")
    usual = light.join(long, "c", "left_anti").withColumn("r", F.row_number().over(inside) - 1)
    mixed = F.pmod(F.xxhash64("rid"), F.lit(1 << 24))
    rest = light.join(long, "c", "left_semi").withColumns({"od_": F.coalesce(F.col("o").cast("double"), F.lit(float("-inf"))), "hk_": F.shiftleft(F.shiftright("hx", 24), 24) + mixed})
    rest = ranked_prefix(rest, "od_", "hk_", [], descending=False, by=["c"], groups=1000).withColumn("r", F.col("rank") - 1)
    columns = ["c", "rid", "f", "marks", "r"]
    return usual.select(*columns).union(rest.select(*columns))


def parse_turns(
    turns: DataFrame, model: RoleModel, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """One row per part of a turn: conversation, turn, part (from 0), role, content and rendered.

    Roles are the most likely ones of the whole conversation by Viterbi over all its turns in their order. A
    speaker marker at the start of a line begins a new part and leaves the content. A conversation is cut into
    stretches of ``CHUNK`` turns, and those into runs of ``FOLD`` stretches: their score matrices are formed apart and
    multiplied along the conversation, then runs and stretches are decoded between the roles found at their ends. So a
    very long conversation is spread over tasks, and the result is still exact. Texts are not shuffled for that, only
    a small number and the markers of each turn; roles are joined to the texts at the end.

    A null or empty text is a part with empty content. A row with a null conversation id is a conversation of its
    own. Turn numbers are numbers; null ones come first, and turns that repeat a number come in the order of a hash
    of their texts. An empty table gives an empty one.
    """
    n = len(ROLES)
    base = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn_"), F.coalesce(F.col(text_col), F.lit("")).alias("x")
    ).withColumn("rid", F.monotonically_increasing_id())
    base = materialise(base, "turns")

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks = [[-1 if m is None else m for m in _markers(x)[0]] for x in b["x"]]
            yield pd.DataFrame({"rid": b["rid"], "c": b["c"], "t": b["t"], "hx": b["hx"], "f": b["f"], "marks": marks})

    own = F.when(F.col("conv").isNull(), F.concat(F.lit("r"), F.col("rid").cast("string"))).otherwise(F.concat(F.lit("c"), F.col("conv").cast("string")))
    light = base.select("rid", own.alias("c"), F.col("turn_").cast("string").alias("t"), F.xxhash64("x").alias("hx"), turn_features(F.col("x")).alias("f"), "x")
    light = light.mapInPandas(marked, "rid long, c string, t string, hx long, f int, marks array<int>")
    light = light.withColumn("o", F.col("t").cast(turns.schema[turn_col].dataType)).drop("t")
    placed = _in_order(light).select("c", F.floor(F.col("r") / CHUNK).cast("long").alias("s"), "r", "rid", "f", "marks")
    placed = materialise(placed, "placed")

    def steps_of(run: list[tuple]) -> Iterator[tuple[int, list[np.ndarray]]]:
        for _, _, _, rid, f, marks, *_ in run:
            yield rid, model.steps(f, [None if m < 0 else m for m in marks])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ((*key, _product([x for _, steps in steps_of(run) for x in steps]).tobytes()) for key, run in _runs(batches, 2))
        yield from _batched(found, ["c", "s", "m"])

    def matrix(m: bytes) -> np.ndarray:
        return np.frombuffer(m).reshape(n + 1, n)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ((*key, _product([matrix(row[3]) for row in run]).tobytes()) for key, run in _runs(batches, 2))
        yield from _batched(found, ["c", "b", "m"])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for (c,), run in _runs(batches, 1):
                for row, (a, z) in zip(run, best_path([matrix(x[2]) for x in run], n), strict=True):
                    yield c, row[1], a, z

        yield from _batched(found(), ["c", "b", "a", "z"])

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for (c, _), run in _runs(batches, 2):
                for row, (a, z) in zip(run, best_path([matrix(x[3]) for x in run], run[0][4], run[0][5]), strict=True):
                    yield c, row[2], a, z

        yield from _batched(found(), ["c", "s", "a", "z"])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for _, run in _runs(batches, 2):
                turns_ = list(steps_of(run))
                path = iter(best_path([x for _, steps in turns_ for x in steps], run[0][6], run[0][7]))
                for rid, steps in turns_:
                    yield rid, [next(path)[1] for _ in steps]

        yield from _batched(found(), ["rid", "roles"])

    mats = placed.repartition("c", "s").sortWithinPartitions("c", "s", "r").mapInPandas(score, "c string, s long, m binary")
    mats = materialise(mats.select("c", F.floor(F.col("s") / FOLD).cast("long").alias("b"), "s", "m"), "stretches")
    folded = mats.repartition("c", "b").sortWithinPartitions("c", "b", "s").mapInPandas(fold, "c string, b long, m binary")
    ends = folded.repartition("c").sortWithinPartitions("c", "b").mapInPandas(chain, "c string, b long, a int, z int")
    both = mats.join(ends, ["c", "b"]).select("c", "b", "s", "m", "a", "z").repartition("c", "b").sortWithinPartitions("c", "b", "s")
    bounds = both.mapInPandas(inside, "c string, s long, a int, z int")
    dealt = placed.join(bounds, ["c", "s"]).select("c", "s", "r", "rid", "f", "marks", "a", "z").repartition("c", "s").sortWithinPartitions("c", "s", "r")
    roles = dealt.mapInPandas(decode, "rid long, roles array<int>")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rid": b["rid"], "contents": [_markers(x)[1] for x in b["x"]]})

    contents = base.select("rid", "x").mapInPandas(split, "rid long, contents array<string>").select("rid", F.posexplode("contents").alias("part", "content"))
    named = F.array(*[F.lit(r) for r in ROLES])
    found = contents.join(roles, "rid").join(base.select("rid", "conv", "turn_"), "rid")
    found = found.withColumn("role", F.get(named, F.get("roles", F.col("part"))))
    return found.select(
        F.col("conv").alias(conv_col),
        F.col("turn_").alias(turn_col),
        "part",
        "role",
        "content",
        F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "content", F.lit("<|im_end|>\n")).alias("rendered"),
    )
