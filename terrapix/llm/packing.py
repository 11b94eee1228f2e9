"""Token pieces of documents and their packing into sequences by hierarchical residual best fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise, small_batches

CAPACITY = 2048
PART_ITEMS = 1 << 15
"""Items that one task packs in the first round."""
FAN = 8
"""Tree nodes that one node of the next round merges."""


class Encoder:
    """Ids of a byte-level BPE vocabulary; the same as the tokenizers library gives for its JSON form.

    ``ranks_path`` is the vocabulary as ranks. The special token's text becomes its id, as there.
    """

    def __init__(self, ranks_path: str, pattern: str, special: str = "<|endoftext|>", special_id: int = 50256) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("terrapix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special, self.special_id = special, special_id

    def __call__(self, text: str) -> list[int]:
        out = self.encoding.encode_ordinary((parts := text.split(self.special))[0])
        for part in parts[1:]:
            out = [*out, self.special_id, *self.encoding.encode_ordinary(part)]
        return out


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole capacities, after a shorter first piece if one is needed."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def token_pieces(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, ids): the token ids of every whole text and ``end_id``, as little-endian unsigned 32-bit
    numbers, in pieces of at most ``capacity``. A null text is an empty one and has the end id alone."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(ranks_path, pattern)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["t"], strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                at = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    rows.append((key, k, at, ids[at : at + n].tobytes()))
                    at += n
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("t"))  # as a float, an id would lose digits
    found = chosen.mapInPandas(work, "id string, piece int, start bigint, ids binary")
    return found.select(F.col("id").cast(kind).alias("id"), "piece", "start", "ids")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (bin of each item, its offset there, number of bins).

    Open bins are stacked by the room they have; a bit set of rooms in use gives the tightest that suffices.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = n_bins = 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n_bins = capacity, n_bins, n_bins + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins, offsets, n_bins


def _merge_node(pdf: pd.DataFrame, capacity: int, fan: int, full: int) -> pd.DataFrame:
    """One tree node: pack its underfull bins as items; mark which of the results go on to the next round.

    In what best fit leaves, one bin at most is half empty, so a node of the next round makes fewer merges than
    it has children; ``fan`` bins of each fill are all that it can use. The others are finished here.
    """
    pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
    to, at, n = best_fit(pdf["fill"].to_numpy(), capacity)
    order = np.lexsort((at, to))
    rows, last = [], -1
    for i in order.tolist():
        member = [(m["bin"], m["shift"] + int(at[i])) for m in pdf["members"][i]]
        if to[i] != last:
            rows.append([int(pdf["bin"][i]), 0, []])
            last = to[i]
        rows[-1][1] += int(pdf["fill"][i])
        rows[-1][2] += member
    seen: dict[int, int] = {}
    out = []
    for b, fill, members in rows:
        seen[fill] = seen.get(fill, 0) + 1
        out.append((b, fill, [{"bin": x, "shift": s} for x, s in members], fill < full and seen[fill] <= fan))
    return pd.DataFrame(out, columns=["bin", "fill", "members", "open"])


def pack(items: DataFrame, length_col: str = "length", capacity: int = CAPACITY, part_items: int = PART_ITEMS, fan: int = FAN, nearly_full: float = 0.99) -> DataFrame:
    """``items`` with sequence_id and offset: as few sequences of ``capacity`` as repeated best fit needs.

    ``items`` must be a stored table whose lengths lie in 1..capacity. Tasks of about ``part_items`` items pack
    locally (dealt by a hash of the whole row, so a run task gives the same again); bins that are nearly full are
    done. The others are items of the next round, in which a task merges ``fan`` nodes, until one node is left;
    each node hands on a bounded number of bins. Sequences have any number; offsets are gapless from 0.
    Repeated rows are packed as often as they come; an empty table gives an empty one. Columns of ``items`` that are
    called sequence_id or offset are replaced.
    """
    spark, items = items.sparkSession, items.drop("sequence_id", "offset")
    parts = max(1, -(-items.count() // part_items))
    schema = T.StructType([*items.schema.fields, T.StructField("__bin", T.LongType()), T.StructField("__offset", T.LongType())])
    names = items.columns

    def local(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns(["__part"]).sort_by([(n, "ascending") for n in names])
        b, at, _ = best_fit(table[length_col].to_numpy(), capacity)
        return table.append_column("__bin", pa.array((key[0].as_py() << 32) + b)).append_column("__offset", pa.array(at))

    dealt = items.withColumn("__part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("long"))
    placed = materialise(dealt.groupBy("__part").applyInArrow(local, schema), "placed")
    moves = spark.createDataFrame([], "__bin long, __to long, __shift long")
    if parts > 1:
        full = int(capacity * nearly_full)
        state = placed.groupBy(F.col("__bin").alias("bin")).agg(F.sum(length_col).cast("long").alias("fill"))
        state = state.where(F.col("fill") < full).select(
            "bin", "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members")
        )
        step, merged = 1, []
        while step < parts:
            step *= fan
            node = F.shiftright("bin", 32) / F.lit(step)
            done = state.withColumn("node", F.floor(node)).groupBy("node").applyInPandas(
                lambda pdf: _merge_node(pdf.drop(columns="node"), capacity, fan, full),
                "bin long, fill long, members array<struct<bin:long,shift:long>>, open boolean",
            )
            done = materialise(done, "merged")
            last = step >= parts
            merged.append(done if last else done.where("not open"))
            state = done.where("open").drop("open")
        for x in merged:
            joined = x.where(F.size("members") > 1).select(F.col("bin").alias("__to"), F.explode("members").alias("m"))
            moves = moves.union(joined.select(F.col("m.bin").alias("__bin"), "__to", F.col("m.shift").alias("__shift")))
    return placed.join(moves, "__bin", "left").select(
        *names,
        F.coalesce("__to", "__bin").alias("sequence_id"),
        (F.col("__offset") + F.coalesce("__shift", F.lit(0))).alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Without ``with_ids`` the ids stay behind, and only lengths and checksums are stored and shuffled.
    """
    pieces = token_pieces(docs, ranks_path, pattern, capacity, end_id, id_col, text_col)
    kept = pieces.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        *(["ids"] if with_ids else []),
    )
    return pack(materialise(kept, "pieces"), "length", capacity)
