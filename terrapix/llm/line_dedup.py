"""Removal of lines that several documents share; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise
from .skew import hot_keys, salted_join

BLANKS = " \t\n\x0b\x0c\r"


def _ascii_lower(col: Column) -> Column:
    """A-Z to a-z only. ``lower`` does just that, and faster, where a text is all ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key, as two longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 2, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    r"""``docs`` with the text of every row rid of lines that at least ``min_docs`` documents hold.

    A text is split at ``\n``; a line's key is the line without blanks at both ends and with A-Z lower-cased.
    Keys of at least ``min_chars`` code points that ``min_docs`` documents hold lose all their lines, except in
    the smallest id that holds the key. Adds n_lines (before) and n_dropped, in
    place of columns of those names; other columns stay as they are.
    A null or empty text is one empty line and stays an empty text. Ids may be of any type that has an order. Rows
    that repeat an id are one document. Null ids are together one document that comes after all others. An empty
    table gives an empty one.

    Lines travel as 128-bit hashes with positions, never as texts: counts per hash are pre-aggregated before
    the shuffle, and the lines of a hot hash are salted where they meet its count.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), text.alias("body")
    )
    lines = rows.select("doc", "row", F.posexplode(F.split(_ascii_lower(F.col("body")), "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "row", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(
        F.char_length("key") >= min_chars
    )
    hashed = keys.select("doc", "row", "pos", *_hashes(F.col("key")))
    if min_docs == 2:  # two documents at least: the least id is not the greatest, or there is a null beside it
        shared = hashed.groupBy("h1", "h2").agg(
            F.min("doc").alias("keeper"), F.max("doc").alias("other"), F.max(F.col("doc").isNull()).alias("more"), F.count(F.lit(1)).alias("n")
        )
        shared = shared.where("keeper is not null and (keeper < other or more)").select("h1", "h2", "keeper", "n")
    else:
        each = hashed.groupBy("h1", "h2", "doc").agg(F.count(F.lit(1)).alias("k"))
        shared = each.groupBy("h1", "h2").agg(F.min("doc").alias("keeper"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))
        shared = shared.where(F.col("docs") >= min_docs).drop("docs")
    shared = materialise(shared, "shared")
    gone = (
        salted_join(hashed, shared.drop("n"), ["h1", "h2"], hot_keys(shared, ["h1", "h2"], "n"), "doc")
        .where("not (doc <=> keeper)")
        .groupBy("doc", "row")
        .agg(F.collect_set("pos").alias("gone"))
    )
    new = ("n_lines", "n_dropped")
    whole = docs.select(
        F.struct(*docs.columns).alias("row_in"),
        F.col(id_col).alias("doc"),
        F.xxhash64(text).alias("row"),
        F.split(text, "\n", -1).alias("lines"),
    )
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i)
    )
    plain = F.coalesce(F.col("row_in")[text_col], F.lit(""))
    gone = gone.select(F.col("doc").alias("doc_"), F.col("row").alias("row_"), "gone")
    return whole.join(gone, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("row") == F.col("row_")), "left").select(
        *[
            (F.when(F.col("gone").isNull(), plain).otherwise(F.array_join(kept, "\n")) if c == text_col else F.col("row_in")[c]).alias(c)
            for c in docs.columns
            if c not in new
        ],
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )
