"""The queries op1 to op13: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, line_dedup, packing, pieces, quality, secrets, sharding, simhash, tokens, trie, warc, whitening
from .scratch import materialise, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by equal bytes."""
    found = sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)
    return found.select(
        "doc_id",
        F.col("n_bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the role found without looking at the given one; roles are learnt from four fifths."""
    turns = _table(spark, sf_dir, "conversations")
    model = chat.fit_roles(turns.where(~quality.held_out("conv_id")))
    return chat.parse_turns(turns.drop("role"), model).select("conv_id", "turn", "part", "role", "rendered")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    found = embeddings.link_embeddings(_table(spark, sf_dir, "embeddings"), 0.98)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), "quality")
    return quality.score_quality(docs.select("doc_id", "text", "n_chars"), model).select(
        "doc_id",
        quality.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without the lines that others hold too."""
    found = line_dedup.drop_shared_lines(_table(spark, sf_dir, "documents"), min_docs=2, min_chars=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base kinds counted and digested, all kinds listed."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    text = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(text(own).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 tokens, packed."""
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), *tokens.public_byte_bpe(), capacity=2048, end_id=0, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and assembled by capture."""
    path = scratch_path(spark, "archive")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(materialise(warc.read_warc(spark, path, with_payload=False), "records"))
    again = F.col("capture.record_type") == "revisit"
    return captures.select(
        F.element_at("metadata.fields", "page-id").cast("long").alias("page_id"),
        F.when(again, F.col("origin.payload_bytes")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("origin.computed_digest")).otherwise(F.col("capture.computed_digest")).alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.when(again, F.element_at("origin.fields", "page-id").cast("long")).alias("refers_to"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 0.8)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened coordinates on the first 32 components."""
    found = whitening.whiten_embeddings(_table(spark, sf_dir, "embeddings"), 32)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, whose first turns are those of the conversation with the next lower multiple of 5."""
    placed = trie.in_order(trie.turn_keys(_table(spark, sf_dir, "conversations")))
    c = F.col("c")
    mixed = trie.graft_heads(placed, c - c % 5, F.crc32(c.cast("string")) % 9, 8)
    return trie.trie_nodes(mixed, placed.select("c").distinct())


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, of the byte spans of its pieces and of the decoded text."""
    model = pieces.read_model(tokens.public_piece_bpe())
    return pieces.encode_texts(_table(spark, sf_dir, "documents"), model, with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
