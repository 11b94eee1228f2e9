"""The eleven queries against brute force, exact round trips or held-out accuracy on the small tables."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from terrapix.llm import queries as Q
from terrapix.llm.oracles import oracle_sql

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    ours = sorted(tuple(str(r[c]) for c in names) for r in Q.queries()[name](spark, SMALL).collect())
    assert ours == sorted(tuple(map(str, r)) for r in found.fetchall())


def test_op1_shards(spark, documents):
    rows = Q.op1_sharding(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    slots, sizes, place = defaultdict(list), defaultdict(int), {}
    for r in rows:
        data = (documents[r.doc_id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert place.setdefault(data, r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))
    mean, largest = sum(sizes.values()) / 40, max(len((t or "").encode()) + 16 for t in documents.values())
    assert max(sizes.values()) <= mean + largest


def test_op2_roles(spark):
    given = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    rows = Q.op2_chat(spark, SMALL).collect()
    assert {(r.conv_id, r.turn) for r in rows} == set(given)
    held = [r for r in rows if zlib.crc32(str(r.conv_id).encode()) % 5 == 0]
    assert sum(given[r.conv_id, r.turn].role == r.role for r in held) >= 0.9 * len(held)
    for r in rows:
        assert r.rendered.startswith(f"<|im_start|>{r.role}\n") and r.rendered.endswith("<|im_end|>\n")


def test_op3_recall_is_whole_here(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r.label for r in rows])
    links = ((x @ x.T >= 0.98) & (label[:, None] == label[None, :])).sum(1) - 1
    got = {r.vec_id: r.n_links for r in Q.op3_embeddings(spark, SMALL).collect()}
    assert all(got[r.vec_id] == n for r, n in zip(rows, links, strict=True))


def test_op4_held_out(spark):
    got = {r.doc_id: r for r in Q.op4_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.93 * len(held)


def test_op6_base_spans(spark, documents):
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    base = [("assign", f"({words})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)]
    for r in Q.op6_secret_scan(spark, SMALL).collect():
        text, spans = documents[r.doc_id] or "", []
        for k, (kind, pattern, least) in enumerate(base):
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[m.lastindex or 0]) >= least]
        named = ",".join(s for _, _, s in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(named.split(",")) - {""} <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


def test_op7_packs_every_token(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    pieces, sequences, total = defaultdict(dict), defaultdict(list), 0
    for r in Q.op7_packing(spark, SMALL).collect():
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text in documents.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k in range(len(pieces[doc])):
            r = pieces[doc][k]
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and (k == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
        total += at
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * -(-total // 2048) + 1


def test_op8_components(spark, documents):
    def plain(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = sorted(documents)
    prints = np.array([plain(documents[i]) for i in ids], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op8_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{int(p):016x}", int(c)) for i, p, c in zip(ids, prints, label, strict=True)}


def test_op10_against_word_windows(spark, documents):
    items = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = set()
    for doc, text in documents.items():
        words = re.findall(r"\w+", (text or "").lower())
        for item, own in items.items():
            n = len(own)
            if any(sum(a == b for a, b in zip(words[max(0, s) : s + n], own[max(0, -s) :], strict=False)) >= 0.8 * n for s in range(-n // 4, len(words) - n + n // 4 + 1)):
                want.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in Q.op10_decontamination(spark, SMALL).collect()}
    assert got == want


def test_pipeline_stages(spark, documents):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert len(P.STAGES) == 5
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SMALL)
        if k < 4:
            assert out.columns == columns, name
            rows = out.collect()
            assert 0 < len(rows) <= docs.count()
            docs = spark.createDataFrame(rows, out.schema)
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert P.run(spark, SMALL).count() > 0


def test_pipeline_on_nulls_repeats_extra_columns_and_nothing(spark, tmp_path):
    import corpus_pipeline as P

    good = " ".join(f"word{k} goes with other{k * 7 % 50}" for k in range(60))
    item = "a benchmark item of just ten words that must go"
    rows = [(1, good), (2, good), (3, good.replace("word9 ", "changed ")), (4, f"{good[:300]} {item} and so on"), (None, good[500:]), (5, None), (6, ""), (7, "x"), (7, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, rid int, row_ string, to int, key string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "n", 1, "r", 2, "k") for i, t in rows], schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (None, good), (2, None)], "item_id long, text string")
    for name, part in (("some", docs), ("none", docs.where("false"))):
        for table, df in (("documents", part), ("labels", labels), ("benchmark", bench)):
            df.write.parquet(str(tmp_path / name / f"{table}.parquet"))
    for _, stage in P.STAGES[1:4]:
        docs = stage(spark, docs, str(tmp_path / "some"))
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
    kept = [r.doc_id for r in docs.collect()]
    assert set(kept) <= {1, 2, 3, 5, 6, 7, None} and {1, None} <= set(kept) and 4 not in kept
    assert P.run(spark, str(tmp_path / "some")).count() > 0 and P.run(spark, str(tmp_path / "none")).count() == 0
