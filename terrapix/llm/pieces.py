"""Encoding by a sentencepiece model with the byte span of every piece in the original text, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁".encode()
"""How a space is written inside pieces."""
CHUNK_CHARS = 1 << 18
"""A longer text is encoded in parts, cut where no piece of the vocabulary can lie across."""
BATCH_CHARS = 1 << 20
CONTROL, USER_DEFINED, BYTE = 3, 4, 6


class CharacterMap:
    """A compiled map of character sequences to others: a double array over UTF-8 bytes, and the texts that it leads to.

    A unit of the array holds a label (low byte and the top bit), whether a value follows (bit 8) and how far its
    children are (bits 10 and up, times 256 if bit 9 is set), all relative by exclusive or.
    """

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``data`` has at ``at``."""
        node, found = self._children(self.units[0]), None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._children(unit)
            if unit & 0x100:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.texts[start : self.texts.index(b"\0", start)]

    def heads(self) -> set[bytes]:
        """The first characters of all keys."""
        out: set[bytes] = set()
        todo = [(b"", self._children(self.units[0]))]
        while todo:
            head, node = todo.pop()
            for byte in range(1, 256):
                child = node ^ byte
                if child < len(self.units) and self.units[child] & 0x800000FF == byte:
                    grown = head + bytes([byte])
                    if len(grown) == _width(grown[0]):
                        out.add(grown)
                    else:
                        todo.append((grown, child ^ self._children(self.units[child])))
        return out


def _width(lead: int) -> int:
    """Bytes of a UTF-8 character by its first byte."""
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    """Text to the form that pieces are matched in, and for each of its bytes the place in the original that it is from.

    The longest key of the character map at a place is replaced; characters without one stay. Then the options of the
    model hold: a space put in front, spaces squeezed, spaces written as a mark.
    """

    def __init__(self, spec, user_symbols: list[bytes], as_suffix: bool = False) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.squeeze, self.front, self.escape, self.as_suffix = spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces, as_suffix
        self.symbols = sorted(user_symbols, key=len, reverse=True)
        heads = (self.map.heads() if self.map else set()) | {s[: _width(s[0])] for s in self.symbols}
        self.hit = re.compile(b"|".join(re.escape(h) for h in sorted(heads))) if heads else None

    def _at(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        for s in self.symbols:
            if data.startswith(s, at):
                return len(s), s
        return self.map.longest(data, at) if self.map else None

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """``data`` with its longest keys replaced, and the place that every byte comes from."""
        if self.hit is None:
            return data, np.arange(len(data))
        parts, places, done, at = [], [], 0, 0
        while m := self.hit.search(data, at):
            found = self._at(data, m.start())
            if found is None:
                at = m.start() + _width(data[m.start()])
                continue
            width, new = found
            at = m.start() + width
            parts += [data[done : m.start()], new]
            places += [np.arange(done, m.start()), np.full(len(new), m.start())]
            done = at
        parts.append(data[done:])
        places.append(np.arange(done, len(data)))
        return b"".join(parts), np.concatenate(places)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normal form of UTF-8 ``data`` and, for each of its bytes and for its end, the place in ``data``."""
        mapped, place = self._mapped(data)
        raw = np.frombuffer(mapped, np.uint8)
        end = len(data)
        if self.squeeze:
            space = raw == 32
            keep = ~(space & np.insert(space[:-1], 0, True)[: len(raw)])
            raw, place = raw[keep], place[keep]
        if not len(raw):
            return b"", np.array([end])
        if self.front and not self.as_suffix:
            raw, place = np.insert(raw, 0, 32), np.insert(place, 0, place[0])
        space = MARK if self.escape else b" "
        out, place = raw.tobytes().replace(b" ", space), np.append(np.repeat(place, np.where(raw == 32, len(space), 1)), end)
        while self.squeeze and out.endswith(space):
            out, place = out[: -len(space)], place[: len(out) - len(space) + 1]
        if self.front and self.as_suffix:
            out, place = out + space, np.append(place, [place[-1]] * len(space))
        return out, place


class Encoder:
    """The ids of the sentencepiece library, with the spans of the original bytes that their pieces stand for."""

    def __init__(self, model: bytes, chunk_chars: int = CHUNK_CHARS) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb2

        proto = pb2.ModelProto()
        proto.ParseFromString(model)
        self.library = SentencePieceProcessor(model_proto=model)
        text = lambda p: b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.encode()
        self.written = [text(p) for p in proto.pieces]
        self.widths = np.array([len(x) for x in self.written])
        self.unknown = self.library.unk_id()
        spec, suffix = proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix
        self.normalize = Normalizer(spec, [p.piece.encode() for p in proto.pieces if p.type == USER_DEFINED], suffix)
        self.chunk_chars = chunk_chars
        inner = re.compile("[^▁]▁")
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not (spec.remove_extra_whitespaces or spec.precompiled_charsmap or suffix)
        self.splits = plain and proto.trainer_spec.model_type == 2 and not any(inner.search(p.piece) for p in proto.pieces)

    def _parts(self, text: str) -> Iterator[str]:
        """``text`` in parts of about ``chunk_chars`` characters. A part ends before a single space, which the next one
        gets back as the space that is put in front of it; merges of BPE never cross such a place, as no piece does."""
        at = 0
        while self.splits and len(text) - at > self.chunk_chars:
            m = SINGLE.search(text, at + self.chunk_chars)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def ids(self, texts: list[str]) -> list[list[int]]:
        parts = [list(self._parts(t)) for t in texts]
        flat = iter(self.library.encode([p for x in parts for p in x], num_threads=1))
        return [[i for _ in x for i in next(flat)] if len(x) > 1 else next(flat) for x in parts]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte in UTF-8 ``text`` of every piece; the pieces must spell the normal form of the text."""
        data = text.encode()
        normal, place = self.normalize(data)
        if self.unknown in ids:
            return self._spans_by_library(text)
        if b"".join([self.written[i] for i in ids]) != normal:
            raise ValueError("the pieces do not spell the normal form of the text")
        cuts = np.concatenate([[0], np.cumsum(self.widths[np.asarray(ids, np.int64)])]).astype(np.int64)
        return place[cuts[:-1]], place[cuts[1:]]

    def _spans_by_library(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Spans where a piece stands for characters that the vocabulary lacks, whose length the id does not tell."""
        pieces = self.library.encode(text, return_type="proto").pieces
        return np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


SINGLE = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


@lru_cache(maxsize=4)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _little(values: list[int]) -> bytes:
    return np.asarray(values, "<u4").tobytes()


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``BATCH_CHARS`` characters, so that their ids are never held for a whole batch."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def encode_texts(
    docs: DataFrame, model: bytes, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """The id of every row with n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids`` also ids, starts and stops.

    ``ids`` are those of the sentencepiece library for the whole text, with the begin and end ids if wanted.
    ``starts`` and ``stops`` (end exclusive) are the bytes of the original text in UTF-8 that a piece stands for: the
    pieces spell the normal form, each byte of which knows the place that it comes from. A space put in front has no
    bytes of its own, a byte piece has its byte (of a replaced character: those of the key), begin and end ids are empty
    spans at the text's ends. ``spans_sha256`` digests starts and stops, one after the other, as unsigned
    64-bit little-endian integers. ``decoded_sha256`` is of the library's decoding of the ids.

    A null text counts as empty: it has the begin and end ids only. Repeated rows and null ids are rows like others,
    and extra columns are not looked at; an empty table gives an empty one. A text is held by one task.
    """
    ids_type = docs.schema[id_col].dataType.simpleString()
    fixed = "n_tokens long, ids_sha256 string, spans_sha256 string, decoded_sha256 string"
    kind = f"key_ {ids_type}, {fixed}" + (", ids array<int>, starts array<long>, stops array<long>" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("key_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    names = [x.split()[0] for x in fixed.split(", ")] + (["ids", "starts", "stops"] if with_ids else [])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model)
        first, last = [encoder.library.bos_id()] if begin else [], [encoder.library.eos_id()] if end else []
        for batch in batches:
            for at, texts in _groups(batch["text_"].tolist()):
                out = []
                for text, ids in zip(texts, encoder.ids(texts), strict=True):
                    starts, stops = encoder.spans(text, ids)
                    size = len(text.encode())
                    starts = np.concatenate([[0] * len(first), starts, [size] * len(last)]).astype(np.int64)
                    stops = np.concatenate([[0] * len(first), stops, [size] * len(last)]).astype(np.int64)
                    ids = [*first, *ids, *last]
                    spans = np.concatenate([starts, stops]).astype("<u8").tobytes()
                    row = [len(ids), *[hashlib.sha256(x).hexdigest() for x in (_little(ids), spans, encoder.decode(ids).encode())]]
                    out.append([*row, ids, starts, stops] if with_ids else row)
                done = pd.DataFrame(out, columns=names)
                done.insert(0, "key_", batch["key_"].iloc[at : at + len(texts)].to_numpy())
                yield done

    return _plain_ids(rows, kind, work).withColumnRenamed("key_", id_col)


def _plain_ids(rows: DataFrame, kind: str, work) -> DataFrame:
    """``rows`` through ``work``, with long ids beside nulls carried as texts, so that they lose no digits."""
    key = rows.schema["key_"].dataType
    asked = rows.withColumn("key_", F.col("key_").cast("string"))
    found = asked.mapInPandas(work, re.sub(r"^key_ [^,]+", "key_ string", kind))
    return found.withColumn("key_", F.col("key_").cast(key))


def decode_ids(rows: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the library's decoding of their ids in ``out_col``; null ids give a null text."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        encoder = _encoder(model)
        return column.map(lambda ids: None if ids is None else encoder.decode([int(i) for i in ids]))

    return rows.withColumn(out_col, decoded(F.col(ids_col)))
