"""SentencePiece encoding that keeps, for every piece, the bytes of the source it stands for.

A text is normalised by longest-prefix matches in the model's compiled character map (a double-array trie); each
normalised byte remembers the source byte it came from. A model without a map (as the public one that the query uses) only
has its blanks marked, which is done at once, with the same alignment; the trie runs for models that have one. The normalised text is segmented by the library under a copy
of the model whose own normaliser does nothing, and the piece boundaries are projected through that alignment.

A worker holds the model and one text's ids at a time; a text is encoded whole, and its ids are decoded by the library.

Null texts count as empty: no ids, the hash of nothing. Nothing is cut off however long the text is. Repeated rows
give repeated results; an empty table gives an empty table; columns besides the id and the text are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.arrow import bounded, pieces

SPACE = "▁"
def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object, bytes]]:
    """Number, value and raw bytes of each field of a serialized message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value, data[start:at]


def _delimited(number: int, value: bytes) -> bytes:
    out, size = bytearray([number << 3 | 2]), len(value)
    while size >= 0x80:
        out.append(size & 0x7F | 0x80)
        size >>= 7
    out.append(size)
    return bytes(out) + value


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 and the strings that its values point at."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes | None, int]:
        """Replacement and length of the longest key that the data hold at this place; None if no key matches."""
        units = self.units
        if not units:
            return None, 0
        found, length = -1, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found, length = units[node] & 0x7FFFFFFF, i + 1 - at
        if found < 0:
            return None, 0
        return self.strings[found : self.strings.index(b"\0", found)], length


@dataclass
class Encoded:
    ids: list[int]
    pieces: list[str]
    spans: list[tuple[int, int]]  # source bytes of each piece


class Codec:
    """Encodes and decodes with one model. model: the bytes of a SentencePiece model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        fields = list(_fields(model))
        spec = dict((n, v) for n, v, _ in _fields(next((v for n, v, _ in fields if n == 3), b"")))
        trainer = dict((n, v) for n, v, _ in _fields(next((v for n, v, _ in fields if n == 2), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        plain = _delimited(3, _delimited(1, b"identity") + b"\x18\0\x20\0\x28\1")
        bare = b"".join(raw for n, _, raw in fields if n not in (3, 4, 5)) + plain
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare)
        pieces = [dict((n, v) for n, v, _ in _fields(v)) for n, v, _ in fields if n == 1]
        names = [p.get(1, b"").decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]  # 2 unknown, 3 control, 6 byte
        self.size_of = np.array([1 if k == 6 else len(x.encode()) for k, x in zip(kinds, names, strict=True)], np.int64)
        self.unknown = np.array([k == 2 for k in kinds])
        self.digits = np.array([str(i) for i in range(len(pieces))], object)

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes, with the end of the source last."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and self.escape and not self.suffix:
            source = np.frombuffer(data, np.uint8)
            align = np.repeat(np.arange(len(data)), np.where(source == 0x20, 3, 1))
            head = 3 if self.prefix else 0
            align = np.concatenate([np.zeros(head, np.int64), align, [len(data)]])
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), align
        mark = SPACE.encode() if self.escape else b" "
        parts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            new, used = self.map.longest(data, at)
            if new is None:
                used = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new = data[at : at + used]
            parts.append((new, at, at + used))
            at += used
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
            if not parts:
                return "", np.array([len(data)])
        out, align = bytearray(), []

        def put(what: bytes, place: int) -> None:
            out.extend(what)
            align.extend([place] * len(what))

        if self.prefix and not self.suffix:
            put(mark, parts[0][1])
        after_space = self.squeeze
        consumed = parts[0][1]
        for new, begin, end in parts:
            while after_space and new.startswith(b" "):
                new = new[1:]
            if new:
                for byte in new:
                    put(mark if byte == 0x20 else bytes([byte]), begin)
                after_space = new.endswith(b" ")
            consumed = end
            after_space = after_space and self.squeeze
        if self.squeeze:
            while out.endswith(mark):
                consumed = align[len(out) - len(mark)]
                del out[-len(mark) :], align[-len(mark) :]
        if self.prefix and self.suffix:
            put(mark, consumed)
        return out.decode(), np.array([*align, consumed])

    def segment(self, normal: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a normalised text, and how many of its bytes each stands for."""
        if not normal:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.asarray(self.bare.encode_as_numpy(normal), np.int64)
        if self.unknown[ids].any():
            return ids, np.array([len(p.surface.encode()) for p in self.bare.encode(normal, return_type="proto").pieces], np.int64)
        return ids, self.size_of[ids]

    def digest(self, text: str | None) -> tuple[int, bytes, bytes, bytes]:
        """Number of ids, digests of the ids, of their decoding, and of the spans of source bytes (begin and end of each
        piece as little-endian 64-bit numbers)."""
        normal, align = self.normalize(text or "")
        ids, sizes = self.segment(normal)
        ends = np.cumsum(sizes)
        spans = align[np.stack([ends - sizes, ends], 1)].astype("<i8") if len(ids) else align[:0]
        parts = ",".join(self.digits[ids].tolist()).encode(), self.library.decode(ids.tolist()).encode(), spans.tobytes()
        return len(ids), *(hashlib.sha256(x).digest() for x in parts)

    def encode(self, text: str | None) -> Encoded:
        """Ids and pieces of a text with the span of source bytes behind each; the pieces of one character's bytes
        split its span at byte boundaries."""
        normal, align = self.normalize(text or "")
        ids, sizes = self.segment(normal)
        ends = np.cumsum(sizes)
        spans = [(int(align[e - s]), int(align[e])) for e, s in zip(ends, sizes, strict=True)]
        return Encoded(ids.tolist(), [self.library.id_to_piece(i) for i in ids.tolist()], spans)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The worker's codec for this model, made once."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: id, n_tokens, ids_sha256, decoded_sha256, spans_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in pieces(batches):
            rows = [c.digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].hex() for r in rows], pa.string()), pa.array([r[2].hex() for r in rows], pa.string()), pa.array([r[3].hex() for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return bounded(docs).select(id_col, text_col).mapInArrow(run, schema)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's pieces in order: id, pieces array<struct<id, piece, begin, end>> with byte offsets in the source."""
    kind = docs.schema[id_col].dataType.simpleString()
    piece = pa.list_(pa.struct([("id", pa.int32()), ("piece", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in pieces(batches):
            out = []
            for text in batch.column(1).to_pylist():
                e = c.encode(text)
                out.append([{"id": i, "piece": p, "begin": b, "end": n} for i, p, (b, n) in zip(e.ids, e.pieces, e.spans, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, piece)], names=["doc_id", "pieces"])

    return bounded(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, pieces array<struct<id:int,piece:string,begin:long,end:long>>")


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of arrays of ids; a null array gives an empty text."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")
