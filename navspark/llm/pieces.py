"""SentencePiece encoding with the source span of every piece, and decoding.

A text is normalised by longest prefixes through the model's compiled character map (``charmap``), which records where in the
source each normalised byte comes from.  The normalised text is cut into pieces by the model's own vocabulary and merges: the
``sentencepiece`` library does that with a copy of the model whose normaliser changes nothing.  Where no piece of the vocabulary
has the space mark behind another character, no merge crosses such a place, so a text's pieces are those of its
words; a word goes to the library once and is then found in a dictionary (two generations of CACHED words).  Adding up the
pieces' bytes gives their spans in the normalised text, and the recorded places give those in the source.

A piece's span is that of the library: from the place of its first byte to that of the byte behind it.  Of a character that
falls back to bytes, the last byte has its span and the others are empty at its start.

Decoding joins the pieces' texts: space marks are spaces, one at the start goes if the model adds one, bytes in a row are
read as UTF-8 with U+FFFD for each that is invalid, control pieces are empty.

Defined cases: a null text is the empty one, which has no pieces; rows are encoded each for itself, so repeated ones give the
same result, an empty table none, and extra columns pass through; texts of any length are taken whole (a word without a space is
one call of the library).  Models with user-defined pieces, with a denormaliser, or with a rule map of another kind are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .charmap import REPLACEMENT, SPACE, CharMap, Rules, normalize
from .common import carried, released, sliced, table

CACHED, LONG_WORD = 250_000, 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)  # kinds of pieces, as the model's format numbers them
SLICE = 1 << 18


def wire(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol-buffer message: numbers, and the bytes of all else."""
    at = 0

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            c = message[at]
            at += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, message[at : at + n]
            at += n


def wired(field: int, value: bytes | int) -> bytes:
    """A field of a protocol-buffer message."""

    def number(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return number(field << 3) + number(value) if isinstance(value, int) else number(field << 3 | 2) + number(len(value)) + value


class Model:
    """Pieces, rules and a library processor of a serialised model."""

    def __init__(self, proto: bytes):
        import sentencepiece

        top: dict[int, list] = {}
        for f, v in wire(proto):
            top.setdefault(f, []).append(v)
        trainer, spec = dict(wire(top.get(2, [b""])[-1])), dict(wire(top.get(3, [b""])[-1]))
        pieces = [dict(wire(p)) for p in top[1]]
        self.pieces = [p[1] for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if USER_DEFINED in kinds or dict(wire(top.get(5, [b""])[-1])).get(2):
            raise ValueError("models with user-defined pieces or a denormaliser are not supported")
        blob = spec.get(2, b"")
        none = CharMap(np.zeros(0, np.int64), np.zeros(0, np.uint8))
        self.rules = Rules(CharMap.of(blob) if blob else none, *[bool(spec.get(f, 1)) for f in (3, 4, 5)], bool(trainer.get(24, 0)))
        self.plain = not blob and not self.rules.squeeze and not self.rules.suffix
        as_is = b"".join([wired(1, b"identity"), wired(2, b""), wired(3, 0), wired(4, 0), wired(5, 0)])
        copy = b"".join(wired(f, v) for f, values in top.items() if f not in (3, 4, 5) for v in values) + wired(3, as_is)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=copy)
        self.unknown = kinds.index(UNKNOWN)
        self.by_word = SPACE in self.pieces and not any(re.search("[^▁]▁", p.decode()) for p in self.pieces)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.size = np.array([1 if k == BYTE else len(p) for k, p in zip(kinds, self.pieces)], np.int64)
        surface = trainer.get(44, b" \xe2\x81\x87 ")
        told = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: surface}
        self.surface = [told.get(k, lambda p: p.replace(SPACE, b" "))(p) for k, p in zip(kinds, self.pieces)]
        self.strip = self.rules.dummy_prefix or self.rules.squeeze
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.seen: dict[str, bytes] = {}  # words' ids as int32
        self.old: dict[str, bytes] = {}

    def normalize(self, texts: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
        return normalize(texts, self.rules)

    def cut(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each normalised text, and the bytes that each takes of it."""
        words = [WORD.findall(t) if self.by_word else [t] if t else [] for t in texts]
        if len(self.seen) > CACHED:
            self.old, self.seen = self.seen, {}
        seen, old = self.seen, self.old
        new, long = [], {}
        for w in set(chain.from_iterable(words)) - seen.keys():
            if w in old:
                seen[w] = old[w]
            else:
                new.append(w)
        for w, ids in zip(new, self.library.encode(new, num_threads=1) if new else []):
            (seen if len(w) <= LONG_WORD else long)[w] = np.array(ids, np.int32).tobytes()
        out = []
        for ws in words:
            found = map(seen.__getitem__, ws) if not long else (long[w] if w in long else seen[w] for w in ws)
            ids = np.frombuffer(b"".join(found), np.int32)
            sizes = self.size[ids]
            unknown = np.flatnonzero(ids == self.unknown)
            if len(unknown):
                sizes[unknown] = [
                    len(p.piece.encode()) for w in ws for p in self.library.encode(w, return_type="proto").pieces if p.id == self.unknown
                ]
            out.append((ids, sizes))
        return out

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, first source byte, and source byte behind the last, of each text's pieces."""
        normal = self.normalize(texts)
        out = []
        for (raw, places), (ids, sizes) in zip(normal, self.cut([raw.decode() for raw, _ in normal])):
            ends = np.cumsum(sizes)
            begins = ends - sizes
            fallen = self.is_byte[ids]
            if fallen.any():  # all bytes of a character begin where it does, and the last ends where it ends
                at = begins[fallen]
                flat = np.frombuffer(raw, np.uint8)
                lead = (flat & 0xC0) != 0x80
                first = np.maximum.accumulate(np.where(lead, np.arange(len(flat)), 0))
                begins[fallen] = first[at]
                last = np.r_[lead[1:], True][at]
                ends[fallen] = np.where(last, ends[fallen], first[at])
            out.append((ids, places[begins], places[ends]))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of pieces."""
        parts = list(map(self.surface.__getitem__, ids.tolist()))
        fallen = self.is_byte[ids]
        if fallen.any():
            edge = np.flatnonzero(np.diff(np.r_[False, fallen, False].astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                parts[a:b] = [_characters(b"".join(parts[a:b])), *[b""] * (b - a - 1)]
        if self.strip:
            for k, part in enumerate(parts):
                if fallen[k] or ids[k] == self.unknown:
                    if part:
                        break
                elif part.startswith(b" "):
                    parts[k] = part[1:]
                    if not self.rules.squeeze or parts[k]:
                        break
                elif part:
                    break
        return b"".join(parts)


WORD = re.compile("▁*[^▁]+|▁+")


def _characters(raw: bytes) -> bytes:
    """raw, with U+FFFD for each byte that is no part of a character."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError as e:
        return raw[: e.start] + REPLACEMENT + _characters(raw[e.start + 1 :])


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The worker's model, loaded once: its words serve all of the worker's tasks."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The input columns as ``row``; ids, starts and ends (source bytes) of the text's pieces, as arrays."""
    path = path or default_model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                got = m.encode(batch.column("text").to_pylist())
                lists = []
                for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64())):
                    offsets = np.cumsum([0, *(len(g[k]) for g in got)])
                    values = np.concatenate([g[k] for g in got]) if got else np.zeros(0)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind)))
                yield pa.RecordBatch.from_arrays([batch.column("row"), *lists], ["row", "ids", "starts", "ends"])

    rows = carried(docs)
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")]])
    return rows.mapInArrow(released(run), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """row and the text of ``ids``, an array that may be null."""
    path = path or default_model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(np.asarray(ids if ids is not None else [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "text"])

    schema = T.StructType([encoded.schema["row"], T.StructField("text", T.StringType())])
    return encoded.select("row", "ids").mapInArrow(released(run), schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and digests of what encode and decode give for each row, made in one pass: n_tokens, ids_sha256, decoded_sha256, the
    sha256 of all spans as ``start:end`` joined by commas, and the source bytes in spans."""
    path = path or default_model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                rows = []
                for ids, starts, ends in m.encode(batch.column("text").to_pylist()):
                    spans = np.stack([starts, ends], 1)
                    rows.append((
                        len(ids), hashlib.sha256(",".join(map(m.decimal.__getitem__, ids.tolist())).encode()).hexdigest(), hashlib.sha256(m.decode(ids)).hexdigest(),
                        hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest(), int((ends - starts).sum()),
                    ))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), KINDS)] if rows else [pa.array([], t) for t in KINDS]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *NAMES])

    rows = carried(docs.select("doc_id", "text"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(NAMES, KINDS)]])
    return rows.mapInArrow(released(run), schema).select("row.doc_id", *NAMES)


NAMES = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "span_bytes"]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
