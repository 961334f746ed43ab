"""Byte-level BPE through a sentencepiece model that is serialised here from a rank file.

The model message is written directly, field by field: every token becomes a piece whose bytes are
mapped to printable characters, scored by its negative rank, under identity normalisation with no dummy
prefix and no white-space handling. sentencepiece then merges the best-scored pair first, leftmost on
ties, which is the merge order of the ranks. Texts are cut by the pattern first and each match is encoded
by itself; ids are decoded by the inverse mapping.

Matches repeat, so each task keeps a dictionary of matches already encoded, dropped when it would hold more than
``CACHE`` entries or ``CACHE_CHARS`` characters besides those of the text at hand. Texts are worked on one at a time and whole. A null text counts as empty: no ids, the
digests of nothing. Repeated rows and null ids are kept as they are; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Encoded matches that a task remembers at most, and characters in them.
CACHE, CACHE_CHARS = 400_000, 8_000_000
#: What \s stands for in the pattern's own engine: the characters with the property White_Space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    assert [r for r, _ in pairs] == list(range(len(pairs))), "ranks with gaps"
    return [t for _, t in pairs]


def byte_characters() -> list[str]:
    """A printable character for each byte: its Latin-1 character where that is printable and no space,
    else the next free one from U+0100 on.
    """
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model message for byte-level tokens in rank order; the unknown piece comes last."""
    chars = byte_characters()
    unknown = len(tokens)
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -float(r))) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2)))
    none = (1 << 64) - 1  # ids of pieces that the model has not
    trainer = _flag(3, 2) + _flag(4, unknown + 1) + _flag(40, unknown) + _flag(41, none) + _flag(42, none) + _flag(43, none)
    normaliser = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to packed little-endian unsigned 32-bit ids, and decodes them."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = tokens
        spaced = pattern.replace("[^\\s", f"[^{SPACES}").replace("\\S", f"[^{SPACES}]").replace("\\s", f"[{SPACES}]")
        self.split = regex.compile(spaced).findall
        self.chars = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters of the known matches

    def encode(self, text: str) -> bytes:
        """``text`` holds no lone surrogates: it comes from UTF-8."""
        parts, known = self.split(text), self.known
        new = [p for p in set(parts) if p not in known]
        if new:
            if len(known) + len(new) > CACHE or self.held + sum(map(len, new)) > CACHE_CHARS:
                known.clear()
                self.held = 0
                new = list(set(parts))
            self.held += sum(map(len, new))
            mapped = [p.encode().decode("latin-1").translate(self.chars) for p in new]
            for i in range(0, len(new), 4096):
                for p, ids in zip(new[i : i + 4096], self.model.encode(mapped[i : i + 4096], num_threads=1)):
                    known[p] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


def encode_decode(docs: DataFrame, tokens: list[bytes], pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the packed ids where ``keep_ids`` asks for them."""
    shipped = docs.sparkSession.sparkContext.broadcast((serialise_model(tokens), tokens))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *[("ids", pa.binary())] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shipped.value, pattern)
        for b in rows_of(batches, 256):
            out: list[tuple] = []
            for t in b.column("text"):
                ids = codec.encode(t.as_py() or "")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), ids))
            columns = [b.column("doc_id"), *(pa.array([r[i] for r in out], f[1]) for i, f in enumerate(fields[1:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
