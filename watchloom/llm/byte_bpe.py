"""Byte-level BPE encoding and decoding by a sentencepiece model that is serialised from the vocabulary.

Method
------
1. The ranks (token bytes -> rank) become a sentencepiece model file, written field
   by field in the protocol-buffer wire format: piece 0 is the unknown piece, piece
   rank + 1 is the token with each byte as one character (``BASE`` + byte, so no
   byte looks like white space), scored by the negative rank; the model type is BPE
   and the normaliser is the identity without added, removed or escaped blanks.
   Sentencepiece then merges the adjacent pair with the best score, the leftmost of
   equals: the lowest rank first.
2. A text is cut into pre-tokens by the pattern; each is mapped to such characters
   and encoded by itself.  A pre-token that is a token is that token, whether or not
   merges lead to it.  Pre-tokens are remembered by a worker, up to ``REMEMBERED``.
3. Decoding maps each id back to its piece and each character to its byte.

Nothing is shuffled.  Ids travel as little-endian unsigned 32-bit numbers in a
binary column.

Defined results: null and empty texts have no ids and decode to no bytes.  Rows that
repeat a doc_id, and rows without one, are rows of their own.  Encoding and decoding
give back the text's UTF-8 bytes exactly; a piece of text of any length is encoded
whole.  An empty table gives no rows.  Further columns are not looked at.  Ids that
the vocabulary lacks are an error in decoding.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.textops import pieces, utf8

#: The character of byte 0; the others follow.
BASE = 0x100
#: Pre-tokens that a worker remembers (about 200 bytes each), and the longest of them in characters.
REMEMBERED, LONGEST = 250_000, 64
_MAPPED = {b: BASE + b for b in range(256)}
#: Bytes of texts that are cut into pre-tokens at a time; these are Python strings of some 60 bytes each.
SLICE = 1 << 20


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def number(field: int, value: int) -> bytes:
    return varint(field << 3) + varint(value)


def message(field: int, body: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(body)) + body


def mapped(token: bytes) -> str:
    """Each byte as one character."""
    return token.decode("latin-1").translate(_MAPPED)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - BASE for c in piece)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of a base64 token and a rank."""
    with open(path, "rb") as f:
        rank = {base64.b64decode(token): int(n) for token, n in (line.split() for line in f if line.strip())}
    if sorted(rank.values()) != list(range(len(rank))):
        raise ValueError("ranks have to be 0, 1, 2, ...")
    if any(bytes([b]) not in rank for b in range(256)):
        raise ValueError("each byte has to be a token")
    return sorted(rank, key=rank.__getitem__)


def serialised(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of the tokens: pieces and scores, the trainer's type and ids, the normaliser."""
    # Fixed values of the format: fields 1 pieces (1 text, 2 score, 3 type), 2 trainer (3 model type, 40-43 ids), 3 normaliser
    # (1 name, 3 add a blank, 4 remove blanks, 5 escape blanks); piece type 2 is unknown, 1 is normal; model type 2 is BPE.
    minus_one = (1 << 64) - 1
    out = [message(1, message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + number(3, 2))]
    for rank, token in enumerate(tokens):
        out.append(message(1, message(1, mapped(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + number(3, 1)))
    out.append(message(2, number(3, 2) + number(4, len(tokens) + 1) + number(40, 0) + number(41, minus_one) + number(42, minus_one) + number(43, minus_one)))
    out.append(message(3, message(1, b"identity") + number(3, 0) + number(4, 0) + number(5, 0)))
    return b"".join(out)


@lru_cache(maxsize=4)
def model(path: str):
    """(processor, the bytes of each id as its piece says, token -> its id as bytes); made once a worker."""
    from sentencepiece import SentencePieceProcessor

    tokens = read_ranks(path)
    processor = SentencePieceProcessor(model_proto=serialised(tokens))
    back = [unmapped(processor.id_to_piece(i)) for i in range(1, processor.get_piece_size())]
    return processor, back, {mapped(t): struct.pack("<I", i) for i, t in enumerate(tokens)}


class Encoder:
    """texts -> ids as little-endian bytes; remembers pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.processor, _, self.whole = model(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens: tokens as they are, others by the model's merges."""
        chars = [mapped(x.encode()) for x in new]
        got = {x: whole for x, c in zip(new, chars, strict=True) if (whole := self.whole.get(c)) is not None}
        rest = [(x, c) for x, c in zip(new, chars, strict=True) if x not in got]
        if rest:
            for (x, _), ids in zip(rest, self.processor.encode([c for _, c in rest], num_threads=1), strict=True):
                # piece 0 is the unknown one
                got[x] = (np.array(ids, "<u4") - np.uint32(1)).tobytes()
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        distinct = set().union(*parts)
        new = list(distinct - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(distinct)
        learnt = self.learn(new)
        self.known |= learnt
        get = self.known.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for x in learnt:  # very long pre-tokens hardly come again
            if len(x) > LONGEST:
                del self.known[x]
        return out


def encode_batches(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in pieces(batch, SLICE):
                ids = encoder.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, token, _ = model(path)
        for batch in batches:
            for part in pieces(batch, SLICE):
                texts = [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text, little-endian unsigned 32-bit numbers in a binary column."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode_batches(path, pattern), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids, ...)."""
    return encoded.select("doc_id", "ids").mapInArrow(decode_batches(path), "doc_id long, bytes binary")


def round_trip_batches(path: str, pattern: str):
    """Both directions over the same batch, so that a row keeps its ids beside its bytes."""
    forth, back = encode_batches(path, pattern), decode_batches(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for encoded in forth(batches):
            # decoding slices a batch; its parts come in order
            whole = pa.Table.from_batches(back(iter([encoded]))).combine_chunks()
            yield pa.RecordBatch.from_arrays([encoded.column(0), encoded.column(1), whole.column("bytes").combine_chunks()], names=["doc_id", "ids", "bytes"])

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes): each text encoded, and its ids decoded again."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(round_trip_batches(path, pattern), "doc_id long, ids binary, bytes binary")
