"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty.

Method
------
Pattern spans (assignments, access key ids, long hex runs) are found as they are.
Then every unbroken string of ``least_chars`` or more that mixes letters and
digits and has a sensitive word within ``reach`` characters before it is a
candidate.  Its novelty is its *marginal* compressed size: the zstandard frame of
(surrounding code + candidate) less the frame of the surrounding code alone, with
a compression dictionary primed by identifiers: those of configuration at large and
the ``words`` most frequent ones (letters, stops and underscores only, so no secret)
that stand within ``reach`` of a sensitive word, counted over all documents.  Paths, versions and identifiers
compress well against both; random strings don't.  Candidates whose marginal bytes
reach ``novelty`` a character, and whose characters carry enough entropy of their
own, are reported as kind ``novel`` unless they overlap a pattern span.

Cheap byte searches decide whether a text needs any regular expression, so clean
prose costs a few scans; offsets are code points of the whole text.

Defined results: a null or empty text has no spans.  Rows that repeat a doc_id are
scanned each on its own.  Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.textops import pieces

SECRET_SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string"
KINDS = ("assign", "access", "hex", "novel")
#: Letters of the keyword in either case, ASCII only.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Sensitive words of the novelty rule, lower case.
SENSITIVE = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"credential", b"private_key", b"bearer", b"authorization", b"auth_key", b"access_key", b"client_id", b"passphrase", b"signature")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/=-])[A-Za-z_.]{4,40}(?![A-Za-z0-9+/=-])")
_SENSITIVE = re.compile("|".join(x.decode() for x in SENSITIVE), re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What identifiers and configuration look like, to prime the compressor.
IDENTIFIERS = """access_key_id secret_access_key client_secret client_id api_key apiKey auth_token authToken bearer authorization
password passwd passphrase username user_name private_key public_key certificate credential signature session_id sessionToken
refresh_token access_token token_type expires_in grant_type redirect_uri http https localhost example.com www index.html
config configuration settings environment production development staging database connection_string hostname port timeout
import export return function class const static public private void string integer boolean null None True False self this
get_value set_value getValue setValue create_user deleteUser updateSession request response handler controller service
/usr/local/bin /etc/ssl/certs /var/log /home/user application/json text/plain charset=utf-8 0123456789 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 xxxxxxxx 2020-01-01 2024-12-31 v1.0.0 SNAPSHOT RELEASE"""
_HEXMAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def entropy(s: str) -> float:
    """Bits a character of the string's own character counts."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str, low: bytes, raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; low and raw are the text's bytes, for the cheap tests."""
    out = []
    if any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEXMAP):
        out += [(*m.span(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


class Novelty:
    """Marginal compressed size of candidates."""

    def __init__(self, least_chars: int = 16, reach: int = 64, novelty: float = 0.62, least_entropy: float = 3.0, identifiers: list[str] | None = None):
        # the most frequent ones last, where they are cheapest to refer to
        primed = zstandard.ZstdCompressionDict("\n".join([*reversed(identifiers or []), IDENTIFIERS]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False)
        self.least_chars, self.reach, self.novelty, self.least_entropy = least_chars, reach, novelty, least_entropy

    def marginal(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes a character that the candidate adds to its surroundings."""
        around = (before + "\n" + after).encode()
        return (len(self.zstd.compress(around + b"\n" + candidate.encode())) - len(self.zstd.compress(around))) / len(candidate)

    def spans(self, text: str, low: bytes) -> Iterator[tuple[int, int, str]]:
        if not any(k in low for k in SENSITIVE):
            return
        for m in CANDIDATE.finditer(text):
            s = m[0]
            if len(s) < self.least_chars or s.isalpha() or not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                continue
            a, b = m.span()
            before = text[max(0, a - self.reach) : a]
            near = before.lower().encode()
            if any(k in near for k in SENSITIVE) and entropy(s) >= self.least_entropy and self.marginal(before, s, text[b : b + self.reach]) >= self.novelty:
                yield a, b, "novel"


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and further ones of one text."""
    raw = text.encode("utf-8", "replace")
    low = raw.lower()
    found = base_spans(text, low, raw)
    more = [x for x in novelty.spans(text, low) if all(x[1] <= a or x[0] >= b for a, b, _ in found)]
    return found, more


def identifiers(docs: DataFrame, reach: int = 64, words: int = 2000) -> list[str]:
    """The identifiers that stand near sensitive words most often, in all documents; at most ``words`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                n: Counter = Counter()
                for text in part.column(0).to_pylist():
                    low = (text or "").lower().encode("utf-8", "replace")
                    if any(k in low for k in SENSITIVE):
                        done = 0
                        for m in _SENSITIVE.finditer(text):
                            a, b = max(done, m.start() - reach), m.end() + reach
                            n.update(x[0] for x in IDENTIFIER.finditer(text, a, b))
                            done = max(done, b)
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in counted.where("n > 1").orderBy(F.desc("n"), "word").limit(words).collect()]


def secrets(docs: DataFrame, novelty: float = 0.62, reach: int = 64, least_chars: int = 16, words: int = 2000) -> DataFrame:
    """SECRET_SCHEMA for every row: all spans by start, counts by kind, digest of the base spans.

    One pass for the identifiers, one for the spans; no text is shuffled.
    """
    known = identifiers(docs, reach, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Novelty(least_chars, reach, novelty, identifiers=known)
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    found, more = scan(text or "", judge)
                    every = sorted(found + more, key=lambda x: (x[0], KINDS.index(x[2])))
                    n = Counter(k for _, _, k in every)
                    rows.append(([{"kind": k, "start": a, "end": b} for a, b, k in every], n["assign"], n["access"], n["hex"], n["novel"], hashlib.sha256(joined(found).encode()).hexdigest()))
                kinds = [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])), *[pa.int64()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "spans", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SECRET_SCHEMA)
