"""Language identification by sparse multinomial logistic regression.

Method
------
Features are hashed character n-grams (1 to 3 characters, lower case, runs of
non-letters as one blank) of the whole text, weighted by (1 + log tf) * idf and
scaled to length one.  Document frequencies are counted over *all* learning rows
and have a fixed number of buckets.  The weights are fitted by follow-the-
regularised-leader (FTRL-proximal) with an elastic-net penalty on at most
``per_language`` rows of each language (a documented bound: rows whose id hash
lies under a share computed from the language's count), whose n-grams are counted
in the tasks and stay packed in the driver.  A part of those rows is held back to fit the temperature of
the softmax; the score is the calibrated probability of the best language.

Defined results: a text without a letter, and a null text, is ``und`` with score
0.  If there is nothing to learn from, all rows are ``und`` with score 0.  Equal
scores go to the language first in the alphabet.  A row without doc_id is neither
held out nor learnt from.  Rows that repeat a doc_id are
each predicted.  Columns other than doc_id, text and (for learning only) lang are
not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.textops import id_remainder, pieces

BUCKETS = 1 << 15
PREDICTION_SCHEMA = "doc_id long, lang_pred string, score double"
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SHIFT = np.uint32(17)  # 32 - log2(BUCKETS)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters; made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the text's n-grams; None if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letter_table()[c]
    if not alpha.any():
        return None
    # a blank stands for each run of other characters, at the ends too
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    c = np.concatenate(([np.uint32(32)], np.where(alpha, c, np.uint32(32))[keep], [np.uint32(32)])).astype(np.uint32)
    one = c * _M1
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _M2 + c[1:]
    two *= _M3
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _M1 + c[2:]
    three *= _M2
    tf = np.bincount(np.concatenate((one >> _SHIFT, two >> _SHIFT, three >> _SHIFT)), minlength=BUCKETS)
    at = np.flatnonzero(tf)
    return at, tf[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def frequencies(rows: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Document frequency of each bucket and rows of each language, over all rows(lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, langs = np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            for part in pieces(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if (got := term_counts(text)) is not None:
                        df[got[0]] += 1
                        langs[lang] = langs.get(lang, 0) + 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(df[at])], names=["lang", "bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()), pa.array([None] * len(langs), pa.int32()), pa.array(list(langs.values()), pa.int64())], names=["lang", "bucket", "n"])

    # a row for each bucket and language: bounded by the model's own size
    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS, np.int64)
    for r in sums:
        if r["lang"] is None:
            df[r["bucket"]] = r["n"]
    return df, {r["lang"]: r["n"] for r in sums if r["lang"] is not None}


def packed_terms(at: np.ndarray, n: np.ndarray) -> bytes:
    """Buckets (in order) and counts in about a byte and a half each: steps between buckets, then counts, compressed."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u2").tobytes() + n.astype("<u4").tobytes(), 6)


def unpacked_terms(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    k = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, "<u2", k), dtype=np.int64), np.frombuffer(raw, "<u4", k, 2 * k).astype(np.int64)


class Sample:
    """The bounded sample, in the order of its hash.  The driver holds it packed; a row's vector is made when it is asked for."""

    def __init__(self, rows: list[tuple[int, str, bytes]], idf: np.ndarray):
        self.rows, self.idf = sorted(rows), idf

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[str, np.ndarray, np.ndarray]:
        """(language, buckets, values) of the row at place i."""
        at, n = unpacked_terms(self.rows[i][2])
        return self.rows[i][1], at, vector(at, n, self.idf).astype(np.float32).astype(np.float64)


def sample_rows(rows: DataFrame, idf: np.ndarray, shares: dict[str, float]) -> Sample:
    """The rows whose hash lies under their language's share, as packed n-grams."""
    pairs = [x for k, v in sorted(shares.items()) for x in (F.lit(k), F.lit(int(v * (1 << 30)) + 1))]
    h = F.pmod(F.xxhash64(F.lit("language"), "doc_id", F.length("text")), F.lit(1 << 30))
    chosen = rows.withColumn("h", h).where(F.col("h") < F.create_map(*pairs)[F.col("lang")]).select("h", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = []
                for h_, lang, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if (got := term_counts(text)) is not None:
                        out.append((h_, lang, packed_terms(*got)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["h", "lang", "terms"])

    got = chosen.mapInArrow(run, "h long, lang string, terms binary").collect()
    return Sample([(r[0], r[1], bytes(r[2])) for r in got], idf)


class Ftrl:
    """FTRL-proximal for softmax regression: per-coordinate rates, L1 (sparsity) and L2."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least held-back loss, by golden-section search over log t."""

    smooth = 1 / (len(y) + 2)

    def loss(log_t: float) -> float:
        v = logits / np.exp(log_t)
        v = v - v.max(axis=1, keepdims=True)
        nll = np.log(np.exp(v).sum(axis=1))[:, None] - v
        own = nll[np.arange(len(y)), y]
        # one row in n + 2 counts as mislabelled, so that perfect separation still has a finite temperature
        return float(np.mean((1 - smooth) * own + smooth * nll.mean(axis=1)))

    a, b, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """languages, idf, weights (float32) and temperature; at most BUCKETS x languages numbers."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, t: float):
        self.languages, self.idf, self.weights, self.t = languages, idf, weights, t

    def predict(self, text: str | None) -> tuple[str, float]:
        got = term_counts(text) if text and self.languages else None
        if got is None:
            return "und", 0.0
        p = softmax(vector(*got, self.idf) @ self.weights[got[0]] / self.t)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(rows: DataFrame, per_language: int = 1500, epochs: int = 2) -> Model:
    """A model from rows(doc_id, lang, text); frequencies from all rows, weights from at most about per_language of each."""
    rows = rows.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    df, counts = frequencies(rows.select("lang", "text"))
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0), np.float32), 1.0)
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    sample = sample_rows(rows, idf, {k: min(1.0, per_language / v) for k, v in counts.items()})
    place = {k: i for i, k in enumerate(languages)}
    back = [i for i in range(len(sample)) if i % 5 == 4]
    learn = [i for i in range(len(sample)) if i % 5 != 4]
    model = Ftrl(len(languages))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(learn)):
            lang, at, x = sample[learn[i]]
            model.learn(at, x, place[lang])
    w = model.weights(slice(None))
    held = [(x @ w[at], place[lang]) for lang, at, x in map(sample.__getitem__, back)]
    t = temperature(np.array([v for v, _ in held]), np.array([y for _, y in held])) if held else 1.0
    return Model(languages, idf, w.astype(np.float32), max(t, 0.05))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """PREDICTION_SCHEMA for every row from its whole text alone.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                got = [model.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PREDICTION_SCHEMA)


def known_language(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with that score, with all their columns.

    The prediction is made beside the row itself, so no join and no id is needed.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for part in pieces(batch):
                said = [model.predict(t) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([k != "und" and s >= least_score for k, s in said], pa.bool_()))

    return docs.mapInArrow(run, schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from: a quarter, by the id's crc32, is held out."""
    return docs.where(id_remainder("doc_id", 4) != 2)
