"""Quality rules as a short-circuit cascade.

Method
------
Each rule is a predicate on a whole text.  On a bounded sample (``sample_rows``
rows, a documented parameter; those with the smallest hashes, so the same at any
size) every rule's cost (seconds a document) and rejection rate are measured, and
the rules are ordered by rejection per cost.  The cascade then runs over all rows
in that order and stops at a document's first failing rule.  The order decides the
cost only: a document is kept if no rule rejects it, whatever the order, so the
result does not depend on the measured times.

Base counts that a report needs for every row are computed for every row; what
they give is free for the rules that use it.

Defined results: a null or empty text has no words and fails the base rule.  Rows
that repeat a doc_id are judged each on its own.  Further columns are not looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.textops import WordHashes, pieces, window_hashes

QUALITY_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"
SYMBOLS = "#*$%&|<>"
#: ASCII letters and every byte of a letter outside ASCII become "a", the rest a blank.
_LETTERS = bytes(97 if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))
_NO_SYMBOLS = SYMBOLS.encode()
_BLANKS = b" \t\n\x0b\x0c\r"


class Text(NamedTuple):
    """A text and its base counts, as the rules see it."""

    raw: bytes
    words: list[bytes]
    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


def symbol_heavy(t: Text) -> bool:
    """More symbols than one for ten words."""
    return 10 * t.n_symbols > t.n_words


def line_repeats(t: Text) -> bool:
    """More than half of the lines with a word repeat an earlier one."""
    return 2 * t.n_dup_lines > max(1, t.n_lines)


def odd_word_length(t: Text) -> bool:
    """A mean word length outside 2 to 15 characters."""
    return not 2 * t.n_words <= t.word_chars <= 15 * t.n_words


def few_letters(t: Text) -> bool:
    """Less than 60 % of the words' bytes are letters."""
    return 100 * t.raw.translate(_LETTERS).count(b"a") < 60 * sum(map(len, t.words))


def one_word_dominates(t: Text) -> bool:
    """A single word makes up more than 30 % of the words."""
    counts: dict[bytes, int] = {}
    for w in t.words:
        counts[w] = counts.get(w, 0) + 1
    return 100 * max(counts.values(), default=0) > 30 * t.n_words


RULES = (Rule("symbol_heavy", symbol_heavy), Rule("line_repeats", line_repeats), Rule("odd_word_length", odd_word_length), Rule("few_letters", few_letters), Rule("one_word_dominates", one_word_dominates))


def repeat_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words in windows of that width that occur twice or more in the text."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(hashes), bool)
    at = np.unique(np.r_[order[1:][same], order[:-1][same]])
    for i in range(width):
        twice[at + i] = True
    return int(twice.sum())


def base(raw: bytes, hashes: WordHashes) -> Text:
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    n_lines = n_dup = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
        n_lines, n_dup = len(lines), len(lines) - len(set(lines))
    elif words:
        n_lines = 1
    return Text(raw, words, len(words), chars, len(raw) - len(raw.translate(None, _NO_SYMBOLS)), n_lines, n_dup, repeat_words(hashes.of(words)))


def base_fails(t: Text, least_words: int, repeat_percent: int) -> bool:
    return t.n_words < least_words or 100 * t.n_repeat_words > repeat_percent * t.n_words


def text_bytes(col: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, least_words: int = 50, repeat_percent: int = 50) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, rejection rate) on the sample, ordered by rejection per cost.

    The sample is taken from ids alone and its texts are measured in the tasks;
    only the rules' sums come to the driver.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    n = keyed.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = keyed.where((F.pmod(F.xxhash64(F.lit("cascade"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, spent, said, seen = WordHashes(), [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for part in pieces(batch):
                for raw in text_bytes(part.column(1)):
                    t = base(raw, hashes)
                    if base_fails(t, least_words, repeat_percent):
                        continue
                    seen += 1
                    for i, r in enumerate(rules):
                        began = time.perf_counter()
                        said[i] += r.rejects(t)
                        spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent, pa.float64()), pa.array(said, pa.int64()), pa.array([seen] * len(rules), pa.int64())], names=["rule", "s", "said", "seen"])

    sums = {r[0]: r[1:] for r in sample.mapInArrow(run, "rule int, s double, said long, seen long").groupBy("rule").agg(F.sum("s"), F.sum("said"), F.sum("seen")).collect()}
    rows = [(r.name, (sums[i][0] / max(1, sums[i][2])) if i in sums else 0.0, (sums[i][1] / max(1, sums[i][2])) if i in sums else 0.0) for i, r in enumerate(rules)]
    return sorted(rows, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, sample_rows: int = 2000, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """QUALITY_SCHEMA for every row: base counts and the cascade's verdict.  One pass, no shuffle.

    failed_rule is the first failing rule in the measured order ("base" for the
    base rule); it is a hint, as the order may change from run to run.
    """
    order = order or [name for name, _, _ in profile(docs, rules, sample_rows, least_words, repeat_percent)]
    cascade = sorted(rules, key=lambda r: order.index(r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for raw in text_bytes(part.column(1)):
                    t = base(raw, hashes)
                    failed = base_fails(t, least_words, repeat_percent)
                    rule = "base" if failed else next((r.name for r in cascade if r.rejects(t)), None)
                    rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, rule is None, rule))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, QUALITY_SCHEMA)
