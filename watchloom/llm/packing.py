"""Best-fit packing of tokenised documents by exact-complement hashing.

Method
------
1. Each document becomes its token ids plus one end id; only documents longer than
   a sequence are cut, into full pieces and a rest.
2. The pieces' lengths are counted (at most ``size`` distinct lengths, whatever the
   corpus holds).  On this histogram the longest remaining piece opens a sequence;
   its gap is looked up in an index of the sums that one, two or three remaining
   pieces can make, and a combination that fills it exactly is consumed under the
   availability counts, as often as they allow at once.  If no combination fits
   exactly, the largest piece that fits (best fit) is put in and the new gap is
   looked up again; what no piece fits stays open.  Each step uses up at least one
   length, so there are at most ``size`` patterns.
3. A pattern claims ranks of a length's pieces.  The task that makes a piece numbers
   it among its pieces of that length; the counts of the tasks before shift these
   numbers to ranks, so no piece is shuffled or sorted, with or without its ids, and
   a length that a third of all pieces share is no task's work alone.  Each piece
   finds its sequence and offset in the pattern table (at most 64 x ``size`` rows,
   sent to the tasks).  The table of shifts, a row for each task and length, is
   sent to the tasks up to ``SENT_ROWS`` rows; beyond, it is joined by a shuffle.

Defined results: null and empty texts are the end id alone (length 1).  Rows that
repeat a doc_id, or have none, are packed as documents of their own.  An empty table gives no
rows.  Further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.llm.textops import pieces, saved

#: Words a worker remembers the ids of (about 230 bytes each).
REMEMBERED = 250_000
#: Rows of the table of shifts that are sent to the tasks (about 24 bytes each).
SENT_ROWS = 250_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def give_back() -> None:
    """Memory that the C library keeps of what was freed, the tokenizer's most of all, goes back to the machine."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def plain_parts(word: str) -> int:
    """In how many parts the tokenizer splits a word, if that is plain: letters of the Latin blocks, perhaps a stop or comma; else 0."""
    if word.isascii():
        if word.isalpha():
            return 1
        return 2 if word[-1:] in ".," and word[:-1].isalpha() else 0
    stem = word[:-1] if word[-1] in ".," else word
    return (1 if stem is word else 2) if stem.isalpha() and max(stem) < "\u0250" and "\u0130" not in stem else 0


def word_ids(path: str):
    """texts -> (token ids of all texts in a row, where each text's ids end).

    Tokens never span white space, so each distinct word between blanks and line
    ends is encoded once and remembered; Arrow tells the distinct words of a batch.
    New plain words are encoded many at a time, by the tokenizer's own model, and
    told apart by the tokens that end a part; others one by one by all of its steps.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

    tok = Tokenizer.from_file(path)
    # plain words need none of the normaliser and of the splitting pattern
    ascii_words, latin_words = Tokenizer(tok.model), Tokenizer(tok.model)
    ascii_words.pre_tokenizer = WhitespaceSplit()
    latin_words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = tok.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    known: dict[str, bytes] = {"": b""}  # ids as little-endian 32-bit numbers
    marks = {m: np.array(tok.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ".,"}

    def learn_plain(words: list[str], by: Tokenizer) -> None:
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(by.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, a = ids.tobytes(), 0
            for w, b in zip(some, ((np.flatnonzero(ends[ids]) + 1) * 4).tolist(), strict=True):
                known[w] = raw[a:b]
                a = b

    def learn(words: list[str]) -> None:
        plain, marked, rest = set(), [], []
        for w in words:
            n = plain_parts(w)
            if n == 1:
                plain.add(w)
            elif n == 2:
                marked.append(w)
                if w[:-1] not in known:
                    plain.add(w[:-1])
            else:
                rest.append(w)
        learn_plain([w for w in plain if w.isascii()], ascii_words)
        learn_plain([w for w in plain if not w.isascii()], latin_words)
        for w in marked:
            known[w] = known[w[:-1]] + marks[w[-1]]
        for at in range(0, len(rest), 1024):
            for w, e in zip(rest[at : at + 1024], tok.encode_batch_fast(rest[at : at + 1024], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the tokenizer lower-cases each character by itself; only these two would differ
        low = [(t if "\u0130" in t or "\u03a3" in t or "<|" in t else t.lower()).replace("\n", " ") for t in texts]
        split = pc.split_pattern(pa.array(low, pa.large_string()), " ")
        words = split.values.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            known[""] = b""
            new = [w for w in distinct if w]
        learn(new)
        got = [known[w] for w in distinct]
        length = np.fromiter(map(len, got), np.int64, len(got)) // 4
        pool = np.frombuffer(b"".join(got), "<u4")
        at = words.indices.to_numpy()
        own = length[at]
        upto = np.r_[0, np.cumsum(own)]
        # each word's ids are a run of the pool
        run = np.repeat((np.cumsum(length) - length)[at] - upto[:-1], own) + np.arange(upto[-1])
        return pool[run], upto[split.offsets.to_numpy()][1:]

    return encode


def piece_batches(path: str, size: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_ids(path)
        part_id, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, 2 << 20, 4000):
                give_back()
                ids, ends = encode([x or "" for x in part.column(1).to_pylist()])
                ids = np.insert(ids, ends, np.uint32(end)).astype("<u4")
                ends = ends + np.arange(1, len(ends) + 1)
                first = np.r_[0, ends[:-1]]
                pieces_of = -(-(ends - first) // size)
                doc = np.repeat(np.arange(len(ends)), pieces_of)
                p = np.arange(len(doc)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
                a = first[doc] + p * size
                b = np.minimum(a + size, ends[doc])
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                # a piece's number among those of its length in this task
                length = b - a
                by_length = np.argsort(length, kind="stable")
                many = np.bincount(length, minlength=size + 1)
                nth = np.empty(len(length), np.int64)
                nth[by_length] = seen[length[by_length]] + np.arange(len(length)) - (np.cumsum(many) - many)[length[by_length]]
                seen += many
                columns = [part.column(0).take(pa.array(doc)), pa.array(p, pa.int32()), pa.array(p * size), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(length), part_id, np.int32)), pa.array(nth)]
                if with_ids:
                    # the pieces lie one after another
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, b], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if with_ids else [])])
                del part, ids, columns
        # the worker outlives its task: what it remembers goes first
        encode = batch = None
        give_back()

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most size tokens; with_ids adds the ids themselves."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(piece_batches(tokenizer_path, size, end, with_ids), PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


class Sums:
    """Which gaps one, two or three of the remaining pieces fill exactly (bit sets over lengths)."""

    def __init__(self, count: np.ndarray):
        self.count = count
        self.refresh()

    def refresh(self) -> None:
        self.lengths = np.flatnonzero(self.count)[::-1].tolist()
        self.one = sum(1 << a for a in self.lengths)
        self.two = 0
        for a in self.lengths:
            self.two |= self.one << a

    def fits(self, combo: tuple[int, ...]) -> bool:
        return all(self.count[a] >= combo.count(a) for a in combo)

    def pair(self, gap: int, most: int) -> tuple[int, ...] | None:
        for a in self.lengths:
            if a <= most and a < gap and 2 * a >= gap and self.one >> (gap - a) & 1 and self.fits((a, gap - a)):
                return a, gap - a
        return None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """The combination with the largest piece, of one, two or three pieces."""
        if self.one >> gap & 1:
            return (gap,)
        if self.two >> gap & 1 and (got := self.pair(gap, gap)):
            return got
        for a in self.lengths:
            if 3 * a < gap:
                break
            if a < gap and self.two >> (gap - a) & 1 and (got := self.pair(gap - a, a)) and self.fits((a, *got)):
                return a, *got
        return None


def plan(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Claims (length, first rank, ranks, first sequence, per sequence, offset) and the number of sequences."""
    count = np.zeros(size + 1, np.int64)
    for a, n in histogram.items():
        count[a] += n
    used, claims, sequences = np.zeros(size + 1, np.int64), [], 0
    while (left := np.flatnonzero(count)).size:
        top = int(left[-1])
        many, bin_ = count.copy(), [top]
        count[top] -= 1
        gap, sums = size - top, None
        while gap:
            sums = sums or Sums(count)
            if combo := sums.filling(gap):
                bin_ += combo
                break
            fit = next((a for a in sums.lengths if a <= gap), None)
            if fit is None:
                break
            bin_.append(fit)
            gap -= fit
            count[fit] -= 1
            if not count[fit]:
                sums = None
        times = {a: bin_.count(a) for a in bin_}
        repeat = min(int(many[a]) // n for a, n in times.items())
        offset = 0
        for a, n in times.items():
            claims.append((a, int(used[a]), repeat * n, sequences, n, offset))
            used[a] += repeat * n
            many[a] -= repeat * n
            offset += a * n
        count, sequences = many, sequences + repeat
    return claims, sequences


def ranked(rows: DataFrame, counts: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """rows(part, length, nth, ...) with rank, from 0, within their length; counts(part, length, n) are those of rows."""
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    if counts.count() <= sent_rows:
        shift = F.broadcast(shift)
    return rows.join(shift, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("shift")).drop("shift")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end: int = 0, with_ids: bool = False, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Pieces with sequence_id and offset; no sequence holds more than size tokens, offsets are gapless from 0."""
    spark: SparkSession = docs.sparkSession
    rows = saved(token_pieces(docs, tokenizer_path, size, end, with_ids))
    counts = saved(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    claims, _ = plan(histogram, size)
    table = spark.createDataFrame(claims, "length long, first long, ranks long, seq long, per long, at long")
    full = (F.col("length") == F.col("c_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    got = ranked(rows, counts, sent_rows).join(F.broadcast(table.withColumnRenamed("length", "c_length")), full)
    own = F.col("rank") - F.col("first")
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.floor(own / F.col("per"))).alias("sequence_id"), (F.col("at") + own % F.col("per") * F.col("length")).alias("offset"), *(["ids"] if with_ids else []))
