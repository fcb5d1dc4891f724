"""Phrase collocation mining with burst-trie counting.

Method
------
1. Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line ends, and
   pieces into words; everything is counted by language.
2. Each task counts runs of words in a trie over the task's own word ids: a node
   holds a *container* (a hash table of whole keys) for each run of ids at its
   depth.  A container that outgrows ``BURST`` bursts: its run is halved, and a
   single id's container becomes a node one word deeper.  When the task's tries
   hold more than ``BUDGET`` keys, the subtrees below the root whose phrases are the
   rarest are spilled whole, each as runs sorted by phrase.  Words by themselves
   are counted at the root, in an array by id.
3. The runs of all tasks lie in a table of the shared folder and are merged by
   prefix partition: a range partition of (language, phrase) holds all phrases
   between two prefixes, so equal phrases meet and a prefix that very many phrases
   share is cut into several partitions.  A phrase comes at most once from each
   spill, however frequent it is.
4. No phrase is more frequent than its parts.  So words are counted first, then
   pairs of frequent words, then runs of three and four words all of whose pairs
   are frequent.  What is frequent goes to the tasks as a Bloom filter of at most
   ``FILTER_BITS`` bits: what it lets through by chance is counted for nothing and
   dropped by its exact count.
5. Counts of parts are joined to the cuts of each candidate; scores are whole
   numbers by decimal division.  A language's first ``top`` come from the first of
   64 salts of its candidates.

Memory of a task: BUDGET keys, WORDS remembered words, the filters and one batch.

Defined results: a null text has no words, a null language is ``und``.  Equal rows
count each.  An empty table gives no rows.  doc_id and further columns are not
looked at.
"""

from __future__ import annotations

from collections import _count_elements  # type: ignore[attr-defined]  # Counter's own loop, for plain dicts
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.textops import pieces, saved, utf8, window_hashes

#: Keys of a container before it bursts, of a task's tries before subtrees are spilled, and words that a task remembers.
BURST, BUDGET, WORDS = 1 << 15, 600_000, 250_000
#: Bits of a filter: 16 for each item, within these bounds (at most 32 MB).
LEAST_BITS, FILTER_BITS = 1 << 16, 1 << 28
#: A filter travels in blocks of this many bits.
BLOCK_BITS = 1 << 16
RUN_SCHEMA = "lang string, phrase string, n long"

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def as_keys(rows: np.ndarray) -> list:
    """Rows of big-endian ids as the keys of a container: numbers for two ids, bytes for more."""
    return rows.view(">u8").ravel().tolist() if rows.shape[1] == 2 else rows.view(f"V{4 * rows.shape[1]}").ravel().tolist()


def as_rows(container: dict, k: int) -> np.ndarray:
    """The keys of a container as rows of ids."""
    flat = np.fromiter(container, np.uint64, len(container)).astype(">u8").view(">u4") if k == 2 else np.frombuffer(b"".join(container), ">u4")
    return flat.reshape(-1, k).astype(np.int64)


class Trie:
    """Counts of keys of ``k`` word ids, two at least: a node at some depth, with a container or a deeper node for each run of ids."""

    def __init__(self, k: int, depth: int = 0, first: dict | None = None):
        self.k, self.depth = k, depth
        self.low: list[int] = [0]  # the least id of each child's run
        self.kids: list[dict | Trie] = [{} if first is None else first]

    def add(self, keys: np.ndarray) -> None:
        """Counts the rows of keys, big-endian ids of shape (n, k)."""
        slot = np.searchsorted(self.low, keys[:, self.depth], "right") - 1
        order = np.argsort(slot, kind="stable")
        ends = np.cumsum(np.bincount(slot, minlength=len(self.low)))
        raw = np.ascontiguousarray(keys[order])
        grown = []
        for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if a == b:
                continue
            kid = self.kids[i]
            if isinstance(kid, Trie):
                kid.add(raw[a:b])
            else:
                _count_elements(kid, as_keys(raw[a:b]))
                if len(kid) > BURST:
                    grown.append(i)
        for i in reversed(grown):
            self.burst(i)

    def burst(self, i: int) -> None:
        """Halves the run of ids of an overgrown container until its parts are small or hold one id, which gets a node."""
        kid = self.kids[i]
        if len(kid) <= BURST:
            return
        ids = as_rows(kid, self.k)[:, self.depth]
        least, most = int(ids.min()), int(ids.max())
        if least == most:
            if self.depth + 1 < self.k:
                self.kids[i] = deeper = Trie(self.k, self.depth + 1, kid)
                deeper.burst(0)
            return
        middle = max(least + 1, int(np.median(ids)))
        parts: tuple[dict, dict] = ({}, {})
        for (key, n), upper in zip(kid.items(), (ids >= middle).tolist(), strict=True):
            parts[upper][key] = n
        self.kids[i : i + 1] = parts
        self.low.insert(i + 1, middle)
        self.burst(i + 1)
        self.burst(i)

    def __len__(self) -> int:
        return sum(map(len, self.kids))

    def containers(self) -> Iterator[dict]:
        for kid in self.kids:
            if isinstance(kid, Trie):
                yield from kid.containers()
            else:
                yield kid

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes out whole subtrees of the root, those of the rarest phrases first, until at most ``keep`` keys stay: (keys, counts)."""
        left = len(self)
        under = [list(kid.containers()) if isinstance(kid, Trie) else [kid] for kid in self.kids]
        mean = [sum(sum(c.values()) for c in cs) / max(1, sum(map(len, cs))) for cs in under] if keep else [0] * len(under)
        for i in sorted(range(len(self.kids)), key=mean.__getitem__):
            if left <= keep:
                return
            self.kids[i] = {}
            for c in under[i]:
                left -= len(c)
                if c:
                    yield as_rows(c, self.k), np.fromiter(c.values(), np.int64, len(c))


class WordCounts:
    """Counts of single words, by id, as a trie of one word gives them."""

    def __init__(self) -> None:
        self.n = np.zeros(1 << 12, np.int64)

    def add(self, keys: np.ndarray) -> None:
        got = np.bincount(keys[:, 0])
        if len(got) > len(self.n):
            self.n = np.r_[self.n, np.zeros(max(len(self.n), len(got) - len(self.n)), np.int64)]
        self.n[: len(got)] += got

    def __len__(self) -> int:
        return 0  # bounded by the vocabulary

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not keep and (ids := np.flatnonzero(self.n)).size:
            yield ids.reshape(-1, 1), self.n[ids]
            self.n[:] = 0


class BitFilter:
    """A Bloom filter of 64-bit hashes, two bits each, over a power of two of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)
        self.raw = bits.tobytes()

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> np.ndarray:
        return np.r_[hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)].astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        one, two = hashes & self.mask, (hashes >> np.uint64(32)) & self.mask
        test = lambda p: (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return (test(one) & test(two)).astype(bool)

    def holds_one(self, h: int) -> bool:
        mask = 8 * len(self.raw) - 1
        one, two = h & mask, (h >> 32) & mask
        return bool(self.raw[one >> 3] >> (one & 7) & 1 and self.raw[two >> 3] >> (two & 7) & 1)


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word)


class Vocabulary:
    """Ids of a task's words by language: 0 for what ends a run, -1 for nothing between blanks, others from 1 on."""

    def __init__(self, frequent: BitFilter | None):
        self.frequent = frequent
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = [b""]
        self.langs: list[bytes] = [b""]
        self.hashes: list[int] = [0]
        self.by_lang: dict[bytes, Vocabulary.Ids] = {}

    class Ids(dict):
        def __init__(self, of: Vocabulary, lang: bytes):
            super().__init__({b"": -1, b"\n": 0})
            self.of, self.lang = of, lang

        def __missing__(self, word: bytes) -> int:
            of, h = self.of, word_hash(self.lang, word)
            if of.frequent is not None and not of.frequent.holds_one(h):
                return 0
            value = self[word] = len(of.words)
            of.words.append(word)
            of.langs.append(self.lang)
            of.hashes.append(h)
            return value

    def remembered(self) -> int:
        return sum(map(len, self.by_lang.values()))

    def ids(self, lang: bytes, texts: list[bytes]) -> np.ndarray:
        """Ids of all words of texts of one language; 0 stands between pieces and for words that aren't frequent."""
        tokens = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        own = self.by_lang.get(lang)
        if own is None:
            own = self.by_lang[lang] = self.Ids(self, lang)
        ids = np.fromiter(map(own.__getitem__, tokens), np.int64, len(tokens))
        return ids[ids >= 0]


def runs_of(ids: np.ndarray, k: int, pairs: np.ndarray | None) -> np.ndarray:
    """Big-endian rows of every k ids in a row without a 0 between them, all of whose pairs are good."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty((0, k), ">u4")
    good = np.ones(n, bool)
    for j in range(k):
        good &= ids[j : j + n] > 0
    if pairs is not None:
        for j in range(k - 1):
            good &= pairs[j : j + n]
    at = np.flatnonzero(good)
    return np.stack([ids[at + j] for j in range(k)], axis=1).astype(">u4" if k > 1 else np.int64)


def count_batches(orders: tuple[int, ...], words, pairs):
    """A mapInArrow function (lang, text) -> RUN_SCHEMA: spilled runs of counts, each sorted by phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(BitFilter(words.value) if words is not None else None)
        frequent_pairs = BitFilter(pairs.value) if pairs is not None else None
        tries = {k: Trie(k) if k > 1 else WordCounts() for k in orders}

        def rows(spilled: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            names, langs = pa.array(known.words, pa.binary()), pa.array(known.langs, pa.binary())
            for keys, counts in spilled:
                columns = [names.take(pa.array(keys[:, j])) for j in range(keys.shape[1])]
                phrase = pc.binary_join_element_wise(*columns, b" ").cast(pa.string())
                out = pa.RecordBatch.from_arrays([langs.take(pa.array(keys[:, 0])).cast(pa.string()), phrase, pa.array(counts)], names=["lang", "phrase", "n"])
                yield out.take(pc.sort_indices(out, [("lang", "ascending"), ("phrase", "ascending")]))

        for batch in batches:
            for part in pieces(batch):
                langs, texts = utf8(part.column(0)), utf8(part.column(1))
                of: dict[bytes, list[bytes]] = {}
                for lang, text in zip(langs, texts, strict=True):
                    of.setdefault(lang, []).append(text)
                # a 0 ends each language's last run
                ids = np.concatenate([np.r_[known.ids(lang, own), 0] for lang, own in of.items()])
                good = None
                if frequent_pairs is not None:
                    good = frequent_pairs.holds(window_hashes(np.array(known.hashes, np.uint64)[ids], 2))
                for k, trie in tries.items():
                    trie.add(runs_of(ids, k, good))
                full = known.remembered() > WORDS
                if full or sum(map(len, tries.values())) > BUDGET:
                    for trie in tries.values():
                        yield from rows(trie.spill(0 if full else BUDGET // (2 * len(tries))))
                if full:
                    known.clear()
                    tries = {k: Trie(k) if k > 1 else WordCounts() for k in orders}
        for trie in tries.values():
            yield from rows(trie.spill(0))

    return run


def counted(texts: DataFrame, orders: tuple[int, ...], words: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Runs (lang, phrase, n) of the phrases of these numbers of words, to be merged; only of frequent words and pairs, if given."""
    sc = texts.sparkSession.sparkContext
    shared = [None if x is None else sc.broadcast(filter_bits(x)) for x in (words, pairs)]  # at most FILTER_BITS each
    return saved(texts.mapInArrow(count_batches(orders, *shared), RUN_SCHEMA))


def merged(runs: DataFrame, least: int) -> DataFrame:
    """Exact counts of phrases of at least ``least`` occurrences, merged by range partitions of (lang, phrase)."""
    return saved(runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def filter_bits(phrases: DataFrame) -> np.ndarray:
    """Bytes of the filter that holds the hashes of (lang, phrase): words, or pairs of words."""
    bits = LEAST_BITS
    count = phrases.count()
    while bits < 16 * count and bits < FILTER_BITS:
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                hashes = []
                for lang, phrase in zip(utf8(part.column(0)), utf8(part.column(1)), strict=True):
                    w = np.array([word_hash(lang, x) for x in phrase.split(b" ")], np.uint64)
                    hashes.append(w[0] if len(w) == 1 else window_hashes(w, 2)[0])
                at = BitFilter.places(np.array(hashes, np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK_BITS), pa.array(at % BLOCK_BITS)], names=["block", "bit"])

    def block(key, table):  # noqa: ANN001, ANN202  # Spark reads the kind of function from the number of arguments
        got = np.zeros(BLOCK_BITS, bool)
        got[table.column("bit").to_numpy()] = True
        return pa.table({"block": [key[0].as_py()], "bits": pa.array([np.packbits(got, bitorder="little").tobytes()], pa.binary())})

    rows = phrases.select("lang", "phrase").mapInArrow(places, "block long, bit long").distinct().groupBy("block").applyInArrow(block, "block long, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.block * BLOCK_BITS // 8 : (r.block + 1) * BLOCK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates(lang, phrase, n) as (lang, phrase, a, l, r, score): the lowest-scoring cut, ties to the shortest first part."""
    w = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    of = lambda part, n: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def inside_longer(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, most): the count of the most frequent longer candidate that a phrase of two words or more lies in."""
    w = F.split("phrase", " ")
    longer = candidates.select("lang", "n", w.alias("w")).where(F.size("w") > 2)
    start = longer.select("lang", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    # every run of at least two words that isn't the whole
    part = start.select("lang", "n", "w", "i", F.explode(F.sequence(F.lit(2), F.size("w") - F.col("i") + 1)).alias("k")).where("k < size(w)")
    return part.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000, salts: int = 64) -> DataFrame:
    """Each language's first ``top`` phrases: (lang, rank, phrase, a, l, r, n, score)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    first = counted(texts, (1,))
    total = first.groupBy("lang").agg(F.sum("n").alias("total"))
    words = merged(first, least)
    pairs = merged(counted(texts, (2,), words), least)
    more = merged(counted(texts, (3, 4), words, pairs), least)
    candidates = pairs.union(more)
    most = inside_longer(more)
    kept = scored(candidates, words.union(candidates)).join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    near = kept.withColumn("_n", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("_n") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
