"""Benchmark decontamination: size-partitioned MinHash containment search.

Method
------
Test items are partitioned by the size of their shingle set: class ``s`` (a power
of two) holds items of ``s/2 < size <= s`` shingles.  A document is searched for
class ``s`` in windows of ``2s`` shingles that start every ``s``, so that every
passage of an item's length lies whole in some window, however long the document
is.  In a window an item of containment 0.8 has a Jaccard similarity of 0.19 at
least; with 64 one-row bands it is missed with probability ``0.81**64 < 2e-6``.
Window minima of all classes come from one pass: minima of blocks of 8 shingles
are merged pairwise up to the class's width.  A band hit (same minimum, same hash
function, same class) makes (document, item) a candidate; it is verified by the
exact containment of the item's shingles in the set of the whole document.

The items are taken in blocks of at most ``block_items`` rows and ``block_bytes``
of text, whose index is sent to the tasks: a stated query set against all
documents.  The documents are never shuffled and a hot source or a long text
costs its own length only.

Defined results: shingles are of lower-cased (A-Z) words; null or empty texts and
texts of fewer words than a shingle match nothing, on either side.  Rows that
repeat an id each get their own results.  Clashing or further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.textops import WordHashes, hash_functions, pieces, utf8, window_hashes

LEAK_SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_found long, containment double"
BLOCK = 8  #: width of the finest windows' blocks
NONE = np.uint32(0xFFFFFFFF)


class ItemIndex:
    """Minima of a bounded block of items, by size class and hash function."""

    def __init__(self, ids: list[int], texts: list[bytes], shingle: int, bands: int, seed: int):
        words = WordHashes()
        self.shingle, self.bands, (self.xor, self.mul) = shingle, bands, hash_functions(bands, seed)
        self.ids, self.sets, by_class = [], [], {}
        for i, t in zip(ids, texts, strict=True):
            s = np.unique(window_hashes(words.of(t.lower().split()), shingle))
            if len(s):
                width = max(BLOCK, 1 << int(len(s) - 1).bit_length())
                by_class.setdefault(width, []).append(len(self.ids))
                self.ids.append(i)
                self.sets.append(s)
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for width, items in sorted(by_class.items()):
            index = []
            for j in range(bands):
                m = np.array([self.minimum(self.sets[i], j) for i in items], np.uint32)
                order = np.argsort(m, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[m & np.uint32(0xFFFF)] = True
                index.append((m[order], np.array(items)[order], np.packbits(seen)))
            self.classes[width] = index

    def minimum(self, s: np.ndarray, j: int) -> np.uint32:
        return ((((s ^ (s >> np.uint64(32))).astype(np.uint32)) ^ self.xor[j]) * self.mul[j]).min()


def pair_up(m: np.ndarray) -> np.ndarray:
    """Minima of neighbouring pairs; an odd last one stays alone."""
    if len(m) % 2:
        m = np.append(m, NONE)
    return np.minimum(m[0::2], m[1::2])


def candidates(index: ItemIndex, sets: list[np.ndarray]) -> set[tuple[int, int]]:
    """(place in sets, place of item) of every band hit.  sets: shingles in the order of the text."""
    # each document starts at a multiple of twice the widest block, so that no block spans two
    top = max(index.classes) if index.classes else BLOCK
    unit = [max(1, -(-len(s) // top)) * top for s in sets]
    starts = np.r_[0, np.cumsum(unit)]
    h = np.zeros(starts[-1], np.uint32)
    live = np.zeros(starts[-1], bool)
    for s, a in zip(sets, starts[:-1], strict=True):
        h[a : a + len(s)] = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        live[a : a + len(s)] = True
    dead = ~live
    found: set[tuple[int, int]] = set()
    seen = {w: [np.unpackbits(x[2]).view(bool) for x in v] for w, v in index.classes.items()}
    for j in range(index.bands):
        m = (h ^ index.xor[j]) * index.mul[j]
        m[dead] = NONE
        width = 1
        while width < top:
            m, width = pair_up(m), width * 2
            if width not in index.classes:
                continue
            # a window is two blocks; the next document's first block can only add hits, which are verified
            w = np.minimum(m, np.append(m[1:], NONE))
            hit = np.flatnonzero(seen[width][j][w & np.uint32(0xFFFF)])
            if not len(hit):
                continue
            minima, items, _ = index.classes[width][j]
            lo, hi = np.searchsorted(minima, w[hit], "left"), np.searchsorted(minima, w[hit], "right")
            for at, a, b in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                d = int(np.searchsorted(starts, at * width, "right")) - 1
                found.update((d, int(i)) for i in items[a:b])
    return found


def search_batches(index: ItemIndex, percent: int):
    """A mapInArrow function (doc_id, text) -> LEAK_SCHEMA against one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in pieces(batch, most_bytes=1 << 20, most_rows=500):
                ids = part.column(0).to_pylist()
                sets = [window_hashes(words.of(t.lower().split()), index.shingle) for t in utf8(part.column(1))]
                rows, whole = [], {}
                for d, i in sorted(candidates(index, sets)) if index.classes else ():
                    if d not in whole:
                        whole = {d: np.unique(sets[d])}
                    item = index.sets[i]
                    n = len(np.intersect1d(item, whole[d], assume_unique=True))
                    if n and 100 * n >= percent * len(item):
                        rows.append((ids[d], index.ids[i], len(item), n, n / len(item)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.float64(),), strict=True)], names=["doc_id", "item_id", "n_item_shingles", "n_found", "containment"])

    return run


def item_blocks(items: DataFrame, block_items: int, block_bytes: int) -> Iterator[list]:
    """The items in blocks of bounded size, one block in the driver at a time."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        if block and (len(block) >= block_items or size + len(r[1]) > block_bytes):
            yield block
            block, size = [], 0
        block.append((r[0], r[1].encode()))
        size += len(r[1])
    yield block


def leaks(docs: DataFrame, items: DataFrame, percent: int = 80, shingle: int = 5, bands: int = 64, seed: int = 11, block_items: int = 10_000, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_found, containment): each item of which a document holds percent of the shingles."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in item_blocks(items, block_items, block_bytes):
        index = ItemIndex([i for i, _ in block], [t for _, t in block], shingle, bands, seed)
        one = base.mapInArrow(search_batches(index, percent), LEAK_SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out


def clean_batches(index: ItemIndex, percent: int, text: int):
    """A mapInArrow function that keeps the rows whose text, column number ``text``, holds no item of the index."""
    search = search_batches(index, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                # rows are told apart by their place, whatever their ids are
                probe = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column(text).cast(pa.string())], names=["doc_id", "text"])
                clean = np.ones(part.num_rows, bool)
                for found in search(iter([probe])):
                    clean[found.column(0).to_numpy()] = False
                yield part.filter(pa.array(clean))

    return run


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = 80, shingle: int = 5, bands: int = 64, seed: int = 11, block_items: int = 10_000, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs that hold no item, each judged by its own text: null and repeated ids make no difference.  No shuffle."""
    out = docs
    for block in item_blocks(items, block_items, block_bytes):
        index = ItemIndex([i for i, _ in block], [t for _, t in block], shingle, bands, seed)
        out = out.mapInArrow(clean_batches(index, percent, docs.columns.index("text")), docs.schema)
    return out
