"""Near-duplicate classes by b-bit MinHash.

Method
------
1. One pass over the texts gives each document its shingle-set size, a 128-bit
   identity of the set, a packed signature (the low ``bits`` bits of ``k``
   minima) and one key per band of ``rows`` full minima.
2. Documents with the same set are one class; its smallest doc_id stands for it.
   Only representatives go on, so thousands of copies cost one row.
3. Candidates: in each band bucket every member meets one hub, the member that
   stands for the most copies (in later turns the most by a hash), never all
   others.  Pairs that meet in two bands or more and whose collision-corrected
   similarity, estimated by counting equal b-bit cells with bit operations, is
   not far below the threshold are confirmed on their full shingle sets, for
   each member the two most similar ones.
4. Confirmed links are closed to components by minimum-label propagation, and
   step 3 is repeated between the components that remain, with other hubs.
5. What buckets still hold of different components is searched exactly and
   without pairing the members of a bucket: the shingles of these documents are
   ordered by how few of them hold it, and a pair can only reach the threshold
   if it shares a shingle among the first few of both (prefix filtering, with
   the bound that the places of the shared shingle set).  In each shingle's list
   the component with the most members is not paired with itself.  A straggler
   with too many shingles of its own meets nobody, however large its group is.
   Pairs inside one component need no comparison, as they could not change the
   result.  So no link is dropped and there is no cap on a bucket.

A pair at the threshold 0.8 misses all 42 bands with probability
``(1 - 0.8**6)**42 < 3e-6``; one that meets in a band is found for certain.  The work of step 5 is
quadratic only in a family of different texts that share rare shingles, are each
just short of the threshold and belong to no common component.

Defined results: null and empty texts have no shingles, are linked with nothing
and are their own component; a text of fewer words than the shingle size has its
whole word sequence as its only shingle.  Rows that repeat a doc_id are all
returned; if their texts differ, each row has the component of its own text.  A
null doc_id never becomes a component id; a row without id has the component of
the rows with an id and the same shingle set, and if there is none, its component
is null and it is kept.  Other columns of the input are not looked at,
so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.textops import WordHashes, hash_functions, pieces, saved, shingle_set, utf8

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_hi long, set_lo long, sig binary, bands array<long>"


def set_identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed numbers."""
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def signature_batches(k: int, bands_: int, rows: int, bits: int, shingle: int, seed: int):
    """A mapInArrow function (doc_id, text) -> SIGNATURE_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (xor, mul) = WordHashes(), hash_functions(k, seed)
        band_mul = np.random.default_rng(seed + 1).integers(0, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for part in pieces(batch):
                sets = [shingle_set(words.of(t.lower().split()), shingle) for t in utf8(part.column(1))]
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                minima = np.empty((len(full), k), np.uint32)
                if len(full):
                    # runs of documents of about 64k shingles stay in the CPU's cache
                    ends = np.cumsum(size[full])
                    cut = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + 65536, 65536), "left").clip(0, len(full)))
                    cut = np.unique(np.r_[0, cut, len(full)])
                    for a, b in zip(cut[:-1], cut[1:], strict=True):
                        h = np.concatenate([sets[i] for i in full[a:b]])
                        h32 = (h ^ (h >> np.uint64(32))).astype(np.uint32)
                        starts = np.r_[0, np.cumsum(size[full[a:b]])[:-1]]
                        for j in range(k):
                            minima[a:b, j] = np.minimum.reduceat((h32 ^ xor[j]) * mul[j], starts)
                sig, bands, hi, lo = [b""] * part.num_rows, [[]] * part.num_rows, np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                if len(full):
                    low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint8)
                    packed = np.packbits(((low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1).transpose(0, 2, 1).reshape(len(full), -1), axis=1)
                    keys = (minima[:, : bands_ * rows].reshape(len(full), bands_, rows).astype(np.uint64) * band_mul).sum(axis=2)
                    keys = ((keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(bands_, dtype=np.uint64)).view(np.int64)
                    for i, d in enumerate(full):
                        sig[d], bands[d] = packed[i].tobytes(), keys[i]
                        hi[d], lo[d] = set_identity(sets[d])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(size), pa.array(hi), pa.array(lo), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_hi", "set_lo", "sig", "bands"],
                )

    return run


def signatures(docs: DataFrame, k: int = 256, bands: int = 32, rows: int = 4, bits: int = 4, shingle: int = 4, seed: int = 7) -> DataFrame:
    """One row per document: set size and identity, packed b-bit signature, band keys.  No shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(signature_batches(k, bands, rows, bits, shingle, seed), SIGNATURE_SCHEMA)


def unpacked(df: DataFrame, k: int, bits: int) -> DataFrame:
    """The binary signature as 64-bit numbers, so that a comparison is xor, or and bit_count only."""
    n = k * bits // 64
    num = [F.expr(f"cast(conv(hex(substring(sig, {8 * i + 1}, 8)), 16, -10) as bigint)") for i in range(n)]
    return df.withColumn("cells", F.array(*num)).drop("sig")


def similar_cells(a: str, b: str, k: int, bits: int) -> F.Column:
    """Collision-corrected similarity of two unpacked signatures, by bit counts.

    A signature holds bit plane after bit plane, k bits each: a cell is equal if
    none of its planes differ, so the planes' xors are or-ed and the set bits
    counted.  Two unequal minima agree on b bits with chance 2**-b.
    """
    per = k // 64
    differ = " + ".join("bit_count(" + " | ".join(f"({a}[{p * per + i}] ^ {b}[{p * per + i}])" for p in range(bits)) + ")" for i in range(per))
    return F.expr(f"((1 - ({differ}) / {float(k)}) - {2.0**-bits}) / {1 - 2.0**-bits}")


def set_batches(shingle: int):
    """A mapInArrow function (id, n, set_hi, text) -> (id, n, shingles) of the texts that have that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in pieces(batch):
                sets = [shingle_set(words.of(t.lower().split()), shingle) for t in utf8(part.column(3))]
                own = [i for i, (s, hi) in enumerate(zip(sets, part.column(2).to_pylist(), strict=True)) if set_identity(s)[0] == hi]
                got = part.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], names=["id", "n", "shingles"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full shingle sets have the similarity; two joins on the id, each may be split by AQE."""
    of = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.expr(f"both > 0 and 100 * both >= {percent} * (size(sa) + size(sb) - both)")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node with an edge: the smallest id reachable, by minimum-label propagation with pointer jumping.

    Each round's labels are written to the checkpoint folder.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    e = saved(edges.where("a <> b").select(both.alias("e")).select("e.a", "e.b").distinct())
    label = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("comp"))
    label = saved(label)
    while True:
        near = e.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = label.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = saved(step.join(jump, "comp", "left").select("id", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        if new.where("comp <> was").isEmpty():
            return new.select("id", "comp")
        label = new.select("id", "comp")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp(id, comp) after its components are joined by links(a, b) between ids."""
    of = lambda x: comp.select(F.col("id").alias(x), F.col("comp").alias(f"x{x}"))
    roots = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("xa").alias("a"), F.col("xb").alias("b")).distinct())
    return saved(comp.join(roots.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))


def prefix_pairs(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) across components among which are all pairs of sets(id, n, shingles) with the similarity.

    A pair of n and m shingles needs an overlap of o = t / (1 + t) * (n + m).  Let
    both sets be in one order, rare shingles first, and the first one that they
    share be at places i and j (from 0): then o <= min(n - i, m - j).  As the sizes
    are within the threshold of each other, i is less than n - t * n + 1.
    """
    t = percent / 100
    flat = sets.select("id", "n", F.explode("shingles").alias("s"))
    common = saved(flat.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    # shingles of one document only come first; the others by their number of documents
    placed = flat.join(common, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    places = placed.select("id", "n", F.posexplode(F.slice("o", F.lit(1), F.greatest(F.lit(0), F.size("o") - F.ceil(F.col("n") * t).cast("int") + 1))).alias("at", "x"), F.size("o").alias("k"))
    lists = saved(places.select("id", "n", (F.col("n") - F.col("k") + F.col("at")).alias("p"), F.col("x.s").alias("s")).join(comp, "id"))
    # the component with the most members of each list, if there is another one
    sizes = lists.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("c"))
    top = saved(sizes.groupBy("s").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("s", F.col("top.comp").alias("top")))
    right = saved(lists.join(top, "s"))
    left = right.where("comp <> top").select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("comp").alias("xa"))
    right = right.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("comp").alias("xb"))
    fits = F.expr(f"xa <> xb and 100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * least(na - pa, nb - pb) >= {percent} * (na + nb)")
    return left.join(right, "s").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, k: int = 256, bands: int = 42, rows: int = 6, bits: int = 4, slack: float = 0.13, rounds: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    percent: the least similarity; slack: how far below it an estimate may lie
    for a hub's pair to be confirmed (five standard deviations at k=256);
    rounds: turns with hubs before the exact search.
    """
    least = percent / 100 - slack
    sig = saved(signatures(docs, k, bands, rows, bits, shingle, seed).withColumn("row", F.monotonically_increasing_id()))
    # (a written table, so that a set that very many rows have may be split by AQE in the join)
    rep = saved(sig.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.col("row"))).alias("rep"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and rep is not null"))
    member = sig.join(rep, ["set_hi", "set_lo"], "left")
    member = member.select("doc_id", "n_shingles", "set_hi", "sig", "bands", F.coalesce("low", "doc_id").alias("low"), F.coalesce("copies", F.lit(1)).alias("copies"), F.expr("row = coalesce(rep, row)").alias("first"), F.coalesce("rep", F.expr("if(n_shingles > 0 and doc_id is not null, row, null)")).alias("id"))
    # one row for each class, which its first row stands for
    nodes = saved(member.where("first and id is not null"))
    keys = nodes.select("id", "copies", F.explode("bands").alias("band"))
    bucket = keys.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band")
    shared = saved(keys.join(bucket, "band"))  # members of buckets with more than one class
    met = saved(shared.select("id").distinct())
    cells = saved(unpacked(nodes.join(met, "id", "left_semi").select("id", "n_shingles", "sig"), k, bits))
    side = lambda x: cells.select(F.col("id").alias(x), F.col("cells").alias(f"c{x}"), F.col("n_shingles").alias(f"n{x}"))
    sized = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    # the sets that may have to be compared, made once, from the texts that stand for a class
    standing = nodes.join(met, "id", "left_semi").select("doc_id", "id", F.col("n_shingles").alias("n"), "set_hi")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = saved(texts.join(standing, "doc_id").select("id", "n", "set_hi", "text").mapInArrow(set_batches(shingle), "id long, n long, shingles array<long>").dropDuplicates(["id"]))
    comp = saved(met.select("id", F.col("id").alias("comp")))
    for turn in range(rounds):
        # members against the hub of their bucket, another one each turn, if of another component
        here = saved(shared.join(comp, "id"))
        weight = F.col("copies") if turn == 0 else F.lit(0)
        hubs = saved(here.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max(F.struct(weight.alias("w"), F.xxhash64(F.lit(turn), "comp", "id").alias("h"), F.col("id").alias("b"), F.col("comp").alias("x"))).alias("hub")).where("c0 < c1").select("band", "hub.b", "hub.x"))
        pairs = here.join(hubs, "band").where("comp <> x").groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
        likely = pairs.join(side("a"), "a").join(side("b"), "b").where(sized).withColumn("s", similar_cells("ca", "cb", k, bits)).where(F.col("s") >= least)
        # each member's most similar one, among those of even and of odd hash
        odd = F.pmod(F.xxhash64("b"), F.lit(2)) == 1
        best = likely.groupBy("a").agg(F.max_by("b", F.when(odd, F.struct("s", "b"))).alias("b0"), F.max_by("b", F.when(~odd, F.struct("s", "b"))).alias("b1"))
        best = best.select("a", F.explode(F.array("b0", "b1")).alias("b")).where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # (the driver plans, and submits the stages of, the search and the confirmation one after the other)
        best = saved(best)
        links = saved(confirmed(best, sets, percent))
        if links.isEmpty():
            break
        comp = merged(comp, links)
    # what the turns did not join: members of buckets with more than one component, exactly
    here = shared.join(comp, "id")
    open_ = saved(here.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band"))
    rest = here.join(open_, "band", "left_semi").select("id").distinct()
    extra = saved(confirmed(prefix_pairs(saved(sets.join(rest, "id", "left_semi")), comp, percent), sets, percent))
    if not extra.isEmpty():
        comp = merged(comp, extra)
    # a component is named by the smallest doc_id of its classes
    named = nodes.select("id", "low").join(comp, "id")
    names = named.groupBy("comp").agg(F.min("low").alias("root"))
    roots = saved(named.join(names, "comp").select("id", "root"))
    out = member.select("doc_id", "n_shingles", "low", "id").join(roots, "id", "left")
    root = F.coalesce("root", "low")
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.col("doc_id").eqNullSafe(root).alias("kept"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each group of near duplicates.

    Rows are told apart by a number of their own, not by doc_id: rows without id
    are nodes like all others, and of rows that repeat a doc_id with different
    texts each belongs to its own text's group.  The row that stays has the
    group's smallest number.
    """
    at, names = "_watchloom_row", docs.columns
    rows = saved(docs.withColumn(at, F.monotonically_increasing_id()))
    kept = near_duplicates(rows.select(F.col(at).alias("doc_id"), "text"), **options).where("kept").select(F.col("doc_id").alias(at))
    return rows.join(kept, at, "left_semi").select(*names)
