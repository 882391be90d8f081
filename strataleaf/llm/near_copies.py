"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least ``least``.

Texts with the same set stand for each other. Candidates are links of SimHash fingerprints and
pairs that share a band of MinHash values; each is confirmed on the two whole sets, so no text
is linked to one that is not that similar. With 32 bands of five values a pair at 0.8 shares
none with a chance of 3 in a million, one at 0.9 with less than 1 in 10^12.

Members of a band are first compared with its smallest id, which joins most of them. Bands
whose members still lie in several components are then gone through: in one of at most FEW
members, pairs of different components are compared. A larger one is dealt into tiles of a
bounded number of shingles, and each two tiles are compared inside one task, from which none
but links come. Texts of those with more than MANY members are first dealt out again, each
once, by 32 fresh bands, in which members of a family meet more of each other; what lies
apart after that goes to tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.common import FEW_KEYS, ROW, cut_gathered, join_sliced, of_keys, release
from strataleaf.llm.simhash import BITS, components, contract, links

ROWS, BANDS = 5, 32
#: Members of a band up to which its pairs of different components are listed and compared one by one: at most 3.5 pairs a member.
FEW = 8
#: Members of a band from which on it is dealt out again, and how often that is done.
MANY = 1024
DEALS = 1
#: Shingles of a tile, on average; a task holds two tiles at a time.
TILE = 1 << 20
SHINGLES_SCHEMA = "doc_id long, shingles binary"


def _hashers(deal: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of the MinHash values of a deal."""
    rng = np.random.default_rng(5 + deal)
    return rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def digests(text: str | None, width: int) -> np.ndarray:
    """A 64-bit digest of each word shingle; fewer words than width: one of the whole sequence."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)


def _fingerprint(found: np.ndarray) -> int:
    """SimHash of the digests, as in simhash.fingerprint."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 8192):
        ones += np.unpackbits(found[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little")


def band_keys(shingles: np.ndarray, hashers: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """One key for each band of MinHash values of a set of digests."""
    import xxhash

    factors, terms = hashers
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * factors + terms).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(low.reshape(BANDS, ROWS))]


def _lists(keys: list[int], n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(np.array(keys, np.uint64).view(np.int64)))


def _marks(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, SimHash fp, number of distinct shingles, a digest of their set, and band keys."""
    hashers = _hashers(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fps, sizes, whole, keys = [], [], [], []
            for text in batch.column(1):
                found = digests(text.as_py(), width)
                fps.append(_fingerprint(found))
                shingles = np.unique(found)
                sizes.append(len(shingles))
                whole.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys += band_keys(shingles, hashers)
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), _lists(keys, len(sizes))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "n", "whole", "keys"])

    return docs.mapInArrow(run, "doc_id long, fp long, n long, whole binary, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, and the sorted distinct digests of its shingles; one row for each set of an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(digests(x.as_py(), width)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, SHINGLES_SCHEMA).distinct()


def _fresh_keys(sets: DataFrame, deal: int) -> DataFrame:
    """doc_id and the band keys of a later deal."""
    hashers = _hashers(deal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for found in batch.column(1) for k in band_keys(np.frombuffer(found.as_py(), np.uint64), hashers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(keys, batch.num_rows)], names=["doc_id", "fresh"])

    return sets.mapInArrow(run, "doc_id long, fresh array<long>")


def _banded(members: DataFrame, total: int) -> DataFrame:
    """(key, doc_id, n, size, first) of the bands (key, doc_id, n) with two members or more; first is the smallest id."""
    bands = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first")).where(F.col("size") > 1)
    bands = cut_gathered(bands, total // 2 * ROW)
    if bands.count() <= FEW_KEYS:
        return cut_gathered(members.join(F.broadcast(bands), "key"), total * 2 * ROW)
    return cut_gathered(join_sliced(members, bands, "key", "size", F.col("doc_id"), total), total * 2 * ROW)


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _confirmed(sets: DataFrame, pairs: DataFrame, least: float, n_ids: int) -> DataFrame:
    """Those of the distinct pairs (u, v) of ids that have a Jaccard similarity of at least ``least``, reduced to stars in each partition.

    ``n_ids``: how many ids there are at most. The same Python worker compares and reduces.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                hit[k] = both >= least * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit)), batch.column(1).filter(pa.array(hit))], names=["u", "v"])

    ends = F.explode(F.array(F.struct(F.col("u").alias("doc_id"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")), F.struct(F.col("v").alias("doc_id"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v"))))
    times = cut_gathered(pairs.select(ends.alias("e")).groupBy("e.doc_id").agg(F.sum("e.as_u").alias("n_u"), F.sum("e.as_v").alias("n_v")), n_ids * ROW)
    n_ids, n = times.agg(F.count(F.lit(1)), F.sum("n_u")).first()
    made = sets.join(F.broadcast(times) if n_ids <= FEW_KEYS else times, "doc_id")
    v_sets = made.where("n_v > 0").select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"), F.col("n_v").alias("m"))
    u_sets = made.where("n_u > 0").select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"), F.col("n_u").alias("m"))
    with_v = join_sliced(pairs, v_sets, "v", "m", F.col("u"), n or 0).drop("m")
    full = join_sliced(with_v, u_sets, "u", "m", F.col("v"), n or 0).select("u", "v", "a", "b")
    return full.mapInArrow(lambda batches: contract(compare(batches)), "u long, v long")


def _tile_links(members: list[tuple[int, int, int, bytes]], least: float) -> pa.RecordBatch:
    """Links that join the components of one tile pair's members (doc_id, root, side, shingles).

    Side 0 is looked up, side 1 asks, side 2 does both. An inverted index from shingles to
    members counts what two sets share.
    """
    ids, roots, side = (np.array([m[k] for m in members], np.int64) for k in range(3))
    sets = [np.frombuffer(m[3], np.uint64) for m in members]
    label = np.unique(roots, return_inverse=True)[1]
    held = np.flatnonzero(side != 1)
    u, v = [], []
    if len(held):
        sizes = np.array([len(sets[k]) for k in held])
        every = np.concatenate([sets[k] for k in held])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(held)), sizes)[order]
        for k in np.flatnonzero(side != 0):
            low, high = np.searchsorted(every, sets[k], "left"), np.searchsorted(every, sets[k], "right")
            runs = high - low
            at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            both = np.bincount(owner[at], minlength=len(held))
            near = held[both >= least * (sizes + len(sets[k]) - both)]
            near = near[label[near] != label[k]]
            for other, first in zip(*np.unique(label[near], return_index=True), strict=True):
                u.append(ids[k])
                v.append(ids[near[first]])
                label[label == other] = label[k]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _tiled(sets: DataFrame, members: DataFrame, least: float, n_members: int) -> DataFrame:
    """Confirmed links between members (key, doc_id, n, root) of different components that share a key, reduced to stars in each partition.

    Keys with the same members are gone through once. Time grows with the square of a key's
    members, as all that could be told apart or joined before has been; memory does not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, group = None, []
        for batch in batches:
            for key, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != tile and group:
                    yield _tile_links(group, least)
                    group = []
                tile = key
                group.append(member)
        if group:
            yield _tile_links(group, least)

    spread = F.xxhash64("doc_id")
    total, weight = F.count(F.lit(1)).alias("m"), F.ceil(F.sum("n") / F.lit(TILE)).cast("long").alias("t")
    keys = members.groupBy("key").agg(total, weight, F.bit_xor(spread).alias("who"))
    keys = cut_gathered(keys.groupBy("who", "m").agg(F.min("key").alias("key"), F.max("t").alias("t")).select("key", "m", "t"), n_members * ROW)
    n, n_placed = keys.agg(F.sum("m"), F.sum(F.col("m") * F.col("t"))).first()
    placed = join_sliced(members, keys, "key", "m", F.col("doc_id"), n or 0).withColumn("own", F.pmod(spread, F.col("t")))
    placed = placed.select("key", "doc_id", "root", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)).alias("o"))
    low, high = F.least("own", "o"), F.greatest("own", "o")
    side = F.when(low == high, 2).when(F.col("own") == low, 0).otherwise(1)
    placed = cut_gathered(placed.select("doc_id", "root", F.xxhash64("key", low, high).alias("tile"), side.cast("long").alias("side")), (n_placed or 0) * 2 * ROW)
    times = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    full = join_sliced(placed, sets.join(times, "doc_id"), "doc_id", "m", F.col("tile")).select("tile", "doc_id", "root", "side", "shingles")
    return full.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda batches: contract(run(batches)), "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, radius: int = 6) -> DataFrame:
    """One row per distinct id: doc_id and component_id, the smallest id reachable over confirmed pairs.

    Texts without a word are copies of each other. Rows that share an id are one document
    that is linked if one of them is; null ids are left out. A very long text is compared as
    a whole. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    marked = cut_gathered(_marks(docs, width))
    # One text stands for all with its set: the smallest id, so its band keys and its size are theirs.
    one = F.min(F.struct("doc_id", "fp", "n", "keys")).alias("one")
    stand = cut_gathered(marked.groupBy("whole").agg(one, F.count(F.lit(1)).alias("copies")).select("whole", "one.*", "copies"))
    placed = join_sliced(marked.select("whole", "doc_id"), stand.select("whole", F.col("doc_id").alias("stand"), "copies"), "whole", "copies", F.col("doc_id"))
    texts = stand.select("doc_id", "fp", "n", "keys")
    alike = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")

    n_texts, n_shingles = texts.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_shared = BANDS * n_texts
    shared = _banded(texts.select(F.explode("keys").alias("key"), "doc_id", "n"), n_shared)
    stars = shared.select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    nodes = cut_gathered(texts.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("size")), n_texts * ROW)
    edges = links(nodes.select("fp"), radius)
    linked = edges.join(nodes.select(F.col("fp").alias("u"), F.col("least_id").alias("_u")), "u").join(nodes.select(F.col("fp").alias("v"), F.col("least_id").alias("_v")), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    equal = join_sliced(texts.select("doc_id", "fp"), nodes, "fp", "size", F.col("doc_id"), n_texts).select(F.col("doc_id").alias("u"), F.col("least_id").alias("v"))
    first = cut_gathered(_distinct(stars.unionByName(linked).unionByName(equal)), n_shared * ROW)
    # Every later candidate shares a band, so these are all the texts that are ever compared.
    release(docs.sparkSession)
    compared = shared.select("doc_id").unionByName(first.select(F.explode(F.array("u", "v")).alias("doc_id")))
    sets = cut_gathered(_sets(of_keys(docs, compared, "doc_id"), width), 8 * (n_shingles or 0) + n_texts * ROW)
    keep = lambda stars: cut_gathered(stars, 2 * n_texts * ROW)
    found = _confirmed(sets, first, least, n_texts)
    # Rows that share an id may have several sets; they are one document.
    same = placed.where("doc_id <> stand").select(F.col("doc_id").alias("u"), F.col("stand").alias("v"))
    roots = keep(components(found.unionByName(same), keep=keep, reduced=True))
    release(docs.sparkSession)

    for deal in range(DEALS + 1):
        now = shared.join(roots.withColumnRenamed("u", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", "size", F.coalesce("root", "doc_id").alias("root"))
        open_keys = now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("size").alias("m")).where("a < b").select("key", "m")
        apart = cut_gathered(join_sliced(now, open_keys, "key", "m", F.col("doc_id"), n_shared).drop("m"), n_shared * 2 * ROW)
        last = deal == DEALS
        dealt_out = F.lit(False) if last else F.col("size") > MANY
        n_apart, n_large, n_again = apart.agg(F.count(F.lit(1)), F.count_if((F.col("size") > FEW) & ~dealt_out), F.count_if(dealt_out)).first()
        if not n_apart:
            break
        small = apart.where(F.col("size") <= FEW)
        other = small.select("key", F.col("doc_id").alias("v"), F.col("n").alias("m"), F.col("root").alias("_root"))
        pairs = small.withColumnRenamed("doc_id", "u").join(other, "key").where((F.col("root") < F.col("_root")) & alike).select("u", "v")
        if n_again:
            # A text of several such bands is dealt out once: whoever shares one of them with it shares fresh bands too, if at all.
            large = cut_gathered(apart.where(dealt_out).select("doc_id", "n").distinct(), n_again * ROW)
            n_shared = BANDS * large.count()
            fresh = _fresh_keys(sets.join(large.select("doc_id").distinct(), "doc_id", "left_semi"), deal + 1)
            spread = large.join(fresh, "doc_id").select(F.explode("fresh").alias("key"), "doc_id", "n").distinct()
            shared = _banded(cut_gathered(spread, n_shared * ROW), n_shared)
            pairs = pairs.unionByName(shared.select(F.col("doc_id").alias("u"), F.col("first").alias("v")))
            release(docs.sparkSession)
        more = _confirmed(sets, cut_gathered(_distinct(pairs), (FEW * n_apart + n_shared) * ROW), least, n_texts)
        if n_large:
            more = more.unionByName(_tiled(sets, apart.where((F.col("size") > FEW) & ~dealt_out), least, n_large))
        roots = keep(components(roots.select("u", F.col("root").alias("v")).unionByName(more), keep=keep, reduced=True))
        release(docs.sparkSession)
        if not n_again:
            break
    ids = marked.select("doc_id").distinct()
    return ids.join(roots.withColumnRenamed("u", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
