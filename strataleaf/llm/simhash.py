"""SimHash near-duplicates with BK-trees.

Fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit blocks, so
each distinct fingerprint goes to one shard for every block. A shard's fingerprints form a
BK-tree (children keyed by their integer Hamming distance to the parent) which travels with
the shard to its task; a query follows only the edges within the radius of its distance.
A shard above ``SPLIT`` members is dealt out again by blocks of the bits that it does not
fix, and what is still above ``TREE`` members is searched tree against tree, in tiles. No
member is left out at any step. Links inside a shard shrink to a star per component before
they leave the task; stars of all shards are joined by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.common import cut, join_sliced

#: Members from which a shard is dealt out again, and members of one tree at most.
SPLIT = 512
TREE = 4096
#: Visits (query, node) that are held at once.
FRONTIER = 1_000_000
BITS = 64


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned SimHash of word shingles; fewer words than width: the whole sequence; none: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    n, ones = len(first), np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        part = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first[at : at + 8192], last[at : at + 8192], strict=True)), np.uint64, min(8192, n - at))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit fp, one row per input row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _signed([fingerprint(x.as_py(), width) for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """BK-trees of many shards, built and searched level by level.

    ``shard`` holds each member's shard number, in ascending order; members of a shard are
    distinct. The first member of a shard is its root.
    """

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp = fp
        n = len(fp)
        new = np.concatenate(([True], shard[1:] != shard[:-1])) if n else np.zeros(0, bool)
        roots = np.flatnonzero(new)
        self.root = roots[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
        left = np.flatnonzero(~new)
        at = self.root[left]
        edges: list[np.ndarray] = []
        children: list[np.ndarray] = []
        while len(left):
            key = at * (BITS + 1) + _popcount(fp[left] ^ fp[at])
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            edges.append(key[first])
            children.append(left[first])
            at = left[first][np.cumsum(first) - 1]
            left, at = left[~first], at[~first]
        key = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def near(self, query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, member index) of all pairs within the radius, a part at a time."""
        step = 8192
        stack = [(np.arange(a, min(a + step, len(query))), root[a : a + step]) for a in range(0, len(query), step)]
        while stack:
            q, at = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], at[:half]), (q[half:], at[half:])]
                continue
            d = _popcount(query[q] ^ self.fp[at])
            hit = d <= radius
            if hit.any():
                yield q[hit], at[hit]
            base = at * (BITS + 1)
            lo = np.searchsorted(self.key, base + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, base + np.minimum(d + radius, BITS), side="right") - lo
            if total := int(n.sum()):
                edge = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
                stack.append((np.repeat(q, n), self.child[edge]))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indexes reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(before, label):
            break
    return label


def _stars(fp: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links member -> smallest index of its component, for whole shards."""
    forest = Forest(fp, shard)
    label = np.arange(len(fp))
    for q, at in forest.near(fp, forest.root, radius):
        use = q > at
        if use.any():
            label = _labels_onto(label, q[use], at[use])
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[at], fp[label[at]]


def _labels_onto(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    joined = _labels(len(label), label[a], label[b])
    return joined[label]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by key, regrouped so that no key spans two parts."""
    rest: dict[str, np.ndarray] = {}
    for batch in batches:
        part = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if rest:
            part = {n: np.concatenate((rest[n], part[n])) for n in part}
        change = np.flatnonzero(part["key"][1:] != part["key"][:-1])
        if not len(change):
            rest = part
            continue
        cut_at = change[-1] + 1
        yield {n: v[:cut_at] for n, v in part.items()}
        rest = {n: v[cut_at:] for n, v in part.items()}
    if rest and len(rest["key"]):
        yield rest


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


def _search(shards: DataFrame, radius: int) -> DataFrame:
    """Stars of whole shards (key, fp)."""

    def run(batches):
        for part in _groups(batches):
            yield _pairs(*_stars(part["fp"].view(np.uint64), part["key"], radius)) if len(part["fp"]) else _pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def signed(batches):
        for batch in run(batches):
            yield _pairs(batch.column(0).to_numpy().view(np.int64), batch.column(1).to_numpy().view(np.int64))

    return shards.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(signed, "u long, v long")


def _search_tiles(tiles: DataFrame, radius: int) -> DataFrame:
    """Stars of tiles (key, side, fp): side 0 makes the tree; side 1 only asks."""

    def run(batches):
        for part in _groups(batches):
            fp, key, side = part["fp"].view(np.uint64), part["key"], part["side"]
            for group in np.split(np.arange(len(fp)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                tree, ask = group[side[group] == 0], group[side[group] == 1]
                if not len(tree):
                    continue
                forest = Forest(fp[tree], np.zeros(len(tree), np.int64))
                both = np.concatenate((fp[tree], fp[ask]))
                label = np.arange(len(both))
                for q, at in forest.near(both, np.zeros(len(both), np.int64), radius):
                    use = q > at
                    if use.any():
                        label = _labels_onto(label, q[use], at[use])
                low = np.flatnonzero(label != np.arange(len(both)))
                yield _pairs(both[low].view(np.int64), both[label[low]].view(np.int64))

    return tiles.repartition("key").sortWithinPartitions("key", "side", "fp").mapInArrow(run, "u long, v long")


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    """Bits dealt into runs of nearly the same length."""
    size, more = divmod(len(bits), parts)
    out, at = [], 0
    for k in range(parts):
        n = size + (k < more)
        out.append(bits[at : at + n])
        at += n
    return out


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(fps: DataFrame, radius: int = 4, split: int = SPLIT, tree: int = TREE) -> DataFrame:
    """Links (u, v) among the distinct values of fps.fp whose components are those of all links within radius bits."""
    blocks = _blocks(list(range(BITS)), radius + 1)
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_mask(b)))).alias("key")) for k, b in enumerate(blocks)]))
    shards = fps.select("fp", one.alias("s")).select("s.block", "s.key", "fp")
    # There are at most (radius + 1) * 2^(longest block) keys here, so the large ones can be broadcast.
    large = F.broadcast(shards.groupBy("key").count().where(F.col("count") > split).select("key"))
    small = _search(shards.join(large, "key", "left_anti").select("key", "fp"), radius)
    deeper = []
    for k, fixed in enumerate(blocks):
        free = [b for j, bs in enumerate(blocks) if j != k for b in bs]
        deeper.append(F.when(F.col("block") == k, F.array(*[F.xxhash64(F.col("key"), F.lit(j), F.col("fp").bitwiseAND(F.lit(_mask(b)))) for j, b in enumerate(_blocks(free, radius + 1))])))
    again = shards.join(large, "key", "left_semi").select("fp", F.explode(F.coalesce(*deeper)).alias("key"))
    sizes = again.groupBy("key").count().where(F.col("count") > tree)
    dealt = again.join(sizes, "key", "left")
    second = _search(dealt.where("count IS NULL").select("key", "fp"), radius)
    n = F.ceil(F.col("count") / F.lit(tree)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("n"))
    placed = dealt.where("count IS NOT NULL").select("key", "fp", n.alias("n")).select("key", "fp", own.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("o"))
    low, high = F.least("t", "o"), F.greatest("t", "o")
    tiles = placed.select(F.xxhash64("key", low, high).alias("key"), (F.col("t") != low).cast("int").alias("side"), "fp")
    return small.unionByName(second).unionByName(_search_tiles(tiles, radius))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one partition as stars: each node but the smallest of its component, and that one."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = _labels(len(nodes), at[: len(u)], at[len(u) :])
        low = np.flatnonzero(label != np.arange(len(nodes)))
        for k in range(0, len(low), 1 << 18):
            yield _pairs(nodes[low[k : k + (1 << 18)]], nodes[label[low[k : k + (1 << 18)]]])


def _flat(now: DataFrame) -> tuple[bool, int]:
    """Whether the edges (u, v) are stars: each u once, and never as a centre. And their number."""
    ends = now.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    nodes = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    most, both, n = nodes.agg(F.max("low"), F.max(F.when(F.col("low") > 0, F.col("top")).otherwise(0)), F.sum("low")).first()
    return (most or 0) <= 1 and not both, n or 0


def components(edges: DataFrame, most_rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = cut, reduced: bool = False) -> DataFrame:
    """(u, root) for every node of the edges (u, v), by alternating large and small stars; roots map to themselves.

    Each partition first reduces its edges to stars, which name a node beside the centre once;
    edges of a node then meet, at most one from each partition, and join their centres. A
    star's centre can have a large share of the edges: its rows are dealt out in slices.
    ``keep`` writes the edges of a round. ``reduced``: partitions of edges have been reduced.
    """
    alone = edges.where("u <> v").select("u", "v")
    if not reduced:
        alone = alone.mapInArrow(contract, "u long, v long")
    now = keep(alone.repartition("u").mapInArrow(contract, "u long, v long").distinct())
    size = F.count(F.lit(1)).alias("size")
    for _ in range(most_rounds):
        done, n = _flat(now)
        if done:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m"), size).select("u", F.least("u", "m").alias("m"), "size")
        large = join_sliced(both.where("v > u"), lows, "u", "size", F.col("v"), 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"), size)
        small = join_sliced(large, lows, "u", "size", F.col("v"), 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        now = keep(small)
    else:
        raise RuntimeError("the components did not settle")
    return now.select("u", F.col("v").alias("root")).unionByName(now.select("v").distinct().select(F.col("v").alias("u"), F.col("v").alias("root")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, split: int = SPLIT, tree: int = TREE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest id that is reachable over links of at most ``radius``
    differing bits, the own id included. Texts without a word (null, empty, white space)
    have fingerprint zero and are linked like any other. A null id gets the component of
    its fingerprint. Repeated rows get equal answers. A very long text is read as a whole,
    its shingles some thousand at a time. An empty table gives an empty result; other
    columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("size")))
    edges = links(nodes.select("fp"), radius, split, tree)
    roots = components(edges).select(F.col("u").alias("fp"), "root")
    placed = cut(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    ids = cut(join_sliced(placed, least, "root", "members", F.col("fp"), placed.count()).select("fp", "component_id", "size"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_sliced(marked, ids, "fp", "size", F.col("doc_id"), marked.count()).select("doc_id", hexed.alias("fingerprint"), "component_id")
