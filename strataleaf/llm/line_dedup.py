"""Line deduplication with two Bloom filters.

Pass 1 hashes each document's lines. Each task sends the bits of what it has seen once and
twice, cut into chunks; merging fills a once-seen and a twice-seen filter for each chunk and
marks as twice-seen what two tasks have seen once. Pass 2 sends on only lines whose hash the
twice-seen filter holds; an exact count by the whole line confirms them and picks the
document that keeps the line. Only documents that lose lines (and those that share a bucket of
ids with one) move; the others are answered where they are read.

The twice-seen filter is broadcast. Its size is bounded by MAX_BITS, whatever the corpus: beyond
some MAX_BITS / BITS_PER_LINE lines it lets more lines through, in the end all of them, which
costs shuffle but never rows. The corpus is read three times at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.common import WS_CHARS, cut

BITS_PER_LINE = 8
MIN_BITS, MAX_BITS = 1 << 16, 1 << 30
#: Bits of one chunk of a filter.
CHUNK = 1 << 19
#: A repeated line is hot from 1/HOT_KEYS of the suspected lines on, but not below HOT_MIN of them; it meets its rows in SLICES tasks.
HOT_KEYS, HOT_MIN, SLICES = 1024, 256, 32
#: Buckets of ids, of which those with a document that loses lines are broadcast.
BUCKETS = 1 << 20
#: Hashes that a task holds before it reduces them to distinct ones.
HELD = 1 << 20
_SEEN_ONCE, _SEEN_TWICE = 1, 2
_LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    return line.strip(WS_CHARS).translate(_LOWER)


def keys_of(text: str | None, least: int) -> list[str | None]:
    """The key of each line, None where it is shorter than least."""
    raw = (text or "").encode("utf-8", "replace")
    # bytes.strip() and bytes.lower() know ASCII only, as the keys do.
    return [k if len(k) >= least else None for k in (x.strip().lower().decode("utf-8") for x in raw.split(b"\n"))]


def _hashes(keys: set[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each hash, as an (n, 2) array."""
    mask = np.uint64(bits - 1)
    return np.stack((hashes & mask, (hashes >> np.uint64(32)) & mask), axis=1).astype(np.int64)


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a filter holds each row of bits."""
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


class Seen:
    """Hashes that one task has seen once and twice; its memory grows with the task's lines, not with the filter."""

    def __init__(self):
        self.once, self.twice = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        """hashes: one of each line and document."""
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size > HELD:
            self.reduce()

    def reduce(self) -> None:
        values, counts = np.unique(np.concatenate((self.once, *self.held)), return_counts=True)
        self.twice = np.union1d(self.twice, values[counts > 1])
        self.once, self.held, self.size = values, [], 0

    def parts(self, bits: int) -> Iterator[tuple[int, int, bytes]]:
        """(chunk, kind, payload): the set bits of a filter, or a bitmap where that is shorter."""
        self.reduce()
        step = min(CHUNK, bits)
        for kind, hashes in ((_SEEN_ONCE, self.once), (_SEEN_TWICE, self.twice)):
            at = np.unique(_bits(hashes, bits).ravel())
            for part in np.split(at, np.flatnonzero(np.diff(at // step)) + 1):
                if len(part):
                    yield int(part[0] // step), kind, encode_bits(part % step, step)


def encode_bits(at: np.ndarray, bits: int) -> bytes:
    if 32 * len(at) < bits:
        return b"S" + at.astype(np.uint32).tobytes()
    bitmap = np.zeros(bits // 8, np.uint8)
    put(bitmap, at)
    return b"B" + bitmap.tobytes()


def decode_bits(payload: bytes, size: int) -> np.ndarray:
    if payload[:1] == b"B":
        return np.frombuffer(payload[1:], np.uint8)
    bits = np.zeros(8 * size, np.uint8)
    bits[np.frombuffer(payload[1:], np.uint32)] = 1
    return np.packbits(bits, bitorder="little")


def merge_parts(rows: Iterator[tuple[int, int, bytes]], size: int) -> Iterator[tuple[int, bytes]]:
    """(chunk, twice-seen bitmap) from parts that come sorted by chunk."""
    now, once, twice = None, None, None
    for chunk, kind, payload in rows:
        if chunk != now:
            if now is not None:
                yield now, twice.tobytes()
            now, once, twice = chunk, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        part = decode_bits(payload, size)
        if kind == _SEEN_TWICE:
            twice |= part
        else:
            twice |= once & part
            once |= part
    if now is not None:
        yield now, twice.tobytes()


def _twice_seen(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """The twice-seen filter of all lines; bits / 8 bytes, at most MAX_BITS / 8."""
    size = min(CHUNK, bits) // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for text in batch.column(0):
                if own := {x for x in keys_of(text.as_py(), least) if x is not None}:
                    seen.add(_hashes(own))
        for chunk, kind, payload in seen.parts(bits):
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "kind": [kind], "payload": [payload]}, pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c.as_py(), s.as_py(), p.as_py()) for b in batches for c, s, p in zip(*b.columns, strict=True))
        for chunk, payload in merge_parts(rows, size):
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "payload": [payload]}, pa.schema([("chunk", pa.int32()), ("payload", pa.binary())]))

    parts = docs.select("text").mapInArrow(fill, "chunk int, kind int, payload binary").repartition("chunk").sortWithinPartitions("chunk")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in parts.mapInArrow(merge, "chunk int, payload binary").toLocalIterator():
        bitmap[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["payload"], np.uint8)
    return bitmap


def _suspects(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """(doc_id, uid, key) of each document's lines that may occur in another document."""
    sent = docs.sparkSession.sparkContext.broadcast(_twice_seen(docs, bits, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            ids, uids, keys = [], [], []
            for name, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = list({x for x in keys_of(text.as_py(), least) if x is not None})
                if own:
                    chosen = [own[i] for i in np.flatnonzero(has(bitmap, _bits(_hashes(own), bits)))]
                    ids += [name] * len(chosen)
                    uids += [uid] * len(chosen)
                    keys += chosen
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(uids, pa.int64()), pa.array(keys, pa.string())], names=["doc_id", "uid", "key"])

    return docs.select("doc_id", "uid", "text").mapInArrow(run, "doc_id long, uid long, key string")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, keep: str = "max", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, kept_text, n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key
    of at least ``least_chars`` code points that ``least_docs`` rows or more hold loses its
    lines in all rows but the one with the largest id (``keep="min"``: smallest), which
    keeps all of them. Repeated rows count as documents each; those that share the chosen
    id all keep the line. A row with a null id loses such lines, and is never chosen unless
    only null ids hold the line, when nothing is lost. A null or empty text is one empty
    line. Very long texts and lines are handled as wholes, one document at a time. An empty
    table gives an empty result. Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("uid", F.coalesce("doc_id", F.xxhash64("text")))  # rows without an id are told apart by their texts
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))), F.count(F.lit(1))).first()
    wanted = BITS_PER_LINE * max(1, (lines[0] or 0) + lines[1])
    bits = min(max_bits, max(MIN_BITS, 1 << math.ceil(math.log2(wanted))))
    suspects = cut(_suspects(docs, bits, least_chars))
    chosen = F.max("doc_id") if keep == "max" else F.min("doc_id")
    repeated = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), chosen.alias("holder")).where(F.col("n") >= least_docs).where("holder IS NOT NULL")
    repeated = cut(repeated.withColumn("digest", F.xxhash64("key")))
    is_hot = F.col("n") >= max(HOT_MIN, math.ceil(suspects.count() / HOT_KEYS))
    # At most HOT_KEYS lines are hot: their digests tell which rows to deal out, and each comes once for every slice.
    hot = F.broadcast(repeated.where(is_hot).select("digest").distinct().withColumn("_hot", F.lit(True)))
    zero = F.lit(0).cast("long")
    # A line that is not hot may share its digest with one that is, so it comes for every slice too.
    slices = F.when(F.col("_hot"), F.sequence(zero, F.lit(SLICES - 1).cast("long"))).otherwise(F.array(zero))
    table = repeated.join(hot, "digest", "left").select("key", F.explode(slices).alias("slice"), "holder")
    dealt = suspects.withColumn("digest", F.xxhash64("key")).join(hot, "digest", "left").select("doc_id", "uid", "key", F.when(F.col("_hot"), F.pmod(F.xxhash64("uid"), F.lit(SLICES))).otherwise(zero).alias("slice"))
    met = dealt.join(table, ["key", "slice"])
    unnamed = F.col("doc_id").isNull().alias("unnamed")
    lost = cut(met.where("doc_id IS NULL OR doc_id <> holder").groupBy("uid", unnamed).agg(F.collect_set("key").alias("_lost")))
    bucket = F.pmod(F.xxhash64("uid", "unnamed"), F.lit(BUCKETS))
    touched = F.broadcast(lost.select(bucket.alias("bucket")).distinct().withColumn("_touched", F.lit(True)))
    docs = docs.withColumn("unnamed", unnamed).withColumn("bucket", bucket).join(touched, "bucket", "left")
    n_lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")).cast("long") + 1
    still = docs.where("_touched IS NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("kept_text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    joined = docs.where("_touched").join(lost, ["uid", "unnamed"], "left").select("doc_id", "text", "_lost")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, dropped = [], [], []
            for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                text, lost = text.as_py() or "", set(lost.as_py() or ())
                own = text.split("\n")
                stays = [x for x in own if line_key(x) not in lost] if lost else own
                kept.append("\n".join(stays) if len(stays) < len(own) else text)
                n.append(len(own))
                dropped.append(len(own) - len(stays))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "kept_text", "n_lines", "n_dropped"])

    return still.unionByName(joined.mapInArrow(apply, "doc_id long, kept_text string, n_lines long, n_dropped long"))
