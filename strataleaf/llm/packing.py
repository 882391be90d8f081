"""Packing documents into sequences by order-preserving dynamic programming.

Each input partition is one stream of token ids, in its own order. A window (sequence) may
be cut where a document or a sentence ends, or inside a long sentence at a dearer price.
The cuts minimise padding plus the prices of cuts inside documents:

    best(j) = price(j) + min over i with end(j) - end(i) <= size of best(i) + pad(end(j) - end(i))

pad is size minus length, so best(i) + end(i) decides among all i in reach and a monotone
queue yields its minimum in amortised constant time. A sequence of exactly a power of two
needs no padding; half a sequence is tried at every cut, and the end of a partition is laid
out as falling powers of two, which pads nothing. No text is shuffled.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prices of a cut at the end of a sentence inside a document, and inside a sentence.
SENTENCE, INSIDE = 1.0, 3.0
#: Sentences longer than this get further cuts, STEP tokens apart.
LONG, STEP = 16, 8
#: Tokens over which one dynamic program runs.
STREAM = 1 << 18
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of a text; an encoder of the same vocabulary does most of the work.

    The ``tokenizers`` file defines the ids. The BPE ranks beside it (``ranks``) give the
    same ids about four times as fast for texts without the special token's string; such
    texts, and all texts without a ranks file, go through ``tokenizers``.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None, special: str = "<|endoftext|>"):
        self.vocabulary, self.special, self.fast = vocabulary, special, None
        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @functools.cached_property
    def slow(self):
        """Read when the first text needs it: most partitions have none that does."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or self.special in text:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def sentence_ends(vocabulary: str) -> list[int]:
    """Ids of tokens that end a sentence or a line."""
    import json

    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    core = {i: piece.rstrip("\"')\u010a") for piece, i in vocab.items()}  # U+010A stands for a line feed
    return sorted(i for piece, i in vocab.items() if core[i][-1:] in (".", "!", "?") or "\u010a" in piece)


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions (ascending, the last one the stream's end) and the price of each."""
    mark = np.isin(ids, ends)
    at = np.union1d(np.flatnonzero(mark) + 1, doc_ends)
    gaps = np.diff(np.concatenate(([0], at)))
    long = np.flatnonzero(gaps > LONG)
    inner = [np.arange(at[k] - gaps[k] + STEP, at[k], STEP) for k in long]
    inside = np.concatenate(inner) if inner else np.zeros(0, np.int64)
    every = np.concatenate((at, inside))
    price = np.concatenate((np.full(len(at), SENTENCE), np.full(len(inside), INSIDE)))
    price[: len(at)][np.isin(at, doc_ends)] = 0.0
    order = np.argsort(every, kind="stable")
    return every[order], price[order]


def cuts(at: np.ndarray, price: np.ndarray, size: int, last: bool) -> tuple[list[int], float]:
    """The cheapest cut positions, and their cost. Unless last, they may end before the stream does."""
    ends, prices = [0, *at.tolist()], [0.0, *price.tolist()]
    n, half = len(ends), size // 2
    best, key, back = [0.0] * n, [0.0] * n, [0] * n
    queue, head = [0], 0  # places whose keys rise; those before head are out of reach
    mid = 0  # the first place that is not before the half-way point
    for j in range(1, n):
        e = ends[j]
        low = e - size
        while ends[queue[head]] < low:
            head += 1
        i = queue[head]
        cost = key[i] + size - e
        middle = e - half
        while ends[mid] < middle:
            mid += 1
        if ends[mid] == middle and best[mid] < cost:
            i, cost = mid, best[mid]
        cost += prices[j]
        best[j], back[j] = cost, i
        key[j] = k = cost + e
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not last:  # end where a token costs least so far
        near = [k for k in range(n - 1, 0, -1) if ends[k] >= ends[-1] - size]
        j = min(near, key=lambda k: best[k] / ends[k])
    out, cost = [], best[j]
    while j > 0:
        out.append(ends[j])
        j = back[j]
    return out[::-1], cost


def _powers(length: int) -> list[int]:
    """length as falling powers of two."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def _lay_out(at: np.ndarray, price: np.ndarray, size: int, last: bool) -> list[int]:
    found, _ = cuts(at, price, size, last)
    if last and found:
        start = found[-2] if len(found) > 1 else 0
        rest = found[-1] - start
        if rest < size:
            found = [*found[:-1], *(start + np.cumsum(_powers(rest))).tolist()]
    return found


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], ends: np.ndarray, size: int = 1024, base: int = 0, stream: int = STREAM) -> Iterator[dict[str, list]]:
    """Pieces of documents (id, token ids), in order, as columns of SCHEMA."""
    held: list[tuple[int | None, int, np.ndarray, int]] = []  # id, ids before, ids still to be placed, all its ids
    tokens, sequence = 0, base

    def place(last: bool) -> dict[str, list]:
        nonlocal held, tokens, sequence
        ids = np.concatenate([h[2] for h in held]) if held else np.zeros(0, np.uint32)
        lengths = np.array([len(h[2]) for h in held], np.int64)
        doc_ends = np.cumsum(lengths)
        doc_starts = doc_ends - lengths
        at, price = boundaries(ids, doc_ends, ends)
        found = np.array(_lay_out(at, price, size, last) if len(at) else [], np.int64)
        out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        end = int(found[-1]) if len(found) else 0
        points = np.union1d(np.concatenate(([0], found)), doc_starts)
        points = points[points < end]
        stops = np.concatenate((points[1:], [end])) if len(points) else points
        which = np.searchsorted(doc_ends, points, side="right")
        window = np.searchsorted(found, points, side="right")
        opened = np.concatenate(([0], found))[window]
        for a, b, d, w, o in zip(points.tolist(), stops.tolist(), which.tolist(), window.tolist(), opened.tolist(), strict=True):
            name, before, _, whole = held[d]
            row = (name, before + a - int(doc_starts[d]), b - a, zlib.crc32(ids[a:b].tobytes()), whole, sequence + w, a - o)
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        sequence += len(found)
        rest = []
        for (name, before, own, whole), a, b in zip(held, doc_starts.tolist(), doc_ends.tolist(), strict=True):
            if b > end:
                skip = max(0, end - a)
                rest.append((name, before + skip, own[skip:], whole))
        held, tokens = rest, int(doc_ends[-1]) - end if len(doc_ends) else 0
        return out

    for name, own in docs:
        done = 0
        while done < len(own):  # a very long document passes through in parts
            part = own[done : done + stream]
            held.append((name, done, part, len(own)))
            tokens += len(part)
            done += len(part)
            if tokens >= stream:
                yield place(False)
    while tokens:
        yield place(True)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of a document: SCHEMA.

    A document is its token ids and then ``end_id``; null and empty texts are that id alone.
    Each id lies in exactly one piece, pieces of a sequence are gapless from offset 0, and
    documents keep the order in which their partition is read. Repeated rows are packed once
    each; null ids stay null. ``sequence_id`` is partition number * 2^32 + number within.
    An empty table gives an empty result. Other columns are ignored. ``vocabulary``,
    ``ranks`` and ``pattern``: see Encoder; the files must be at that path on every executor.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ends = sentence_ends(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = Encoder(vocabulary, ranks, pattern), np.array(ends)

        def tokens():
            for batch in batches:
                for name, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield name.as_py(), np.array([*encode(text.as_py()), end_id], np.uint32)

        for out in pack_stream(tokens(), stop, size, TaskContext.get().partitionId() << 32):
            yield pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.int64()) for k in out]))

    return source.mapInArrow(run, SCHEMA)
