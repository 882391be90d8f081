"""Toxicity behind obfuscation: a noisy channel, then a linear score of the restored text.

1. A character language model (trigrams over a small alphabet) is counted over all documents.
2. Words that may be disguised - leetspeak inside a word, drawn-out letters, letters spaced
   out - span a lattice of readings with channel prices; Viterbi decoding under the language
   model restores the likeliest one. The word as written is always one of the readings.
3. Restored words and their beginnings are features of a logistic model, learned from a
   bounded, hash-ordered sample of the labelled rows that are not held out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The alphabet: a-z, word boundary, any other letter.
EDGE, FOREIGN, SYMBOLS = 26, 27, 28
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
DIMENSIONS = 1 << 20
#: Features on fewer sampled rows carry no weight.
LEAST_ROWS = 8
#: Features carry weight only where at least this share of their rows is toxic.
LEAST_LEAN = 0.75
EPOCHS, RATE, DECAY = 10, 0.1, 1e-5
#: Beginnings of words that are features beside the words.
PREFIXES = (4, 5)
FOLDS = 5

# Readings of a character in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
#: Prices (negative natural logarithms): a letter as written, a substitute, a dropped separator, a dropped repeat in a drawn-out run.
CLEAN, SWAP, SKIP, REPEAT = 0.02, 1.2, 0.5, 0.3
#: Price of dropping a character that could be a substitute.
LOSE = 8.0

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W_]|[@$!|+€£])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+€£])){3,}(?![^\W\d_])")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_MIXED = re.compile(r"[^\W\d_].*[0-9@$!|+€£(\-_.*].*[^\W\d_]|[0-9@$!|+€£(].*[^\W\d_].*[^\W\d_]")
#: Addresses and digests: what looks like a disguise in them is none.
_PLAIN = re.compile(r"[\w.+-]{2,}@(?:[\w-]{2,}\.)+[a-z]{2,}|[0-9a-f]{16,}|(?:https?://|www\.).*")
_LETTER = re.compile(r"[^\W\d_]")
_TRIM = ".,;:!?\"'()[]{}<>*#%&|~`^=/\\„“”‚‘’«»…-_"


def _base_letters() -> np.ndarray:
    """Code point -> symbol for the Basic Multilingual Plane: a-z without their marks, else edge or foreign letter."""
    import unicodedata

    table = np.full(1 << 16, EDGE, np.uint8)
    for c in range(1 << 16):
        if 0xD800 <= c <= 0xDFFF:
            continue
        x = chr(c)
        if x.isalpha():
            low = unicodedata.normalize("NFD", x.lower())[0] if c < 0x250 else x
            table[c] = ord(low) - 97 if "a" <= low <= "z" else FOREIGN
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_base_letters())
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[0][np.minimum(codes, 0xFFFF)]


def count_trigrams(texts: Iterator[str]) -> np.ndarray:
    counts = np.zeros(SYMBOLS**3, np.int64)
    for text in texts:
        s = np.concatenate(([EDGE], symbols(text), [EDGE])).astype(np.int64)
        counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """Prices of the third symbol after the first two, backed off to pairs and single symbols."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
    p2 = (c2 + 50 * p1) / (c2.sum(axis=1, keepdims=True) + 50)
    p3 = (c3 + 20 * p2) / (c3.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3)


def corpus_model(texts: DataFrame) -> np.ndarray:
    """Trigram counts over the whole column ``text``; the table has SYMBOLS^3 entries at any size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            # Texts of a batch are counted in one go, with an edge between them.
            part, size = [], 0
            for x in batch.column(0):
                part.append(x.as_py() or "")
                size += len(part[-1])
                if size > 1 << 22:
                    counts += count_trigrams(iter(["  ".join(part)]))
                    part, size = [], 0
            if part:
                counts += count_trigrams(iter(["  ".join(part)]))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    for row in texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row["at"]] = row["n"]
    return counts


class Decoder:
    """Restores words under the language model."""

    def __init__(self, prices: np.ndarray):
        self.prices = prices.tolist()
        self.known: dict[str, str] = {}

    def decode(self, word: str) -> str:
        """The cheapest reading of a lower-case word; letters, substitutes and separators in it span the lattice."""
        if word in self.known:
            return self.known[word]
        # A state is the last two symbols; it holds its price and its reading as a chain (rest, letter).
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        before = ""
        codes = symbols(word).tolist()
        for k, (ch, code) in enumerate(zip(word, codes, strict=True)):
            readings: list[tuple[str, int, float]] = []
            if code < EDGE or code == FOREIGN:
                readings.append((ch, code, CLEAN))
            for r in LEET.get(ch, ""):
                readings.append((r, ord(r) - 97, SWAP))
            drawn = ch == before and (word[k - 2 : k] == ch * 2 or word[k + 1 : k + 2] == ch)
            drop = REPEAT if drawn else (LOSE if ch in LEET else SKIP) if code == EDGE else None
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (price, chain) in states.items():
                row = self.prices[a][b]
                for r, c, p in readings:
                    total = price + p + row[c]
                    if (b, c) not in new or total < new[b, c][0]:
                        new[b, c] = (total, (chain, r))
                if drop is not None:
                    total = price + drop
                    if (a, b) not in new or total < new[a, b][0]:
                        new[a, b] = (total, chain)
            states = new or states
            before = ch
        chain = min(states.items(), key=lambda s: s[1][0] + self.prices[s[0][0]][s[0][1]][EDGE])[1][1]
        letters = []
        while chain is not None:
            chain, letter = chain
            letters.append(letter)
        best = "".join(reversed(letters))
        if len(self.known) < 200_000:
            self.known[word] = best
        return best

    def restore(self, text: str) -> list[str]:
        """Lower-case words of the text, restored where they look disguised, and words that spaced letters spell."""
        low = text.lower()
        out = []
        for word in _WORDS.findall(low):
            core = word.strip(_TRIM)
            if not core:
                continue
            if not core.isalpha() and _PLAIN.fullmatch(core):
                out.append(core)
                continue
            if not core.isalpha() and _MIXED.search(core) or _DRAWN.search(core):
                core = self.decode(core)
            elif (word[0] in LEET or word[-1] in LEET) and _LETTER.search(core):
                core = self.decode(word.strip("".join(c for c in _TRIM if c not in LEET))) if len(word) - len(core) == 1 and word[-1] not in "!|" else core
            out.append(core)
        if "  " in low or _SPACED.search(low):
            out += [self.decode(re.sub(r"[ .\-_*]", "", m[0])) for m in _SPACED.finditer(low)]
        return out


def features(words: list[str]) -> np.ndarray:
    """Distinct hashed features of restored words, ascending."""
    import zlib

    found = set()
    for w in set(words):
        found.add("w" + w)
        for n in PREFIXES:
            if len(w) > n:
                found.add(f"{n}{w[:n]}")
    return np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) % DIMENSIONS for x in found), np.int64, len(found)))


def fit(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights by adaptive gradient steps, the bias last. Only features that lean towards toxic rows have one."""
    weights = np.zeros(DIMENSIONS + 1, np.float32)
    toxic, seen = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for at, y in rows:
        seen[at] += 1
        toxic[at] += y
    base = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    lean = (toxic + 2 * base) / (seen + 2)
    use = (seen >= LEAST_ROWS) & (lean > max(2 * base, LEAST_LEAN))
    bias, pace, bias_pace = math.log(base / (1 - base)), np.full(DIMENSIONS, 1e-6), 1e-6
    kept = [(at[use[at]], y) for at, y in rows]
    # Each feature starts from its own log-odds, so that a rare word weighs as it should from the first step.
    w = np.where(use, np.log((toxic + base) / (seen - toxic + 1 - base)) - bias, 0.0)
    for _ in range(EPOCHS):
        for at, y in kept:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + w[at].sum()))))
            g = p - y
            if len(at):
                step = g + DECAY * w[at]
                pace[at] += step * step
                w[at] -= RATE * step / np.sqrt(pace[at])
            bias_pace += g * g
            bias -= RATE * g / math.sqrt(bias_pace)
    weights[:DIMENSIONS], weights[DIMENSIONS] = w, bias
    return weights


def score(weights: np.ndarray, at: np.ndarray) -> float:
    x = float(weights[DIMENSIONS]) + float(weights[at].sum())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    held_out: crc32 of the id as text, modulo FOLDS, is 0; such rows teach no label. A null
    id is not held out and has no label. At most ``sample`` labelled rows, those with the
    smallest hash of the id, teach the model; the language model counts all documents.
    Null and empty texts get the score of a text without features. Without labels, or with
    labels of one kind only, scores rest on the label share. Very long texts and words are
    read as a whole, in time that grows with their length. Repeated rows get one score
    each. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    prices = language_model(corpus_model(rows.select("text")))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.where(fold("doc_id") != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # At most ``sample`` pairs, so the broadcast is bounded.
    marked = rows.join(F.broadcast(known), "doc_id").select("y", "text")

    def learn_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(prices)
        for batch in batches:
            found = [features(decoder.restore(x.as_py())).astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["y", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught = [(np.frombuffer(a.as_py(), np.int32), y.as_py()) for b in batches for y, a in zip(*b.columns, strict=True)]
        taught.sort(key=lambda r: (r[1], len(r[0]), r[0].tobytes()))
        order = np.random.default_rng(7).permutation(len(taught))
        weights = fit([taught[k] for k in order])
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["at", "w"])

    weights = np.zeros(DIMENSIONS + 1, np.float32)
    # One task fits the model; it gets at most ``sample`` rows.
    for row in marked.mapInArrow(learn_features, "y int, at binary").repartition(1).mapInArrow(learn, "at long, w float").collect():
        weights[row["at"]] = row["w"]
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((prices, at, weights[at]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices, at, w = sent.value
        full = np.zeros(DIMENSIONS + 1, np.float32)
        full[at] = w
        decoder = Decoder(prices)
        for batch in batches:
            found = [score(full, features(decoder.restore(x.as_py()))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(judge, "doc_id long, score double")
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
