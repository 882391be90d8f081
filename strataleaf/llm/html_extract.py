"""Main text of HTML pages: a suffix array over each host's pages, and the structure of the page.

A page becomes blocks of text. A block is article text, chrome (a menu, a header, an
advert ...) or open (outside both). Chrome never is main text. What else is boilerplate is
decided over all pages of a host:

* The token streams of open and chrome blocks are concatenated, with a separator of its own
  after each page, and a suffix array sorted by prefix doubling gives the classes of suffixes
  whose first ``run`` tokens are equal. Each task does so for its own pages, part by part, and
  sends one row for each class: its key and its number of pages. As a page lies in one part
  only, the sums over all parts are the numbers of pages of the whole host, however the pages
  were dealt out. Tokens in a run that begins on ``pages`` pages or more are removed.
* In an article, where passages may rightly recur, only suffixes that begin with a block and
  run to its end count, and only blocks on at least HOST_SHARE of the host's pages go.

A page that consists of such runs for the most part is a copy of other pages and keeps its text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.common import UPPER, attach, cut, join_skewed

RUN, PAGES = 8, 3
#: Share of a host's pages from which on a block inside their articles is boilerplate.
HOST_SHARE = 0.5
#: A page is a copy where at least this share of its text would go.
COPY = 0.8
#: Beside an article, an open block of fewer tokens is not main text.
ASIDE = 25
#: Tokens of which one suffix array is built.
PART = 1 << 18

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are chrome whatever they hold, and elements that are unless they hold the article or most of the text.
CHROME = frozenset("nav footer aside menu head button select svg math object canvas audio video".split())
LIKELY = frozenset("form dialog search header".split())
#: Whole class names, ids and roles that mark chrome, under the same condition; also followed by a number, or as PLACE-name or name-PART.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside complementary footer contentinfo masthead topbar toolbar "
    "comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup login search widget".split()
)
PLACES = "site page main top bottom left right global primary secondary mobile"
PARTS = "area bar block body box button buttons container content footer form header item items link links list menu nav panel post posts section slot thread title unit widget wrap wrapper"
_NAME = re.compile(rf"(?:(?:{PLACES.replace(' ', '|')})[-_])?(?P<name>[a-z]+)(?:[-_](?:{PARTS.replace(' ', '|')}))?(?:[-_]?\d+)?")
ARTICLE, OPEN, OTHER = 0, 1, 2

_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    + rf"|<(?P<raw>{'|'.join(RAW)})\b{_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    + rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>{_ATTRS})>"
    + r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>"
    + r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z",
    re.S | re.I,
)
_MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)


def _named(attrs: str) -> bool:
    """Whether a whole class name, id or role marks chrome."""
    for a, b, c in _MARKS.findall(attrs):
        for token in (a or b or c).lower().split():
            if (m := _NAME.fullmatch(token)) and m["name"] in NAMES:
                return True
    return False


class _Open:
    """An open element that marks chrome or an article; ``number`` is None for an article."""

    __slots__ = ("depth", "number", "tag")

    def __init__(self, tag: str, number: int | None):
        self.tag, self.number, self.depth = tag, number, 1


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each non-empty block in page order; references decoded, white space collapsed."""
    page = page or ""
    found: list[tuple[str, bool, tuple[int, ...]]] = []  # text, in an article, numbers of the chrome elements around it
    parts: list[str] = []
    stack: list[_Open] = []
    firm: list[bool] = []  # of each chrome element: whether it is chrome whatever it holds
    holds: set[int] = set()  # chrome elements that hold an article

    def close() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                found.append((text, any(x.number is None for x in stack), tuple(x.number for x in stack if x.number is not None)))
            parts.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        ends, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if tag in BLOCK or any(x.tag == tag for x in stack):
            close()
        elif tag == "br":
            parts.append(" ")
        if stack and stack[-1].tag == "p" and tag in BLOCK:  # a paragraph ends where a block begins or ends
            stack.pop()
            if ends and tag == "p":
                continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    stack[k].depth -= 1
                    if not stack[k].depth:
                        del stack[k:]
                    break
        elif tag not in VOID and not attrs.endswith("/"):
            inside = any(x.number is None for x in stack)
            named = tag not in ("html", "body") and bool(attrs) and _named(attrs)
            if tag in CHROME or named or tag in LIKELY and not (tag == "header" and inside):
                close()
                stack.append(_Open(tag, len(firm)))
                firm.append(tag in CHROME)
            elif tag in ("article", "main") or "role" in attrs and _ROLE.search(attrs):
                stack.append(_Open(tag, None))
                holds.update(x.number for x in stack if x.number is not None)
            elif same := [x for x in stack if x.tag == tag]:
                same[-1].depth += 1
    if at < len(page):
        parts.append(page[at:])
    close()
    whole = sum(len(t) for t, _, _ in found)
    inner = [0] * len(firm)
    for text, _, around in found:
        for k in around:
            inner[k] += len(text)
    chrome = {k for k in range(len(firm)) if firm[k] or k not in holds and 2 * inner[k] <= whole}
    return [(OTHER if not chrome.isdisjoint(around) else ARTICLE if article else OPEN, text) for text, article, around in found]


def suffix_classes(ids: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by the first ``run`` tokens, and each suffix's class: equal classes, equal first tokens.

    Prefix doubling: classes of length k make those of up to 2k.
    """
    rank, known = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    n = len(ids)
    while known < run:
        step = min(known, run - known)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        known += step
    return np.argsort(rank, kind="stable"), rank


_RANDOM = np.random.default_rng(8)
_FACTORS = _RANDOM.integers(0, 1 << 63, (2, 4096), np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))


def _salted(words: np.ndarray, host: str, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """A key of two numbers for each row of word hashes (rows, words), of a host and a kind of key."""
    import xxhash

    own = xxhash.xxh3_128_intdigest(f"{kind}:{host}".encode("utf-8", "replace"))
    size = words.shape[1]
    out = []
    for k, salt in enumerate((own & (1 << 64) - 1, own >> 64)):
        out.append((words * np.resize(_FACTORS[k], size)).sum(axis=1, dtype=np.uint64) * np.uint64(2 * size + 1) + np.uint64(salt))
    return out[0].view(np.int64), out[1].view(np.int64)


def _block_key(text: str, host: str) -> tuple[int, int]:
    """Key of the suffix that begins with a block and runs to its end."""
    import xxhash

    own = xxhash.xxh3_128_intdigest(f"{ARTICLE}:{host}\n{text}".encode("utf-8", "replace"))
    low, high = own & (1 << 64) - 1, own >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def class_rows(host: str, pages: list[list[tuple[int, str]]], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (two columns) and numbers of pages of the suffix classes of the open and chrome blocks of pages of one host."""
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    for k, page in enumerate(pages):
        for kind, text in page:
            if kind != ARTICLE:
                ids += [vocabulary.setdefault(w, len(vocabulary)) for w in text.split(" ")]
        ids.append(-1 - k)
    tokens = np.array(ids, np.int64)
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n <= run:
        return none, none, none
    page_of = np.concatenate(([0], np.cumsum(tokens < 0)[:-1]))
    order, rank = suffix_classes(tokens, run)
    sorted_rank, sorted_page = rank[order], page_of[order]
    new = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
    # The sort is stable and pages ascend, so a page that differs from its left neighbour is a new one.
    fresh = new.copy()
    fresh[1:] |= sorted_page[1:] != sorted_page[:-1]
    starts = np.flatnonzero(new)
    count = np.add.reduceat(fresh.astype(np.int64), starts)
    first = order[starts]
    # A run that would go beyond its page holds a separator.
    last_of = np.append(np.flatnonzero(tokens < 0), n)
    fits = first + run <= last_of[np.searchsorted(last_of, first)]
    first, count = first[fits], count[fits]
    hashes = _word_hashes(list(vocabulary))
    low, high = _salted(hashes[tokens[first[:, None] + np.arange(run)]], host, OPEN)
    return low, high, count


def page_keys(host: str, page: list[tuple[int, str]], run: int = RUN) -> tuple[list[tuple[int, int]], tuple[np.ndarray, np.ndarray], list[int]]:
    """Of a page: the key of each article block of ``run`` tokens at least, the keys of its stream's runs, and their starts in it.

    The stream holds open and chrome blocks, as in class_rows; without an open block, nothing hangs on it.
    """
    whole = [_block_key(text, host) for kind, text in page if kind == ARTICLE and text.count(" ") + 1 >= run]
    words = [w for kind, text in page if kind != ARTICLE for w in text.split(" ")] if any(kind == OPEN for kind, _ in page) else []
    if len(words) < run:
        return whole, (np.zeros(0, np.int64),) * 2, []
    hashes = _word_hashes(words)
    return whole, _salted(np.lib.stride_tricks.sliding_window_view(hashes, run), host, OPEN), list(range(len(words) - run + 1))


def main_text(page: list[tuple[int, str]], host: str, boilerplate: set[tuple[int, int]], run: int = RUN) -> str:
    """The page's text without the runs and blocks whose keys are boilerplate."""
    has_article = any(kind == ARTICLE for kind, _ in page)
    covered = np.zeros(0, bool)
    if boilerplate:
        _, (low, high), starts = page_keys(host, page, run)
        covered = np.zeros(len(starts) + run if starts else 0, bool)
        for k, key in zip(starts, zip(low.tolist(), high.tolist(), strict=True), strict=True):
            if key in boilerplate:
                covered[k : k + run] = True
    every: list[str] = []
    kept: list[str] = []
    at = 0
    for kind, text in page:
        words = text.split(" ")
        if kind == ARTICLE:
            every.append(text)
            if not boilerplate or len(words) < run or _block_key(text, host) not in boilerplate:
                kept.append(text)
            continue
        hidden = covered[at : at + len(words)] if len(covered) else covered
        at += len(words)
        if kind == OPEN and (not has_article or len(words) >= ASIDE):
            every.append(text)
            stays = [w for w, h in zip(words, hidden.tolist(), strict=True) if not h] if len(hidden) else words
            if len(stays) >= (ASIDE if has_article else 1):
                kept.append(" ".join(stays))
    if sum(map(len, kept)) <= (1 - COPY) * sum(map(len, every)):
        kept = every
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least_pages: int = PAGES, part: int = PART) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null or empty html gives an empty text, as does a page that is all chrome. Pages with
    a null url, or one without ``://``, count as one host. Repeated rows count as pages of
    their own; equal rows get equal texts. A page is read as a whole however long it is; one
    longer than ``part`` tokens makes a suffix array of its own. An empty table gives an empty
    result. Other columns are ignored.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, UPPER.lower())
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            hosts, kinds, lows, highs, numbers = [], [], [], [], []
            for name, own in held.items():
                whole: dict[tuple[int, int], int] = {}
                for page in own:
                    for key in {_block_key(t, name) for kind, t in page if kind == ARTICLE and t.count(" ") + 1 >= run}:
                        whole[key] = whole.get(key, 0) + 1
                low, high, n = class_rows(name, own, run)
                kinds += [OTHER, *[ARTICLE] * len(whole), *[OPEN] * len(n)]
                lows += [0, *(k[0] for k in whole), *low.tolist()]
                highs += [0, *(k[1] for k in whole), *high.tolist()]
                numbers += [len(own), *whole.values(), *n.tolist()]
                hosts += [name] * (1 + len(whole) + len(n))
            held, size = {}, 0
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int8()), *(pa.array(x, pa.int64()) for x in (lows, highs, numbers))], names=["host", "kind", "k1", "k2", "n"])

        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                page = blocks(text.as_py())
                held.setdefault(name, []).append(page)
                size += 1 + sum(t.count(" ") + 1 if kind != ARTICLE else 1 + len(t) // 64 for kind, t in page)
                if size > part:
                    yield flush()
        if held:
            yield flush()

    counted = cut(rows.select("html", "host").mapInArrow(count, "host string, kind byte, k1 long, k2 long, n long").groupBy("host", "kind", "k1", "k2").agg(F.sum("n").alias("n")).where(F.col("n") >= F.when(F.col("kind") == OTHER, F.lit(1)).otherwise(F.lit(least_pages))))
    totals = counted.where(F.col("kind") == OTHER).select("host", F.col("n").alias("total"))
    # At most 1/SHARE hosts can have so many of the pages.
    everywhere = totals.agg(F.sum("total")).first()[0] or 0
    in_articles = join_skewed(counted.where(F.col("kind") == ARTICLE), totals, ["host"], F.col("total") >= max(256, math.ceil(everywhere / 1024))).where(F.col("n") >= HOST_SHARE * F.col("total"))
    boilerplate = cut(counted.where(F.col("kind") == OPEN).select("k1", "k2", "n").unionByName(in_articles.select("k1", "k2", "n")))

    def name_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, lows, highs = [], [], []
            for uid, text, name in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                page = blocks(text.as_py())
                whole, (low, high), _ = page_keys(name, page, run)
                keys = {*whole, *zip(low.tolist(), high.tolist(), strict=True)}
                uids += [uid] * len(keys)
                lows += [k[0] for k in keys]
                highs += [k[1] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.string()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["uid", "k1", "k2"])

    # Equal rows have equal texts, so a digest of what decides the text names the page.
    named = rows.withColumn("uid", F.md5(F.concat_ws("\n", F.col("host"), F.coalesce("html", F.lit(""))).cast("binary")))
    if boilerplate.isEmpty():
        marked = named.withColumn("keys", F.lit(None).cast("array<struct<k1:bigint,k2:bigint>>"))
    else:
        keyed = named.select("uid", "html", "host").mapInArrow(name_keys, "uid string, k1 long, k2 long")
        occurrences = boilerplate.agg(F.sum("n")).first()[0]
        # A key on 1/1024 of all places or more is one of 1,024 at most.
        hits = join_skewed(keyed, boilerplate, ["k1", "k2"], F.col("n") >= max(256, math.ceil(occurrences / 1024)))
        found = hits.groupBy("uid", "k1", "k2").agg(F.count(F.lit(1)).alias("copies")).groupBy("uid").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"), F.max("copies").alias("copies"))
        hot_page = F.col("copies") >= max(256, math.ceil(everywhere / 1024))
        marked = attach(named, found, "uid", "keys", hot_page, F.xxhash64("page_id", "url").cast("string"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, name, keys in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                texts.append(main_text(blocks(text.as_py()), name, {(k["k1"], k["k2"]) for k in keys.as_py() or ()}, run))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return marked.select("page_id", "url", "html", "host", "keys").mapInArrow(clean, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
