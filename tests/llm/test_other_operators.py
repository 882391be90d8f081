"""Language ID, mixing, toxicity, URL filters, packing and HTML extraction."""

import html as html_lib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataleaf.llm import common
from strataleaf.llm import html_extract as H
from strataleaf.llm import language_id as I
from strataleaf.llm import mixing as M
from strataleaf.llm import packing as P
from strataleaf.llm import queries
from strataleaf.llm import toxicity as X
from strataleaf.llm import url_filter as U

PAGES = "page_id long, url string, html string, host string, place string, text string, template string"


def page_rows():
    pages = [
        (1, "http://A.example.org/es/1?x", "<html lang='es'><p>hola"),
        (2, "https://b.example.net/en/12.html#t", None),
        (3, None, "<article><p>x</p></article>"),
        (4, "no scheme", ""),
        (4, "no scheme", ""),
        (None, "http://example.org", "<nav>m</nav>"),
        (7, "http://example.org/en/1", "<p>" + "long text " * 40_000),
        (8, "ftp://x.com/fr/a/b/c/d?://q", "<p>a<p>b"),
    ]
    return [(i, u, h, "h", "p", "t", "m") for i, u, h in pages]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(page_rows(), PAGES)


@pytest.fixture(scope="module")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)


# --- language ID -------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    got = I.identify(I.document_rows(docs.where(held_out)), docs.where(~held_out)).join(docs.withColumnRenamed("lang", "truth"), "doc_id")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("truth")).cast("int"))).first()
    assert right / n > 0.97


def test_language_edges(spark, docs, no_docs, pages):
    rows = I.document_rows(docs).unionByName(I.page_rows(pages))
    got = I.identify(rows, docs)
    assert got.count() == docs.count() + pages.count()
    assert got.where("lang IS NULL OR confidence NOT BETWEEN 0 AND 1").count() == 0
    assert I.identify(I.document_rows(no_docs), docs).count() == 0
    assert I.identify(I.document_rows(docs), no_docs).where("lang IS NOT NULL").count() == 0


def test_markup_and_host_decide_where_the_text_is_silent(spark, small_docs):
    words = [r["text"][:600] for r in small_docs.where("lang = 'fr'").limit(30).collect()]
    made = [(k, "http://fr.host.example/x", f"<html lang=fr><p>{t}") for k, t in enumerate(words)] + [(100, "http://fr.host.example/y", "<html lang=fr><p>12"), (101, "http://fr.host.example/z", "<p>12")]
    rows = I.page_rows(spark.createDataFrame(made, "page_id long, url string, html string"))
    got = {r["page_id"]: r["lang"] for r in I.identify(rows, small_docs).collect()}
    assert got[100] == "fr" and got[101] == "fr"


@pytest.mark.parametrize("hot", [256, 2])  # hosts that are dealt out in slices
def test_language_matches_a_model(spark, small_docs, monkeypatch, hot):
    """The whole result against a model with loops: evidence, and priors that leave the row itself out."""
    monkeypatch.setattr(common, "HOT_MIN", hot)
    rng = random.Random(4)
    taught = small_docs.where("doc_id % 2 = 0")
    texts = {x: [r["text"][:200] for r in small_docs.where(F.col("lang") == x).limit(20).collect()] for x in ("de", "en", "es", "fr")}
    hosts = ["a.one.com", "b.one.com", "two.com", "x.three.de", "y.three.de", "four.fr", "localhost", "de"]
    made = []
    for k in range(120):
        host, lang = rng.choice(hosts), rng.choice(sorted(texts))
        declared = f"<html lang={rng.choice(['de', 'en', lang])}>" if k % 3 else "<html>"
        made.append((k, f"http://{host}/{k}", declared + rng.choice(["12", "und", rng.choice(texts[lang])[: rng.choice([8, 40, 200])]])))
    got = {r["page_id"]: r for r in I.identify(I.page_rows(spark.createDataFrame(made, "page_id long, url string, html string")), taught, sample=10**6).collect()}

    known = taught.where("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    profiles = I.fit_profiles(known, languages)
    rows, n = [], len(languages)
    for k, url, html in made:
        ll = I.likelihoods(profiles, html, True)
        host = url.split("/")[2]
        end = host.split(".")[-1]
        country = end if "." in host and len(end) == 2 else None
        declared = re.search(r"lang=(\w+)", html)
        share = [math.exp(x) / sum(map(math.exp, ll)) for x in ll]
        rows.append((k, ll, share, ("all", host, ".".join(host.split(".")[-2:]), "" if country else end), declared and declared[1], country))

    def chance(at, value, lang):
        own = [r for r in rows if r[at] == value]
        seen = [r for r in rows if r[at] is not None]
        part = (sum(sum(r[2]) for r in own) + 1) / (sum(sum(r[2]) for r in seen) + 1)
        return (sum(r[2][lang] for r in own) + I.SMOOTH * part) / (sum(r[2][lang] for r in seen) + I.SMOOTH)

    for row in rows:
        others = [r for r in rows if r is not row]
        prior = [(sum(r[2][k] for r in others) + 1) / (len(others) + n) for k in range(n)]
        for level in (3, 2, 1):
            near = [r for r in others if r[3][level] == row[3][level]]
            prior = [(sum(r[2][k] for r in near) + I.SMOOTH * prior[k]) / (len(near) + I.SMOOTH) for k in range(n)]
        logs = [row[1][k] + math.log(prior[k]) + sum(math.log(chance(at, row[at], k)) for at in (4, 5) if row[at]) for k in range(n)]
        best = max(range(n), key=lambda k: logs[k])
        found = got[row[0]]
        assert found["lang"] == languages[best] and found["declared"] == row[4]
        assert found["confidence"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs), abs=1e-6)


# --- mixing ------------------------------------------------------------------------------------


CELLS = [("a", "en", "x", 900), ("a", "de", "x", 50), ("a", "en", "y", 50), ("b", "en", "x", 100), ("b", "de", "y", 200), ("c", "de", "x", 300)]


@pytest.mark.parametrize("small", [M.SMALL, 0])  # by the driver, and dealt out
def test_fit_meets_its_targets_under_the_bound(spark, small):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    shares = {"source": {"a": 0.4, "b": 0.3, "c": 0.3}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.75, "y": 0.25}}
    targets = {d: spark.createDataFrame(list(s.items()), "v string, s double") for d, s in shares.items()}
    fitted = M.fit(cells, 0.5, targets, sweeps=80, small=small)
    assert fitted.where("mass > tokens").count() == 0
    for d, want in shares.items():
        got = {r[d]: r["m"] / 800 for r in fitted.groupBy(d).agg(F.sum("mass").alias("m")).collect()}
        assert got == pytest.approx(want, abs=2e-3)


def test_default_targets_can_be_reached(spark):
    cells = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 90), ("d", 0), ("e", 10)], "source string, tokens long")
    got = {r["source"]: r["_share"] for r in M.default_target(cells, "source", 0.5, 0.9).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["d"] == 0
    assert all(got[s] <= n / 10_000 / 0.9 + 1e-12 for s, n in (("a", 9000), ("b", 900), ("c", 90), ("e", 10)))
    assert got["b"] == pytest.approx(0.1) and got["a"] == pytest.approx(1 - 1000 / 9000)


def test_kept_tokens_have_the_target_margins(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet")
    for share in (0.9, 0.6):
        got = M.mix(docs, share=share).cache()
        whole = got.agg(F.sum("n_tokens")).first()[0]
        cells = got.groupBy(*M.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
        for d in M.DIMENSIONS:
            want = {r[d]: r["_share"] for r in M.default_target(cells, d, M.POWERS[d], share).collect()}
            have = {r[d]: r["e"] / (share * whole) for r in got.groupBy(d).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("e")).collect()}
            assert have == pytest.approx(want, abs=3e-3), d
        kept = got.agg(F.sum(F.when(F.col("kept"), F.col("n_tokens")))).first()[0]
        assert kept / whole == pytest.approx(share, abs=0.03)
        assert got.where("probability > 1").count() == 0


def test_mixing_edges(docs, no_docs):
    got = M.mix(docs)
    assert got.count() == docs.count()
    assert got.where("doc_id = 4 AND source = '(none)' AND lang = '(none)' AND n_tokens = 0 AND kept").count() == 1
    assert got.where("doc_id = 8").select("kept").distinct().count() == 1
    assert M.mix(no_docs).count() == 0
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


# --- toxicity ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def decoder(small_docs):
    return X.Decoder(X.language_model(X.count_trigrams(r["text"] for r in small_docs.collect())))


@pytest.mark.parametrize(("written", "read"), [("w0rthl3ss", "worthless"), ("p@thetic", "pathetic"), ("tr4sh", "trash"), ("l0ser", "loser"), ("idiooooot", "idiot"), ("stuuupid", "stupid"), ("m.o.r.o.n", "moron"), ("i d i o t", "idiot"), ("$tupid", "stupid"), ("worthless", "worthless"), ("plain,", "plain")])
def test_decoding(decoder, written, read):
    assert read in decoder.restore(f"so {written} it")


def test_decoding_leaves_plain_text(decoder):
    text = "Ouwhea the of rend and, threlyes (ofthstthor) nd."
    assert decoder.restore(text) == ["ouwhea", "the", "of", "rend", "and", "threlyes", "ofthstthor", "nd"]
    assert decoder.restore("") == [] and decoder.restore("!!! ### 12") == ["12"]


def readings(word):
    """All readings of a word with their channel prices, symbol by symbol."""
    parts = []
    for k, ch in enumerate(word):
        code = int(X.symbols(ch)[0])
        options = [(ch, X.CLEAN)] if code != X.EDGE else []
        options += [(r, X.SWAP) for r in X.LEET.get(ch, "")]
        if k and ch == word[k - 1] and (k > 1 and word[k - 2] == ch or word[k + 1 : k + 2] == ch):
            options.append(("", X.REPEAT))
        elif code == X.EDGE:
            options.append(("", X.LOSE if ch in X.LEET else X.SKIP))
        parts.append(options)
    for choice in itertools.product(*parts):
        yield "".join(r for r, _ in choice), sum(p for _, p in choice)


def test_decoding_finds_the_cheapest_of_all_readings(decoder):
    def price(text):
        s = [X.EDGE, X.EDGE, *X.symbols(text).tolist()]
        return sum(decoder.prices[a][b][c] for a, b, c in zip(s, s[1:], [*s[2:], X.EDGE], strict=False))

    rng = random.Random(5)
    for _ in range(150):
        word = "".join(rng.choice("aeilost0135@$!|.-xä") * rng.choice([1, 1, 1, 3]) for _ in range(5))
        costs = {}
        for text, paid in readings(word):
            costs[text] = min(costs.get(text, math.inf), paid + price(text))
        assert costs[decoder.decode(word)] == pytest.approx(min(costs.values()))


def test_long_words_are_read_as_a_whole(decoder):
    began = time.perf_counter()
    assert len(decoder.decode("w0rthl3ss" * 10_000)) == 90_000
    assert time.perf_counter() - began < 60


def test_addresses_and_digests_stay(decoder):
    words = ["und.34@mail7.example.com", "d41d8cd98f00b204e9800998ecf8427e", "https://a.example/l0ser"]
    assert decoder.restore(" ".join(words)) == words


def test_corpus_counts_grow_with_the_input(small_docs):
    whole = X.corpus_model(small_docs.select("text"))
    assert whole.sum() > 1.5 * X.corpus_model(small_docs.where("doc_id % 2 = 0").select("text")).sum()


def test_toxicity_on_held_out_rows(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = X.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    counts = Counter((r["toxic"], r["predicted"]) for r in got)
    assert counts[1, 1] / (counts[1, 0] + counts[1, 1]) > 0.8
    assert counts[0, 1] / (counts[0, 0] + counts[0, 1]) < 0.02


def test_toxicity_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (6, 1, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    got = X.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert X.toxicity(no_docs, labels).count() == 0
    assert X.toxicity(docs, labels.where("false")).count() == docs.count()


# --- URL filters -------------------------------------------------------------------------------


def url_model(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for line in queries.URL_RULES:
        verdict, where = line.split(" ")
        h, p = where.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(where), where, verdict))
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls_and_rules(pages, small_pages):
    rules = U.parse_rules(queries.URL_RULES)
    for df in (pages, small_pages):
        got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in U.url_filter(df, rules).collect())
        assert got == Counter((r["page_id"], *url_model(r["url"])) for r in df.collect())


def test_url_templates_judge_by_labelled_purity(spark):
    rules = U.parse_rules(["block bad.example/spam/", "allow bad.example/ok/"])
    urls = [f"http://bad.example/spam/{k}" for k in range(60)] + [f"http://bad.example/ok/{k}" for k in range(60)] + [f"http://new.example/spam/{k}" for k in range(20)] + [f"http://new.example/ok/{k}.html" for k in range(20)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = U.url_filter(df, rules)
    assert {r["template"] for r in got.collect()} == {"/spam/*", "/ok/*", "/ok/*.html"}
    verdicts = {(r["host"], r["template"]): r["verdict"] for r in got.collect()}
    assert verdicts["new.example", "/spam/*"] == "block" and verdicts["new.example", "/ok/*.html"] == "allow"


def test_many_children_become_wildcards(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    urls = [f"http://h/u/{a}{b}x/p" for a in letters[:8] for b in letters[:5]] + ["http://h/u/fixed"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r["template"] for r in U.url_filter(df, U.parse_rules(["allow h/"])).collect()} == {"/u/*/p", "/u/*"}


def purity_model(rows):
    """Templates and verdicts by walking each host's tree in plain Python."""
    import math

    parsed = [(i, *url_model(u)) for i, u in rows]
    shape = lambda x: "*" if re.fullmatch(r"[0-9a-fA-F-]{16,}", x) else re.sub(r"[0-9]+", "*", x)
    of = {}

    def walk(host, members, template, k):
        """members: (path, segments, pages) that stand at the place ``template`` with segment k to come."""
        kinds = Counter()
        for _, segments, n in members:
            kinds[segments[k]] += n
        pages = sum(kinds.values())
        variable = len(kinds) >= U.MANY_CHILDREN and len(kinds) * 100 >= pages * U.CHILDREN_PER_100
        below = defaultdict(list)
        for path, segments, n in members:
            below[f"{template}/{'*' if variable else segments[k]}"].append((path, segments, n))
        for new, own in below.items():
            for path, segments, _ in own:
                if len(segments) == k + 1:
                    of[host, path] = (template, new)
            if longer := [m for m in own if len(m[1]) > k + 1]:
                walk(host, longer, new, k + 1)

    paths = Counter((h, p) for _, h, p, _, _ in parsed)
    by_host = defaultdict(list)
    for (h, p), n in paths.items():
        segments = [shape(x) for x in p.split("/") if x]
        if segments:
            by_host[h].append((p, segments, n))
        else:
            of[h, p] = ("", "")
    for h, members in by_host.items():
        walk(h, members, "", 0)
    blocked, labelled, place = Counter(), Counter(), {}
    for _, h, p, _, v in parsed:
        t = of[h, p]
        place[h, t[1]] = t[0]
        blocked[h, t[1]] += v == "block"
        labelled[h, t[1]] += v is not None
    share = (sum(blocked.values()) + 1) / (sum(labelled.values()) + 2)
    smooth = lambda k, n, to: (k + U.WEIGHT * to) / (n + U.WEIGHT)
    siblings = defaultdict(list)
    same = defaultdict(list)
    for h, t in place:
        siblings[h, place[h, t]].append((h, t))
        same[t].append((h, t))
    total = lambda of_what, keys: sum(of_what[x] for x in keys)
    purity = {}
    for (h, t), above in place.items():
        everywhere = smooth(total(blocked, same[t]), total(labelled, same[t]), share)
        kin = siblings[h, above]
        kp, np_ = total(blocked, kin), total(labelled, kin)
        pooled = kp / max(np_, 1)

        def merged(x):
            own = blocked[x] / max(labelled[x], 1)
            return labelled[x] == 0 or abs(own - pooled) <= U.SIGMAS * math.sqrt(max(pooled * (1 - pooled), 0) / max(labelled[x], 1))

        group = [x for x in kin if merged(x)] if merged((h, t)) else [(h, t)]
        parent = smooth(kp, np_, everywhere) if np_ else everywhere
        purity[h, t] = smooth(total(blocked, group), total(labelled, group), parent)
    return Counter((i, of[h, p][1], round(purity[h, of[h, p][1]], 9), v or ("block" if purity[h, of[h, p][1]] >= U.PURITY else "allow")) for i, h, p, _, v in parsed)


def deep_urls(seed, n=900):
    import random

    rng = random.Random(seed)
    words = ["news", "blog", "tag", "casino", "shop", "de", "en", "spam"]
    out = []
    for k in range(n):
        host = rng.choice(["www.example.org", "www.example.org", "a.com", "b.com", "c.net", "d.net"])
        depth = rng.choice([0, 1, 2, 3, 5, 8])
        parts = [rng.choice(words) if rng.random() < 0.7 else f"x{rng.randrange(10**6):x}q" if rng.random() < 0.5 else str(rng.randrange(999)) for _ in range(depth)]
        start = rng.choice(["es/", "de/", "fr/", "en/1", "en/2", ""])
        out.append((k, f"http://{host}/{start}{'/'.join(parts)}{rng.choice(['', '/', '?q=1', '.html'])}"))
    out += [(n + k, f"http://deep.com/{'de/' if k % 2 else ''}a/b/c/d/e/{'spam' if k % 3 else 'good'}/{k}") for k in range(120)]
    out += [(n + 200, "http://trap.net/" + "loop/" * 300), (n + 201, None), (n + 202, "x"), (None, "http://a.com/de/x"), (n + 203, "http://trap.net//a//b/")]
    return out


@pytest.mark.parametrize("partitions", [1, 9])
def test_template_tree_matches_a_model(spark, partitions, monkeypatch):
    monkeypatch.setattr(U, "HOT_MIN", 20 if partitions == 9 else 256)
    rows = deep_urls(5)
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(partitions)
    got = U.url_filter(df, U.parse_rules(queries.URL_RULES)).collect()
    assert Counter((r["page_id"], r["template"], round(r["purity"], 9), r["verdict"]) for r in got) == purity_model(rows)
    assert max(r["template"].count("/") for r in got) == 300 and {r["verdict"] for r in got} == {"allow", "block"}


def test_branches_below_the_third_segment_are_told_apart(spark):
    rules = U.parse_rules(["block bad.example/a/b/c/d/spam/", "allow bad.example/a/b/c/d/good/"])
    urls = [f"http://bad.example/a/b/c/d/{x}/{k}" for x in ("spam", "good") for k in range(60)] + [f"http://new.example/a/b/c/d/{x}/{k}" for x in ("spam", "good") for k in range(10)]
    got = U.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).where("rule IS NULL").collect()
    assert {(r["template"], r["verdict"]) for r in got} == {("/a/b/c/d/spam/*", "block"), ("/a/b/c/d/good/*", "allow")}


def test_url_edges(no_pages):
    assert U.url_filter(no_pages, U.parse_rules(queries.URL_RULES)).count() == 0
    with pytest.raises(ValueError):
        U.parse_rules(["deny x"])


# --- packing -----------------------------------------------------------------------------------


def check_pieces(rows, docs, encode, size=1024):
    """Every id once, gapless sequences, little padding."""
    whole = {}
    for i, t in docs:
        whole.setdefault(i, []).append([*encode(t or ""), 0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert {i: sum(len(x) for x in v) for i, v in whole.items()} == {i: sum(r["length"] for r in v) for i, v in by_doc.items()}
    for i, pieces in by_doc.items():
        copies = len(whole[i])
        want = Counter()
        for ids in whole[i]:
            starts = Counter(r["start"] for r in pieces if r["doc_tokens"] == len(ids))
            assert starts[0] >= 1
        for r in pieces:
            fits = [ids for ids in whole[i] if len(ids) == r["doc_tokens"] and zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
            assert fits
            want[r["start"]] += 1
        if copies == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0
                at += r["length"]
            assert at == len(whole[i][0])
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(total, 1)


def test_packing_round_trip(docs, no_docs, small_docs):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    tokenizer = Tokenizer.from_file(files["vocabulary"])
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for df in (docs, small_docs):
        rows = P.pack(df, **files).collect()
        assert check_pieces(rows, [(r["doc_id"], r["text"]) for r in df.collect()], encode) < 0.02
    assert P.pack(no_docs, **files).count() == 0


def test_fast_ids_are_the_tokenizers_ids(small_docs):
    files = queries.tokenizer_files()
    fast, slow = P.Encoder(**files), P.Encoder(files["vocabulary"])
    for text in [*(r["text"][:3000] for r in small_docs.limit(60).collect()), "", " ", "\n\n a\t b", "<|endoftext|> x", "\U0001f600é中文"]:
        assert fast(text) == slow(text)


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        size = int(rng.choice([8, 16]))
        n = int(rng.integers(1, 60))
        at = np.union1d(rng.integers(1, n + 1, 30), np.arange(4, n + 1, 4))
        at = np.union1d(at, [n])
        price = rng.integers(0, 4, len(at)).astype(float)
        ends, prices = [0, *at.tolist()], [0.0, *price.tolist()]
        best = [0.0] + [float("inf")] * len(at)
        for j in range(1, len(ends)):
            for i in range(j):
                length = ends[j] - ends[i]
                if length <= size:
                    best[j] = min(best[j], best[i] + (0 if length in (size, size // 2) else size - length) + prices[j])
        found, cost = P.cuts(at, price, size, True)
        assert cost == pytest.approx(best[-1]) and found[-1] == n
        assert all(b - a <= size for a, b in zip([0, *found], found, strict=False))


def test_streams_are_cut_into_parts():
    rng = np.random.default_rng(4)
    docs = [(k, rng.integers(1, 500, int(rng.integers(1, 4000))).astype(np.uint32)) for k in range(40)]
    rows = []
    for out in P.pack_stream(iter(docs), np.array([13, 30]), 1024, 7 << 32, stream=6000):
        rows += [dict(zip(out, r, strict=True)) for r in zip(*out.values(), strict=True)]
    ids = {i: t.tolist() for i, t in docs}
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["sequence_id"] >> 32 == 7
    lengths = Counter()
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    assert max(lengths.values()) <= 1024 and list(lengths) == sorted(lengths)


# --- HTML extraction ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "kinds"),
    [
        ("<p class=ad>x<p>y", [(H.OTHER, "x"), (H.OPEN, "y")]),
        ('<article><p>a &amp; b<br>c</p><div class="post comments"><p>z</p></div><p>d</article>e', [(H.ARTICLE, "a & b c"), (H.OTHER, "z"), (H.ARTICLE, "d"), (H.OPEN, "e")]),
        ("<div>a</div><nav>m<ul><li>b</nav>c", [(H.OPEN, "a"), (H.OTHER, "m"), (H.OTHER, "b"), (H.OPEN, "c")]),
        ("<script>if (a<b) '<p>x</p>'</script>&lt;p&gt;<!-- <p>no --><style>p{}</style>", [(H.OPEN, "<p>")]),
        ("<p>a<b", [(H.OPEN, "a")]),
        ('<p title="a>b">r', [(H.OPEN, "r")]),
        ("<main><header><h1>T</h1></header>t<footer>f</footer></main>", [(H.ARTICLE, "T"), (H.ARTICLE, "t"), (H.OTHER, "f")]),
        ("<form>q<input></form>w<aside>s</aside><select><option>o</select>", [(H.OTHER, "q"), (H.OPEN, "w"), (H.OTHER, "s"), (H.OTHER, "o")]),
        ("a \n b<i>c</i>d&nbsp;e", [(H.OPEN, "a bcd e")]),
        ("<head><title>x</title></head><body>y", [(H.OPEN, "y")]),
        (None, []),
    ],
)
def test_blocks(page, kinds):
    assert H.blocks(page) == kinds


@pytest.mark.parametrize(
    "page",
    [
        '<div class="no-sidebar"><article><p>the text</p></article></div>',
        '<div class="layout with-sidebar"><article><p>the text</p></article></div>',
        '<div id="form-factor"><article><p>the text</p></article></div>',
        '<main class="has-comments"><p>the text</p></main>',
        '<div class="post related-work"><article><p>the text</p></article></div>',
        '<div class="sidebar content"><article><p>the text</p></article></div>',
        '<form id="aspnetForm"><nav>m</nav><article><p>the text</p></article></form>',
        '<article><section class="search-algorithms"><p>the text</p></section></article>',
        '<article><p class="notice-of-award">the text</p></article>',
        '<form><p>the text</p></form>',
        '<article><p>the text</p></article><div class="comments"><article class="comment-body">first!</article></div>',
        '<article><p>the text</p><div class="ad-slot-1">buy</div><ul class="site-nav"><li>a</ul></article>',
    ],
)
def test_class_names_do_not_take_the_article(page):
    assert "\n".join(t for k, t in H.blocks(page) if k != H.OTHER) == "the text"


def html_model(rows, run=H.RUN, least=H.PAGES):
    """Runs of every host by brute force over all its pages."""
    parsed = [(url_model(u)[0], H.blocks(t)) for _, u, t in rows]
    where, whole, total = defaultdict(set), defaultdict(set), Counter()
    for k, (host, page) in enumerate(parsed):
        total[host] += 1
        words = [w for kind, t in page if kind != H.ARTICLE for w in t.split(" ")]
        for a in range(len(words) - run + 1):
            where[host, tuple(words[a : a + run])].add(k)
        for kind, t in page:
            if kind == H.ARTICLE and len(t.split(" ")) >= run:
                whole[host, t].add(k)
    out = Counter()
    for (i, u, _), (host, page) in zip(rows, parsed, strict=True):
        words = [w for kind, t in page if kind != H.ARTICLE for w in t.split(" ")]
        cover = [False] * len(words)
        for a in range(len(words) - run + 1):
            if len(where[host, tuple(words[a : a + run])]) >= least:
                cover[a : a + run] = [True] * run
        article = any(kind == H.ARTICLE for kind, _ in page)
        every, kept, at = [], [], 0
        for kind, t in page:
            own = t.split(" ")
            if kind == H.ARTICLE:
                every.append(t)
                on = len(whole[host, t])
                if on < least or on < H.HOST_SHARE * total[host]:
                    kept.append(t)
                continue
            stays = [w for w, c in zip(own, cover[at : at + len(own)], strict=True) if not c]
            at += len(own)
            if kind == H.OPEN and (not article or len(own) >= H.ASIDE):
                every.append(t)
                if len(stays) >= (H.ASIDE if article else 1):
                    kept.append(" ".join(stays))
        if sum(map(len, kept)) <= (1 - H.COPY) * sum(map(len, every)):
            kept = every
        out[i, "\n".join(kept)] += 1
    return out


def boilerplate_pages(n, seed):
    import random

    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    some = lambda k: " ".join(word() for _ in range(k))
    same, menu, share, passage = some(14), some(9), some(10), some(40)
    rows = []
    for k in range(n):
        host = rng.choice(["hot", "hot", "hot", "a", "b", "c"])
        rare = f"<div>{passage}</div>" if k % 50 == 0 else ""
        if k % 3 == 0:
            body = f"<article><p>{some(30)}</p><p>{share}</p>{f'<p>{passage}</p>' if k % 5 == 0 else ''}<p>{some(12)}</p></article><div>{same} {some(26)}</div>"
        elif k % 3 == 1:
            body = f"<div>{menu}</div><div>{some(30)} {same} {some(3)}</div>{rare}"
        else:
            body = f"<ul class=menu><li>{menu}</ul><p>{some(20)}<p>{menu} {some(5)}{rare}"
        rows.append((k, f"http://{host}/{k}", body))
    rows += [(10_000 + k, "http://copies/x", rows[1][2]) for k in range(5)]
    return rows


@pytest.mark.parametrize(("partitions", "part"), [(1, H.PART), (7, 400), (61, 1)])
def test_boilerplate_is_that_of_the_whole_host(spark, partitions, part):
    rows = boilerplate_pages(240, 3)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    got = Counter((r["page_id"], r["text"]) for r in H.extract(df, part=part).collect())
    want = html_model(rows)
    assert got == want
    # The suffix arrays decide: without them, texts differ on most pages.
    alone = Counter((i, H.main_text(H.blocks(t), "", set())) for i, _, t in rows)
    assert sum((want - alone).values()) > len(rows) / 2


def test_suffix_classes_are_sorted():
    rng = np.random.default_rng(6)
    for _ in range(30):
        ids = rng.integers(0, 3, 40)
        order, rank = H.suffix_classes(ids, 5)
        heads = [tuple(ids[k : k + 5]) for k in order]
        assert heads == sorted(heads)
        assert all((rank[a] == rank[b]) == (heads[i] == heads[j]) for i, a in enumerate(order) for j, b in enumerate(order))


def test_passages_of_some_articles_stay(spark):
    same = "this passage stands on every page of the host and is long enough"
    made = [(k, f"http://h/{k}", f"<div>unique text here number {k} {same}</div>") for k in range(5)] + [(9, "http://h/a", f"<article><p>{same}</p><p>{same}</p></article>"), (10, "http://other/a", f"<p>{same}")]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[0] == "unique text here number 0" and got[9] == f"{same}\n{same}" and got[10] == same


def test_articles_of_the_fixture(small_pages):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(small_pages).collect()}
    for r in small_pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(p for p in parts if p)
        assert got[r["page_id"]] == (want, len(want))


def test_html_edges(pages, no_pages):
    got = H.extract(pages).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((i, u) for i, u, *_ in page_rows())
    assert {r["page_id"]: r["text"] for r in got}[8] == "a\nb" and {r["page_id"]: r["text"] for r in got}[None] == ""
    assert H.extract(no_pages).count() == 0


def test_hot_hosts_are_dealt_in_slices(spark):
    made = [(k, "http://hot/" + str(k), f"<article>a{k}</article>") for k in range(700)]
    df = spark.createDataFrame(made, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract(df).collect()} == {k: f"a{k}" for k in range(700)}
