"""The near-copy stage against a comparison of all pairs."""

import os
import random
from itertools import combinations

import pytest

import corpus_pipeline
from strataleaf.llm import common
from strataleaf.llm import near_copies as N


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute_force(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def made(seed):
    """Texts of 200 words, copies of them with some changed words, and texts that differ in the middle third."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        texts.append(base)
        for changes in (1, 2, 3, 4, 5, 6, 8, 12):
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = word()
            texts.append(copy)
        texts.append(base[:66] + [word() for _ in range(67)] + base[133:])
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("few", [64, 2])
def test_groups_are_those_of_all_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "MANY", few)
    rows = made(1)
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_force(rows)


def test_stage_drops_near_copies_and_nothing_else(spark, data):
    rows = made(2)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, data).collect()]
    roots = brute_force(rows)
    assert sorted(roots[i] for i in kept) == sorted(set(roots.values()))


@pytest.mark.parametrize("few", [64, 3])
def test_large_families_hold_together(spark, few, monkeypatch):
    """Variants of one text that are each near it but not each other, copies of them, and a family that is near nothing."""
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "MANY", few)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    texts = [base]
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(120), 2 if k % 2 else 9):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts += [copy] * (1 + k % 3)
    rng.shuffle(texts)
    rows = [(k, " ".join(t).upper() if k % 4 == 0 else " ".join(t)) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_force(rows)


@pytest.mark.parametrize("tile", [1 << 20, 900])
def test_bands_that_stay_large_lose_no_link(spark, tile, monkeypatch):
    """Without further deals and with bands of two, all that lies apart goes through the tiles."""
    monkeypatch.setattr(N, "FEW", 1)
    monkeypatch.setattr(N, "DEALS", 0)
    monkeypatch.setattr(N, "TILE", tile)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(40):
        text = list(base)
        for at in rng.sample(range(150), 3 + k % 4):
            text[at] = f"x{rng.randrange(10**6)}"
        near = list(text)
        near[rng.randrange(150)] = "y"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(near))]
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), radius=0).collect()}
    assert got == brute_force(rows) and len(set(got.values())) > 5


def test_tiles_compare_all_pairs():
    """Links of one tile, and of two, join what a comparison of all pairs joins."""
    import numpy as np

    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(30), 20)), np.uint64) for _ in range(60)]
    want = {(a, b) for a, b in combinations(range(60), 2) if len(set(sets[a]) & set(sets[b])) >= 0.6 * len(set(sets[a]) | set(sets[b]))}

    def components(pairs):
        root = list(range(60))
        for a, b in pairs:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    for sides in ([2] * 60, [k % 2 for k in range(60)]):
        made = N._tile_links([(k, k, side, x.tobytes()) for k, (side, x) in enumerate(zip(sides, sets, strict=True))], 0.6).to_pydict()
        found = list(zip(made["u"], made["v"], strict=True))
        reach = {(a, b) for a, b in want if sides[0] == 2 or sides[a] != sides[b]}
        assert {tuple(sorted(p)) for p in found} <= reach
        assert components(found) == components(reach) and len(found) < 60


def test_planted_copies_are_found(spark):
    """Recall over texts of 300 words with one to twenty words changed, by similarity."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(9000)}"
    rows = []
    for k in range(120):
        base = [word() for _ in range(300)]
        copy = list(base)
        for at in rng.sample(range(300), 1 + k % 8):
            copy[at] = word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_force(rows)
    assert got == want and 60 < sum(i != r for i, r in want.items()) < 120


def test_edges(docs, no_docs):
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(docs).collect()}
    assert set(got) == {r["doc_id"] for r in docs.where("doc_id IS NOT NULL").collect()}
    assert got[4] == got[5] == 3 and got[2] == 1 and got[8] == 8
    assert N.near_groups(no_docs).count() == 0


def test_gathered_checkpoints_hold_all_rows(spark, monkeypatch):
    """A small checkpoint is read in as many partitions as there are cores, a large one in all of its own."""
    rows = spark.range(5000).repartition(40)
    gathered = common.cut_gathered(rows)
    assert gathered.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in gathered.collect()) == list(range(5000))
    monkeypatch.setattr(common, "PIECE", 1 << 10)
    assert common.cut_gathered(rows).rdd.getNumPartitions() == 40
    assert common.cut_gathered(spark.createDataFrame([], "id long")).count() == 0


def test_many_partitions_leave_few_tasks(spark):
    """Over 48 partitions, as on a cluster, 2,112 tasks ran here, and 4,592 where small checkpoints kept their partitions."""
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows, tracker = made(6), spark.sparkContext.statusTracker()
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("few-tasks", "")
    try:
        got = {r["doc_id"]: r["component_id"] for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert got == brute_force(rows)
    assert tasks < 3000


def test_listed_pairs_grow_with_members_only(spark, monkeypatch):
    """A family of 60 that share bands but lie apart; with pairs listed in bands of up to 64 there are as many as its square."""
    listed, distinct = [], N._distinct
    monkeypatch.setattr(N, "_distinct", lambda pairs: listed.append(pairs.count()) or distinct(pairs))
    rng = random.Random(13)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(60):
        text = list(base)
        for at in rng.sample(range(150), 5):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), radius=0).collect()}
    assert got == brute_force(rows)
    assert sum(listed[1:]) < 1000


def family(seed=13, members=60, words=150, changed=5):
    """Texts that share bands but lie apart."""
    rng = random.Random(seed)
    rows = []
    for k in range(members):
        text = [f"b{k}" for k in range(words)]
        for at in rng.sample(range(words), changed):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    return rows


def test_small_tables_write_few_files(spark, monkeypatch):
    """Over 48 partitions, as on a cluster, small tables of a known bound are written by few tasks: an executor starts a process for each file."""
    files, cut = [], common.cut

    def counted(df):
        df = cut(df)
        path = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
        files.append(sum(x.startswith("part-") for x in os.listdir(path)))
        return df

    monkeypatch.setattr(common, "cut", counted)
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = made(6)
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = {r["doc_id"]: r["component_id"] for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_force(rows)
    assert sum(files) < 15 * len(files), files


def test_texts_of_several_large_bands_are_dealt_once(spark, monkeypatch):
    """A family that shares several large bands has 32 fresh bands a text, not 32 for each large band of a text."""
    members, banded = [], N._banded
    monkeypatch.setattr(N, "MANY", 8)
    monkeypatch.setattr(N, "_banded", lambda rows, total: members.append(rows.count()) or banded(rows, total))
    rows = family(changed=3)
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), radius=0).collect()}
    assert got == brute_force(rows)
    assert len(members) == 2 and members[1] <= N.BANDS * len(rows)
