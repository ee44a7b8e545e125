"""The pipeline's near copies against brute force: Jaccard similarity of 0.8 or more of the sets of five-word shingles."""

import random
import time
from itertools import combinations

import numpy as np
import pytest

from seriesforge.llm import components, near_copies, simhash, stages


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def slow_least(rows):
    sets, label = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        small, large = sorted((len(sets[i]), len(sets[j])))
        if 5 * small < 4 * large:
            continue
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (small + large - both):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return [(d, least.get(x)) for (d, _), x in zip(rows, label)]


def copies():
    """Documents of 80 to 600 words with 0.2 to 4 % of their words replaced: similarities on both sides of the limit."""
    rnd, rows = random.Random(5), []
    for k in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(80, 600))]
        for share in (0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04):
            own = list(words)
            for at in rnd.sample(range(len(own)), max(round(share * len(own)), share > 0)):
                own[at] = f"new{rnd.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(own)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind, bits", [("copies", 64), ("odd", 64), ("copies", 5), ("odd", 2)])
def test_groups(spark, texts, kind, bits):
    rows = copies() if kind == "copies" else texts
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component) for r in near_copies.near_copies(df, bits=bits).collect()]
    assert sorted(got, key=repr) == sorted(slow_least(rows), key=repr)
    if bits == 64:
        left = {(r.doc_id, r.text) for r in stages.near_dedup(spark, df, "").collect()}
        assert left == {(d, t) for (d, t), (_, least) in zip(rows, slow_least(rows)) if d is None or d == least}


def test_parities_reject_no_similar_pair():
    rnd = np.random.default_rng(3)
    for n in (5, 60, 500, 5000):
        a = np.unique(rnd.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 10:], rnd.integers(0, 1 << 64, n // 10, np.uint64)]))
        differ = sum(int(x).bit_count() for x in near_copies.parities(a) ^ near_copies.parities(b))
        assert differ <= len(np.setxor1d(a, b))


def test_simhash_links_stand_without_names(spark, monkeypatch):
    """Copies within the radius are linked by their fingerprints, though no two sets share a name."""
    monkeypatch.setattr(near_copies, "names", lambda hashes: np.full(near_copies.BANDS, hashes.sum(), np.uint64))
    rows = sorted(copies())
    prints = [simhash.majority(near_copies.shingles(t)) for _, t in rows]
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    found = {r.doc_id: r.component for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = [slow_set(t) for _, t in rows]
    linked = [(a, b) for a, b in near if own[a] != own[b] and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    assert len(linked) > 20 and all(found[a] == found[b] for a, b in linked)


def test_rounds_leave_no_shuffle_files(spark):
    """Shuffle files of a round go with the round, and the setting for it is put back."""

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(), spark.conf.get(name, None)
    found = components.components(spark.range(200).selectExpr("id AS a", "id + 1 AS b"))
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert spark.conf.get(name, None) == setting
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(201)}


def test_no_documents(nothing):
    assert near_copies.near_copies(nothing).count() == 0
