import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from seriesforge.llm import components, decontaminate, hash_ring, quality_gbt, simhash, suffix_dedup

def prose(seed, n=120):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- repeated strings ---------------------------------------------------------------------------------------------------------------

def removed_bytes(texts, length):
    first = {}
    for d, t in texts:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1 if d is not None else 0):
            w = raw[s:s + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1 if d is not None else 0):
            if first[raw[s:s + length]] < d:
                gone[s:s + length] = True
        out.append((d, t, gone))
    return out


@pytest.mark.parametrize("length,hot", [(50, 100_000), (50, 3), (20, 100_000), (7, 100_000), (2, 100_000)])
def test_repeats_against_brute_force(docs, texts, length, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [r for r in texts if r[0] != 7] if length < 50 else texts
    df = docs.filter("doc_id IS NULL OR doc_id <> 7") if length < 50 else docs
    got = suffix_dedup.remove_repeats(df, length=length).collect()
    assert len(got) == len(rows)
    expected = []
    for d, t, gone in removed_bytes(rows, length):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        edges = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        expected.append((d, len(raw), int(gone.sum()), spans, raw[~gone].tobytes()))
    mine = [(r.doc_id, r.dedup.n_bytes, r.dedup.n_removed, [tuple(s) for s in r.dedup.spans], bytes(r.dedup.kept)) for r in got]
    assert sorted(mine, key=repr) == sorted(expected, key=repr)
    assert all((r.doc, r.tag, r.key, r.lang) == (1, 2, "k", "en") for r in got)


def test_repeats_with_several_texts_under_one_key(spark):
    a, b = "first text of sixty bytes, that only stands in this one place!!", "second text of sixty bytes, which stands in another document.."
    df = spark.createDataFrame([(2, a), (2, b), (1, b), (2, b), (3, a + b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.dedup.n_bytes, r.dedup.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    n, m = len(a), len(b)
    assert got == sorted([(2, n, 0), (2, m, m), (1, m, 0), (2, m, m), (3, n + m, n + m)])


def test_repeats_at_whole_characters(docs):
    for r in suffix_dedup.remove_repeats(docs, whole_characters=True).collect():
        bytes(r.dedup.kept).decode()


def test_repeats_of_nothing(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(nothing, length=1)


def context_rows(texts, one_text=True, hot=None):
    """Round 2's rows of one batch in which every sampled position is asked for."""
    raws = [t.encode() for _, t in texts]
    at = [suffix_dedup.anchors(np.frombuffer(r, np.uint8), 50)[0].astype(np.int32).tolist() for r in raws]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in texts]), pa.array(range(len(texts))), pa.array([True] * len(texts)), pa.array([[a] for a in at], pa.list_(pa.list_(pa.int32()))),
         pa.array([zstandard.ZstdCompressor().compress(r) for r in raws], pa.binary())], ["doc", "_tag", "_known", "pos", "_packed"])
    return [r for b in suffix_dedup._contexts(50, 4, one_text, *([] if hot is None else [hot]))(iter([batch])) for r in b.to_pylist()]


def test_copies_of_a_batch_are_settled_by_a_row_for_each_document():
    text = prose(3)
    rows = context_rows([(d, text) for d in range(30, 0, -1)] + [(40, text + prose(4))])
    n = len(text.encode())
    settled = {r["doc"]: r["starts"] for r in rows if r["bytes"] is None}
    assert len([r for r in rows if r["bytes"] is None]) == 30 and all(settled[d] == [0, n] for d in range(2, 31))
    assert settled[40][0] == 0 and len(settled[40]) == 2 and n - 50 < settled[40][1] <= n
    assert {r["doc"] for r in rows if r["bytes"] is not None} == {1, 40}


def test_hot_strings_of_a_batch_go_along_once():
    """60 documents share a passage amid different words: of each of its strings one row is left, and all others are settled."""
    shared = prose(5, 30)
    texts = [(d, f"{prose(100 + d, 20)} {shared} {prose(200 + d, 20)}") for d in range(60)]
    rows = context_rows(texts)
    batch = pa.RecordBatch.from_pylist([r | {"hot": None if r["bytes"] is None else True} for r in rows],
                                       pa.schema([*suffix_dedup.ROWS_ARROW, ("hot", pa.bool_())]))
    got = [r for b in suffix_dedup._split(50)(iter([batch])) for r in b.to_pylist()]
    strings = [r["bytes"] for r in got if r["bytes"] is not None]
    assert len(set(strings)) == len(strings) and all(len(s) == 50 for s in strings)
    assert {t.encode()[i:i + 50] for _, t in texts for i in range(len(t.encode()) - 49)} == set(strings)
    gone = {d: np.zeros(len(t.encode()), bool) for d, t in texts}
    for r in got:
        for lo, hi in zip(r["starts"][::2], r["starts"][1::2]) if r["bytes"] is None else ():
            gone[r["doc"]][lo:hi] = True
    assert all((gone[d] == want).all() for d, _, want in removed_bytes(texts, 50))


def test_strings_of_hot_names_are_split_by_the_worker_that_finds_them():
    """Given the names, round 2's rows hold single strings, so no second worker is needed for these."""
    shared = prose(5, 30)
    texts = [(d, f"{prose(100 + d, 20)} {shared} {prose(200 + d, 20)}") for d in range(60)]
    names = {r["name"] for r in context_rows(texts) if r["bytes"] is not None}
    hot = np.array(sorted(names)[::2], np.int64)
    got = [r for r in context_rows(texts, hot=hot) if r["bytes"] is not None]
    whole = [r for r in got if r["name"] in names]
    assert {r["name"] for r in whole} == names - set(hot.tolist())
    strings = [r["bytes"] for r in got if r["name"] not in names]
    assert strings and len(set(strings)) == len(strings) and all(len(s) == 50 for s in strings)
    everything = {r["bytes"][i:i + 50] for r in whole for i in range(len(r["bytes"]) - 49)} | set(strings)
    assert everything == {t.encode()[i:i + 50] for _, t in texts for i in range(len(t.encode()) - 49)}


def peak_bytes(rows):
    """The most that numpy and Python hold while the rows are made."""
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_the_rounds():
    """A worker's arrays stay a few times as large as its text, some 50 bytes for each string."""
    texts = [prose(d, 3000) for d in range(100)]
    text = pa.array(texts, pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(range(100)), text], ["doc", "tag", "text"])
    size = sum(len(t.encode()) for t in texts)
    assert peak_bytes(suffix_dedup._positions(50, 8)(iter([batch]))) < 6 * size
    n, length = 20_000, 50
    lines = np.random.default_rng(1).integers(97, 123, (n, 80)).astype(np.uint8)
    lines[:, 20:60] = lines[0, 20:60]
    schema = suffix_dedup.ROWS_ARROW
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array([[0]] * n, pa.list_(pa.int32())),
         pa.array(np.full(n, 80, np.int32)), pa.array([x.tobytes() for x in lines], pa.binary())], schema=schema)
    strings = n * (80 - length + 1)
    assert peak_bytes(suffix_dedup._ranked(length)(iter([rows]))) < 70 * strings
    hot = rows.append_column("hot", pa.array([True] * n))
    assert peak_bytes(suffix_dedup._split(length)(iter([hot]))) < 150 * strings


# --- SimHash ------------------------------------------------------------------------------------------------------------------------

def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=2):
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                label[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_fingerprints_and_groups(docs, texts):
    got = simhash.near_duplicates(docs)
    fps = [(d, slow_fingerprint(t)) for d, t in texts]
    roots = slow_components([f for _, f in fps])
    least = {}
    for d, f in fps:
        if d is not None:
            least[roots[f]] = min(least.get(roots[f], d), d)
    expected = [(d, f, least.get(roots[f])) for d, f in fps]
    mine = [(r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in got.collect()]
    assert sorted(mine, key=repr) == sorted(expected, key=repr)


def test_no_documents(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("radius,hot", [(0, 2048), (1, 2048), (2, 2048), (2, 4)])
def test_links_lose_no_component(spark, radius, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = random.Random(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        centre = rnd.getrandbits(64)
        for _ in range(12):
            fps.add(centre ^ sum(1 << b for b in set(rnd.choices(range(64), k=rnd.randint(0, 4)))))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.near_links(df, radius)
    unsigned = lambda x: x & (1 << 64) - 1
    pairs = [(unsigned(a), unsigned(b)) for a, b in links.collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in pairs)
    found = {unsigned(r.node): unsigned(r.root) for r in components.components(links).collect()}
    expected, mine = slow_components(fps, radius), {f: found.get(f, f) for f in fps}
    group = lambda label: sorted(sorted(f for f in fps if label[f] == x) for x in set(label.values()))
    assert group(mine) == group(expected)


def test_a_block_of_one_dense_run():
    fps = np.array([(i & 1023) | (7 << 40) for i in range(1024)], np.uint64)
    forest = simhash.links_in_block(fps, np.zeros(1024, int), 1)
    assert len(forest) == 1023  # connected, without a link too many
    assert simhash.links_in_block(fps[:1], np.zeros(1, int), 2) == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- hash ring ----------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shards,virtual,rows", [(16, 64, 1000), (7, 5, 333), (1, 1, 10), (16, 64, 3), (3, 2, 0)])
def test_ring_is_balanced_and_moves_little(spark, shards, virtual, rows):
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(9).alias("shard"))
    got = hash_ring.assign(df, shards=shards, virtual=virtual).collect()
    assert sorted(r.doc_id for r in got) == list(range(rows))
    counts = [sum(r.shard == s for r in got) for s in range(shards)]
    assert sum(counts) == rows and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    home = {r.doc_id: r.home for r in df.select("doc_id", hash_ring._cell(F.col("doc_id"))[0].alias("cell"))
            .join(hash_ring.ring(spark, shards, virtual), "cell").select("doc_id", F.col("shard").alias("home")).collect()}
    load = [sum(h == s for h in home.values()) for s in range(shards)]
    assert sum(home[r.doc_id] != r.shard for r in got) == sum(max(0, a - b) for a, b in zip(load, counts))


def test_ring_of_odd_rows(docs, texts, nothing):
    got = hash_ring.assign(docs, shards=4).collect()
    raw = [(d, (t or "").encode()) for d, t in texts]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((d, len(b) + 1, zlib.crc32(b)) for d, b in raw), key=repr)
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, k) for s in range(4) for k in range(sum(r.shard == s for r in got)))
    assert hash_ring.assign(nothing).count() == 0
    with pytest.raises(ValueError):
        hash_ring.assign(docs, shards=0)


# --- quality rules ------------------------------------------------------------------------------------------------------------------

def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)} if len(words) < 2000 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, None if repeated is None else len(repeated))


def test_counts(docs, texts, nothing):
    model = quality_gbt.fit(np.zeros((0, len(quality_gbt.FEATURES))), np.zeros(0), list(quality_gbt.FEATURES.values()))
    got = quality_gbt.judge(docs, model)
    assert set(docs.columns) < set(got.columns)
    mine = {}
    for r in got.collect():
        j = r.judged
        mine[(r.doc_id, r.text)] = tuple(j)[:5]
        assert j.base_failed == (j.n_words < 50 or 100 * j.n_repeat_words > 50 * j.n_words)
        assert j.kept == (not j.base_failed)  # without labels the base rules decide
    for d, t in texts:
        expected = slow_counts(t)
        assert mine[(d, t)][:4] == expected[:4] and expected[4] in (None, mine[(d, t)][4])
    assert quality_gbt.judge(nothing, model).count() == 0


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality_gbt.FEATURES)))
    names = list(quality_gbt.FEATURES)
    k = names.index("symbol_share")
    bad = ((x[:, k] > 0.6) ^ (rng.random(3000) < 0.1)).astype(float)
    model = quality_gbt.fit(x[:2000], bad[:2000], list(quality_gbt.FEATURES.values()))
    held = (model.score(x[2000:]) > 0) == (x[2000:, k] > 0.6)
    assert held.mean() > 0.95
    for name, direction in quality_gbt.FEATURES.items():
        if direction:
            probe = np.repeat(rng.random((50, 1, x.shape[1])), 40, axis=1)
            probe[:, :, names.index(name)] = np.linspace(0, 1, 40)
            steps = np.diff(model.score(probe.reshape(-1, x.shape[1])).reshape(50, 40), axis=1)
            assert (direction * steps >= -1e-12).all(), name


def test_model_of_labelled_documents(spark):
    good = [(i, " ".join(f"w{(i * 7 + k) % 900}" for k in range(80))) for i in range(60)]
    junk = [(100 + i, " ".join(f"w{(i * 11 + k) % 900}###" for k in range(80))) for i in range(60)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 100), 0) for d, _ in good + junk] + [(None, 0, 0), (5000, 0, 0), (1, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality_gbt.quality_model(docs, labels)
    kept = {r.doc_id for r in quality_gbt.judge(docs, model).filter("judged.kept").collect()}
    assert kept == {d for d, _ in good}
    x, bad = quality_gbt.labelled_sample(docs, labels, sample=10)
    assert len(x) == len(bad) <= 10


# --- decontamination ----------------------------------------------------------------------------------------------------------------

def edits(pattern, text):
    prev = list(range(len(pattern) + 1))
    best = prev[-1]
    for c in text:
        cur = [0]
        for i, p in enumerate(pattern, 1):
            cur.append(min(prev[i] + 1, cur[-1] + 1, prev[i - 1] + (p != c)))
        prev, best = cur, min(best, cur[-1])
    return best


def test_edited_items_against_full_alignment(spark):
    rnd = random.Random(5)
    items = [(i, prose(100 + i, rnd.choice([3, 8, 14, 30]))) for i in range(25)] + [(90, None), (91, ""), (92, "short"), (93, "exactly8"), (94, "qz"), (95, "twelve chars"),
                                                                                           (96, "just twenty-two chars."), (97, "X")]
    docs = [(900, None), (901, ""), (None, "before " + items[3][1]), (902, "a SHORT one"), (903, "exactly8"), (904, "exactly 8"), (905, "qz"), (906, "shor t"),
            (907, "so twelve cars, and twelv echars"), (908, "just twent-two charts. and more"), (909, "just twenty two char. and more"), (910, "twelve  \n CHARS"),
            (911, "just twe-two chars"), (912, "x")]
    for k in range(60):
        x = list(items[rnd.randrange(25)][1])
        for _ in range(rnd.randint(0, len(x) // 5)):
            j, how = rnd.randrange(len(x)), rnd.randrange(3)
            x[j:j + (how > 0)] = [] if how == 1 else ["q"]
        docs.append((k, f"{prose(300 + k, 12)} {''.join(x).upper()}\n{prose(400 + k, 9)}"))
    table = decontaminate.lower_table()
    segments = decontaminate.Segments(items, table, 0.1)
    expected = set()
    for d, t in docs:
        plain = "".join(map(chr, decontaminate.plain(t or "", table)[0]))
        for s, code in enumerate(segments.code):
            if edits("".join(map(chr, code)), plain) <= segments.edits[s]:
                expected.add((d, segments.item[s]))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected) > 20
    left = decontaminate.without_contaminated(df, bench)
    hit = {d for d, _ in expected}
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((d for d, _ in docs if d not in hit), key=repr)
    assert left.columns == df.columns
    empty = bench.limit(0)
    assert decontaminate.contaminated(df, empty).count() == 0 == decontaminate.contaminated(df.limit(0), bench).count()


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    items = [(i, prose(i, 20)) for i in range(12)]
    df = spark.createDataFrame([(i, "x " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == {(i, i) for i, _ in items}
    assert decontaminate.without_contaminated(df, bench).count() == 0
