"""The index of live digests against plain Python, through insertions, deletions and resizing."""

import hashlib
import random
import re

import pytest

from seriesforge.llm import cuckoo_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def slow(rows):
    """Sorted (key, keep_key, size, kept) of rows (key, text): one row of each content stays."""
    groups = {}
    for key, text in rows:
        groups.setdefault(normal(text), []).append((-len(text or ""), key is None, key or 0))
    out = []
    for members in groups.values():
        best = min(members)
        for n, m in enumerate(sorted(members)):
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), n == 0))
    return sorted(out, key=repr)


def seen(spark, index):
    return sorted(((r.key, r.keep_key, r.group_size, r.kept) for r in cuckoo_dedup.judged(spark, index).collect()), key=repr)


def test_filter_inserts_deletes_and_resizes():
    rnd, cuckoo = random.Random(1), cuckoo_dedup.Cuckoo(2)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    digests += [d[:31] + bytes([d[31] ^ 1]) for d in digests[:500]]  # same places and fingerprints, other contents
    live = {}
    for d in digests:
        assert cuckoo.find(d) == -1
        cuckoo.insert([d, 1, None])
        live[d] = True
        if rnd.random() < 0.3:
            gone = rnd.choice(list(live))
            cuckoo.delete(cuckoo.find(gone))
            del live[gone]
    assert cuckoo.size > 2 and sum(map(bool, cuckoo.prints)) == len(live)
    assert all((cuckoo.find(d) >= 0) == (d in live) for d in digests)


def test_groups(spark, docs, texts):
    index = cuckoo_dedup.insert(cuckoo_dedup.create(spark), docs)
    assert seen(spark, index) == slow(texts)
    digests = {r.key: bytes(r.digest).hex() for r in cuckoo_dedup.judged(spark, index).collect()}
    assert all(digests[d] == hashlib.sha256(normal(t).encode()).hexdigest() for d, t in texts if d is not None)
    left = cuckoo_dedup.unique_rows(docs, index)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        {(d, t) for d, t in texts if (d, next(k[1] for k in slow(texts) if k[0] == d), True) in {(k[0], k[1], k[3]) for k in slow(texts)}}, key=repr)


@pytest.mark.parametrize("keys", [50_000, 8])
def test_generations(spark, texts, monkeypatch, keys):
    """Insertions and deletions one after another; with small buckets the index is dealt anew in between."""
    monkeypatch.setattr(cuckoo_dedup, "BUCKET_KEYS", keys)
    schema = "doc_id long, text string"
    first, more = texts[:12], texts[12:] + [(k, f"text {k % 50}" + " " * (k % 3)) for k in range(1000, 1300)]
    index = cuckoo_dedup.insert(cuckoo_dedup.create(spark), spark.createDataFrame(first, schema))
    before = index.buckets
    index = cuckoo_dedup.insert(index, spark.createDataFrame(more, schema))
    assert (index.buckets > before) == (keys == 8)
    assert seen(spark, index) == slow(first + more)
    gone = [r for r in first + more if r[0] is None or r[0] % 3 == 0 or r[0] == 1002]
    absent = [(1, "never seen"), (5000, "text 1"), (2, texts[0][1])]
    index = cuckoo_dedup.delete(index, spark.createDataFrame(gone + absent, schema))
    left = [r for r in first + more if r not in gone]
    assert seen(spark, index) == slow(left)
    contents = index.contents(spark)
    assert contents.count() == len({normal(t) for _, t in left}) == index.filters(spark).selectExpr("sum(n)").first()[0]
    index = cuckoo_dedup.insert(index, spark.createDataFrame(gone, schema))
    assert seen(spark, index) == slow(left + gone)


def test_nothing(spark, nothing):
    index = cuckoo_dedup.insert(cuckoo_dedup.create(spark), nothing)
    assert cuckoo_dedup.judged(spark, index).count() == 0
    assert cuckoo_dedup.judged(spark, cuckoo_dedup.delete(index, nothing)).count() == 0
    assert cuckoo_dedup.unique_rows(nothing, index).count() == 0
