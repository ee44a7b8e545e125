"""Whole queries on the smallest driver tables against plain Python that shares no code with the operators."""

import os
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriesforge.llm import quality_gbt
from seriesforge.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def rows(table):
    return duckdb.connect().execute(f"SELECT * FROM '{SF_DIR}/{table}.parquet'").fetchall()


def test_op1_hosts_paths_and_rules(spark):
    rules = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}
    got = {r.page_id: r for r in QUERIES["op1_url_tree"](spark, SF_DIR).collect()}
    pages = rows("pages")
    assert len(got) == len(pages)
    for page_id, url, _ in pages:
        match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), match[1]), match[2]) if match else ("", "")
        fits = [(len(h) + len(p), h, p) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[page_id]
        assert (r.host, r.path) == (host, path)
        if fits:
            _, h, p = max(fits)
            assert (r.rule, r.verdict) == (h + p, rules[h, p])
        else:
            assert r.rule is None and r.verdict in ("allow", "block")


class Words(HTMLParser):
    """Words of a page in order, without head, scripts and styles."""

    def __init__(self):
        super().__init__()
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_op3_every_word_of_every_page(spark):
    got = {r.page_id: r for r in QUERIES["op3_html_layout"](spark, SF_DIR).collect()}
    for page_id, _, html in rows("pages"):
        parser = Words()
        parser.feed(html or "")
        text = got[page_id].text
        assert "".join(re.sub(r"(?m)^ *(- |[0-9]+\. )", "", text).split()) == "".join(parser.words)
        assert got[page_id].n_chars == len(text) and got[page_id].n_lines == text.count("\n") + 1


def test_op5_counts(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_token_counts"](spark, SF_DIR).collect()}
    expected = {}
    for d, text, *_ in rows("documents"):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected[d] = (len((text or "").encode()), n, n > 512)
    assert got == expected


def test_op6_shards(spark):
    docs = {d: (t or "").encode() for d, t, *_ in rows("documents")}
    got = QUERIES["op6_hash_ring"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    shards = {}
    for r in got:
        raw = docs[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None) and 0 <= r.shard < 16
        shards.setdefault(r.shard, []).append(r.slot)
    counts = [len(shards.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())


def test_op10_trees_node_by_node():
    """The flat arrays give what a walk from each root to its leaf gives, and directed features never lower or raise against their direction."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(600, 3))
    bad = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rnd.normal(size=600) > 0.6).astype(float)
    trees = quality_gbt.fit(x, bad, [1, 0, -1], trees=20)

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return total

    assert trees.score(x) == pytest.approx([walk(row) for row in x])
    assert ((trees.score(x) > 0) == bad).mean() > 0.75
    for feature, direction in ((0, 1), (2, -1)):
        line = np.repeat(x[:50], 40, axis=0)
        line[:, feature] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(trees.score(line).reshape(50, 40), axis=1)
        assert (direction * steps >= -1e-9).all() and (steps != 0).any()
