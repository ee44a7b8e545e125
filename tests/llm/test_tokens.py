import base64
import functools
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesforge.llm import byte_bpe, token_cache
from seriesforge.llm.queries_tokens import default_codec

JSON = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def reference():
    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture
def library():
    return reference()


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    assert [keys[i] for i in h.order[h.slots(keys)]] == keys
    assert byte_bpe.PerfectHash([]).slots([b"a"]).tolist() == [0]
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_encoding_is_the_librarys(text):
    codec = default_codec()
    [ids] = codec.encode_all(iter([text]))
    assert np.frombuffer(ids, "<u4").tolist() == reference().encode_ordinary(text)


def test_encode_and_decode(docs, texts, library):
    codec = default_codec()
    both = byte_bpe.decode(byte_bpe.encode(docs.drop("key").withColumnRenamed("lang", "ids"), codec), codec)
    got = both.collect()
    at_once = byte_bpe.encode_and_decode(docs, codec).collect()
    assert sorted((bytes(r.bpe.ids), bytes(r.bpe.decoded)) for r in at_once) == sorted((bytes(r.ids), bytes(r.decoded)) for r in got)
    assert len(got) == len(texts) and {"doc", "tag", "source"} <= set(both.columns)
    for r in got:
        text = r.text or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_long_text_without_spaces():
    text, codec = "ab" * 600_000 + " x" * 300_000, default_codec()
    [before, ids, after] = codec.encode_all(iter(["one", text, "two"]))
    words = codec.decoder()
    assert b"".join(words[i] for i in np.frombuffer(ids, "<u4")).decode() == text
    assert [before, after] == list(codec.encode_all(iter(["one", "two"])))


def test_empty_table(nothing):
    codec = default_codec()
    assert byte_bpe.decode(byte_bpe.encode(nothing, codec), codec).count() == 0


def test_vocabulary_without_bytes():
    with pytest.raises(ValueError):
        byte_bpe.Codec({b"a": 0}, ".")


def test_counts_and_cache(spark, docs, texts, nothing, tmp_path):
    cache, tokenizer = str(tmp_path / "cache"), Tokenizer.from_file(JSON)
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    expected = sorted(((d, len((t or "").encode()), n(t)) for d, t in texts), key=repr)
    first = token_cache.token_counts(docs, JSON, cache)
    assert sorted(map(tuple, first.collect()), key=repr) == expected
    stored = spark.read.parquet(cache)
    digests = {hashlib.sha256((t or "").encode()).digest() for _, t in texts}
    assert stored.count() == len(digests) == stored.select("digest").distinct().count()
    again = token_cache.token_counts(docs, JSON, cache)
    assert sorted(map(tuple, again.collect()), key=repr) == expected
    assert spark.read.parquet(cache).count() == len(digests)  # nothing was encoded again
    assert token_cache.token_counts(nothing, JSON, str(tmp_path / "none")).count() == 0


def test_other_tokenizer_has_its_own_counts(docs, tmp_path):
    cache = str(tmp_path / "cache")
    a = token_cache.token_counts(docs, JSON, cache).groupBy().sum("n_tokens").first()[0]
    b = token_cache.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), cache).groupBy().sum("n_tokens").first()[0]
    assert a != b


@functools.cache
def counters():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return token_cache.Counter(open(JSON).read()), lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "<|endo", "ftext|>", " ", "  ", "\n", "\t ", "'s", "'ll", " a", "Straße", "12", "é", "!?"]),
                                                max_size=14).map("".join)))
def test_counts_by_pre_tokens_are_the_librarys(text):
    own, library = counters()
    assert own.added is not None and own.counts([text]) == [library(text)]


def test_every_character_is_counted_as_in_the_library():
    own, library = counters()
    for start in range(0, 0x110000, 0x800):
        if not 0xD800 <= start < 0xE000:
            for text in ("".join(f"{chr(c)}a{chr(c)} " for c in range(start, start + 0x800)), "".join(map(chr, range(start, start + 0x800)))):
                assert own.counts([text]) == [library(text)], hex(start)


def test_counts_of_long_texts_and_a_full_memory(monkeypatch):
    own, library = counters()
    long = "word and <|endoftext|> more of it, x1y2 " * 40_000 + "z" * 70_000
    monkeypatch.setattr(token_cache.Counter, "KEPT", 3)
    fresh = token_cache.Counter(open(JSON).read())
    assert fresh.counts([long, "", long[:1000]]) == [library(long), 0, library(long[:1000])] == own.counts([long, "", long[:1000]])


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    other, tokenizer = token_cache.Counter(open(path).read()), Tokenizer.from_file(path)
    assert other.counts(["Some words, ", ""]) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in ("Some words, ", "")]
