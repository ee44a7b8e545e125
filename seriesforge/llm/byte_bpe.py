"""Byte-level BPE encoding and decoding by two tiers.

The text is split by the vocabulary's pattern. A minimal perfect hash over all vocabulary entries finds the
pre-tokens that are entries themselves: one slot per entry, no empty slot, one comparison per lookup. Only
what it doesn't hold is merged: a heap of mergeable neighbours over a doubly linked list of bytes, lowest
rank first, leftmost first among equals.

Defined cases: a null text is empty and gives no ids; ids are packed as little-endian unsigned 32-bit
integers; rows are independent, so ties and repeated rows keep their own result; other input columns pass
through, except that one called like an output column is replaced; an empty table gives an empty table.
A text of any length is split and encoded in parts of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from pathlib import Path

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import map_column

MEMO = 250_000  # merged pre-tokens that a task remembers at most
PART = 1 << 17  # pre-tokens resolved together


def load_ranks(path: str) -> dict[bytes, int]:
    """Entries and ranks of a rank file: base64 and number on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _mixed(h: np.ndarray, d) -> np.ndarray:
    """64-bit hashes dealt anew for each displacement."""
    x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of byte strings: a displacement per bucket puts each key into a slot of its own."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.n = max(len(keys), 1)
        self.buckets = max(len(keys) // per_bucket, 1)
        self.shift = np.zeros(self.buckets, np.int64)
        self.order = np.full(self.n, -1, np.int64)  # slot -> number of the key
        h = self.hashes(keys)
        if len(np.unique(h)) < len(h):
            raise ValueError("two keys with the same 64-bit hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        members = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        free = np.ones(self.n, bool)
        tries = np.arange(1, 129, dtype=np.uint64)[:, None]
        for b in np.argsort(-sizes, kind="stable"):
            own = members[starts[b]:starts[b] + sizes[b]]
            if len(own) < 2:
                break
            base = np.uint64(0)
            while True:
                slots = (_mixed(h[own][None, :], tries + base) % np.uint64(self.n)).astype(np.int64)
                ok = free[slots].all(axis=1)
                for t in np.flatnonzero(ok):
                    if len(set(slots[t].tolist())) == len(own):
                        break
                else:
                    base += np.uint64(len(tries))
                    continue
                self.shift[b] = int(tries[t, 0] + base)
                self.order[slots[t]] = own
                free[slots[t]] = False
                break
        # A bucket of one key takes any slot that is left; the displacement then names the slot itself.
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            self.shift[b] = -slot - 1
            self.order[slot] = members[starts[b]]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = self.hashes(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        moved = (_mixed(h, np.maximum(shift, 0).astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)
        return np.where(shift < 0, -shift - 1, moved)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of candidate merges over linked bytes.

    A part is named by its first byte and linked to the next part's; an entry of the heap is one number made of
    rank, first byte and end, so the lowest rank comes first and the leftmost of equals.
    """
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    bits = (n + 1).bit_length()
    low, high = (1 << bits) - 1, 2 * bits
    heap = [rank << high | i << bits | i + 2 for i in range(n - 1) if (rank := get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, end = entry >> bits & low, entry & low
        j = after[i]
        if j < 0 or j >= n or after[j] != end:
            continue  # one of the two has been merged meanwhile
        after[i], after[j], before[end] = end, -1, i
        if end < n and (rank := get(piece[i:after[end]])) is not None:
            heappush(heap, rank << high | i << bits | after[end])
        if i and (rank := get(piece[before[i]:end])) is not None:
            heappush(heap, rank << high | before[i] << bits | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Codec:
    """Vocabulary, perfect hash and split pattern; made once on the driver and sent along with the tasks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.entry = [keys[k] for k in self.hash.order.tolist()]  # slot -> entry
        self.packed = [ranks[k].to_bytes(4, "little") for k in self.entry]
        self.by_rank = {ranks[k]: p for k, p in zip(self.entry, self.packed)}
        self.memo: dict[bytes, bytes] = {}

    def resolve(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pre-tokens."""
        raw = [p.encode() for p in pieces]
        out = {}
        for piece, key, slot in zip(pieces, raw, self.hash.slots(raw).tolist()):
            if self.entry[slot] == key:
                out[piece] = self.packed[slot]
                continue
            got = self.memo.get(key)
            if got is None:
                got = b"".join(map(self.by_rank.__getitem__, merge(key, self.ranks)))
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                if len(key) <= 256:
                    self.memo[key] = got
            out[piece] = got
        return out

    def encode_all(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Packed ids of each text. Pre-tokens of neighbouring texts are resolved together."""
        split = regex.compile(self.pattern)
        waiting: list[list[str]] = []
        count = 0

        def flush():
            known = self.resolve(list({p for pieces in waiting for p in pieces}))
            return [b"".join(map(known.__getitem__, pieces)) for pieces in waiting]

        for text in texts:
            if len(text) <= 1 << 20:
                waiting.append(split.findall(text))
                count += len(waiting[-1])
                if count >= PART:
                    yield from flush()
                    waiting, count = [], 0
                continue
            yield from flush()
            waiting, count = [], 0
            found, out = (m.group() for m in split.finditer(text)), []
            while part := list(islice(found, PART)):
                known = self.resolve(list(set(part)))
                out.append(b"".join(map(known.__getitem__, part)))
            yield b"".join(out)
        yield from flush()

    def decoder(self) -> list[bytes | None]:
        words: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            words[rank] = word
        return words


def encode(df: DataFrame, codec: Codec, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of each whole text, packed."""

    def make():
        return lambda texts: list(codec.encode_all(t or "" for t in texts))

    return map_column(df, text, out, "binary", make)


def decode(df: DataFrame, codec: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that the packed ids stand for; an unknown id stops the job, null stays null."""
    words = codec.decoder()

    def make():
        return lambda packed: [None if x is None else b"".join(map(words.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in packed]

    return map_column(df, ids, out, "binary", make)


def encode_and_decode(df: DataFrame, codec: Codec, text: str = "text", out: str = "bpe") -> DataFrame:
    """Adds a struct of ``ids``, packed, and ``decoded``, the bytes that these ids stand for; both in one pass over the texts."""
    words = codec.decoder()

    def make():
        def both(texts: list) -> list[dict]:
            ids = list(codec.encode_all(t or "" for t in texts))
            return [{"ids": x, "decoded": b"".join(map(words.__getitem__, np.frombuffer(x, "<u4").tolist()))} for x in ids]

        return both

    return map_column(df, text, out, "struct<ids: binary, decoded: binary>", make)


def n_ids(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")
