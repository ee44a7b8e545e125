"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared without case and with runs of white space as one space. A benchmark item is cut into
segments of ``SEGMENT`` characters that overlap by half (shorter items are one segment), so a leaked part is found too. A segment of
m characters may occur with up to e = ``budget`` * m edits. Such an occurrence shares at least m - q + 1 - e * q
q-grams with the segment, all of them on neighbouring diagonals (place in the text minus place in the segment). q is ``Q``, and less only for
segments so short that ``Q`` leaves no such bound: m / (e + 1) at most.
So a task looks up the q-grams of each whole text in the benchmark's, counts hits in bands of 4e diagonals that
overlap by half, and keeps the bands that reach the bound: no occurrence within the budget can be lost.
What is left is aligned inside its band, all candidates of a batch at once, and is a match only with at most e edits.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each block a pass over the texts that ends before the
next block is read, so neither the driver nor a plan holds more than one. Texts are never shuffled.

Defined cases: null and empty texts and items match nothing; an item of under 1 / ``budget`` characters must match exactly, and one of a few
characters is found wherever they stand, also inside words; repeated rows of either side each count, equal keys
are joined in one row; a null key is kept; other columns are not returned; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import scratch_path, unused, whole_text

Q = 8
SEGMENT = 80
BUDGET = 0.1
BLOCK_CHARS = 8_000_000
VERIFIED = 4096  # candidates aligned together
MATCHES = "key long, item long, segment int, edits int, lo int, hi int"
U = np.uint64


def lower_table() -> np.ndarray:
    """Lower-case form of each code point that has one of a single character; all white space as a space."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        low = chr(c).lower()
        table[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return table


def plain(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points compared, and the place in the text that each comes from."""
    code = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = code == 32
    keep = np.flatnonzero(~blank | ~np.append(True, blank[:-1]))
    return code[keep], keep


def grams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """A name for the q-gram at each place."""
    power = code.astype(U) * U(0x9E3779B97F4A7C15)
    power ^= power >> U(32)
    out, have, size = None, 0, 1
    while True:
        if q & size:
            out = power if out is None else _joined(out, power, have)
            have += size
        if 2 * size > q:
            return out
        power, size = _joined(power, power, size), 2 * size


def _joined(first: np.ndarray, second: np.ndarray, offset: int) -> np.ndarray:
    n = max(len(second) - offset, 0)
    name = first[:n] * U(0xD6E8FEB86659FD93) + second[offset:]
    return name ^ (name >> U(29))


class _Grams:
    """The q-grams of some segments, sorted for lookup."""

    def __init__(self, q: int, own: list[int], code: list[np.ndarray]):
        self.q = q
        all_grams = [grams(code[s], q) for s in own]
        name = np.concatenate(all_grams)
        segment = np.repeat(np.array(own), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams])
        order = np.argsort(name, kind="stable")
        self.segment, self.place = segment[order], place[order]
        self.name, self.start, self.count = np.unique(name[order], return_index=True, return_counts=True)
        bits = max(16, len(self.name).bit_length() + 4)
        self.shift = U(64 - bits)
        self.present = np.zeros(1 << bits, bool)
        self.present[(self.name >> self.shift).astype(np.int64)] = True

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, diagonal) of each shared q-gram of one text."""
        name = grams(code, self.q)
        at = np.flatnonzero(self.present[(name >> self.shift).astype(np.int64)])
        found = np.searchsorted(self.name, name[at])
        found[found == len(self.name)] = 0
        ok = self.name[found] == name[at]
        at, found = at[ok], found[ok]
        n = self.count[found]
        which = np.repeat(self.start[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.segment[which], np.repeat(at, n) - self.place[which]


class Segments:
    """Segments of a block of the benchmark with their q-grams."""

    def __init__(self, items: list[tuple[int, str]], table: np.ndarray, budget: float):
        self.item, self.code, self.edits = [], [], []
        for item, text in items:
            code = plain(text or "", table)[0]
            if len(code) and code[-1] == 32:
                code = code[:-1]
            last = len(code) - SEGMENT
            for at in [0] if last <= 0 else [*range(0, last, SEGMENT // 2), last]:
                part = code[at:at + SEGMENT]
                if len(part):
                    self.item.append(item)
                    self.code.append(part)
                    self.edits.append(int(budget * len(part)))
        self.length = np.array([len(c) for c in self.code], np.int64)
        self.e = np.array(self.edits, np.int64)
        q = np.minimum(Q, self.length // (self.e + 1))
        self.need = self.length - q + 1 - self.e * q
        self.step = np.maximum(2 * self.e, 1)
        self.grams = [_Grams(int(size), np.flatnonzero(q == size).tolist(), self.code) for size in np.unique(q)]

    def bands(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, first diagonal) of the bands of one text with enough shared q-grams."""
        hits = [g.hits(code) for g in self.grams if len(code) >= g.q] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        segment, diagonal = (np.concatenate(x) for x in zip(*hits))
        band = (diagonal + SEGMENT) // self.step[segment]
        key, count = np.unique(np.concatenate((segment << 40 | band + 1, segment << 40 | band)), return_counts=True)
        key = key[count >= self.need[key >> 40]]
        segment = key >> 40
        return segment, ((key & (1 << 40) - 1) - 1) * self.step[segment] - SEGMENT

    def align(self, segment: np.ndarray, windows: np.ndarray, m: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits and the best last diagonal of segments of m characters; row i of ``windows`` starts at its band."""
        pattern = np.stack([self.code[s] for s in segment])
        across = np.arange(width)
        cost = np.zeros((len(segment), width), np.int16)
        far = np.full((len(segment), 1), 1 << 12, np.int16)
        for i in range(m):
            change = cost + (windows[:, i:i + width] != pattern[:, i:i + 1])
            leave_out = np.concatenate((cost[:, 1:], far), axis=1) + 1
            cost = np.minimum(change, leave_out)
            cost = (np.minimum.accumulate(cost - across, axis=1) + across).astype(np.int16)  # put in
        return cost.min(axis=1), cost.argmin(axis=1)


def found_in(segments: Segments, table: np.ndarray, rows: Iterator[tuple]) -> list[tuple]:
    """(key, item, segment, edits, lo, hi) of all matches in rows (key, text)."""
    out: list[tuple] = []
    waiting: list[tuple] = []

    def verify() -> None:
        for m in sorted({len(segments.code[s]) for _, s, *_ in waiting}):
            own = [w for w in waiting if len(segments.code[w[1]]) == m]
            segment = np.array([w[1] for w in own])
            width = int(max(2 * segments.step[segment[0]], 1))
            edits, last = segments.align(segment, np.stack([w[3] for w in own]), m, width)
            for (key, s, first, _, keep), e, d in zip(own, edits.tolist(), last.tolist()):
                if e <= segments.e[s]:
                    to = min(max(first + d + m, 1), len(keep))
                    out.append((key, segments.item[s], s, e, int(keep[max(to - m, 0)]), int(keep[to - 1]) + 1))
        waiting.clear()

    for key, text in rows:
        code, keep = plain(text, table)
        for s, first in zip(*(x.tolist() for x in segments.bands(code))):
            m, width = len(segments.code[s]), int(max(2 * segments.step[s], 1))
            window = np.zeros(m + width, np.uint32)
            lo, hi = max(first, 0), min(first + m + width, len(code))
            window[lo - first:max(hi - first, lo - first)] = code[lo:hi]
            waiting.append((key, s, first, window, keep))
        if len(waiting) >= VERIFIED:
            verify()
    verify()
    return out


def _blocks(benchmark: DataFrame, item: str, item_text: str, budget: float, table: np.ndarray) -> Iterator[Segments]:
    if not 0 <= budget < 1:
        raise ValueError("the budget is a share of a segment's characters")
    size = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    for b in range(blocks):
        block = benchmark.filter(F.pmod(F.xxhash64(item, item_text), F.lit(blocks)) == b)
        items = block.select(F.col(item).cast("long"), whole_text(item_text)).collect()  # bounded by the number of blocks
        yield Segments([(r[0], r[1]) for r in items], table, budget)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """(key, item, n_segments, edits, lo, hi): a row for each document and each item found in it.

    n_segments: the item's segments found; edits: those of the best of them; lo, hi: characters of the text from the first match
    to the end of the last.
    """
    table = lower_table()
    texts = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"))

    def find(segments: Segments):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = found_in(segments, table, zip(batch["key"].astype("Int64"), batch["text"]))
                yield pd.DataFrame(rows, columns=["key", "item", "segment", "edits", "lo", "hi"]).astype({"key": "Int64", "item": "Int64"})

        return each

    path = scratch_path(docs.sparkSession, "matches")
    for segments in _blocks(benchmark, item, item_text, budget, table):
        texts.mapInPandas(find(segments), MATCHES).write.mode("append").parquet(path)
    return (docs.sparkSession.read.schema(MATCHES).parquet(path).groupBy("key", "item")
            .agg(F.countDistinct("segment").alias("n_segments"), F.min("edits").alias("edits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .withColumnsRenamed({"key": key, "item": item}))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                         item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` in which no item is found. Each row is judged where it stands; nothing is shuffled."""
    table = lower_table()

    def found(segments: Segments):
        @F.pandas_udf("boolean")
        def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                rows = {r[0] for r in found_in(segments, table, enumerate(batch))}
                yield pd.Series([k in rows for k in range(len(batch))])

        return hit.asNondeterministic()

    hit, spark = unused(docs, "_hit"), docs.sparkSession
    for k, segments in enumerate(_blocks(benchmark, item, item_text, budget, table)):
        if k:  # what the block before left is written before the next pass
            path = scratch_path(spark, "left")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
        docs = docs.withColumn(hit, found(segments)(whole_text(text))).filter(~F.col(hit)).drop(hit)
    return docs
