"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has bit i set where over half of its shingles' hashes have it. Distinct
fingerprints are compared, not documents. Two that differ in at most ``radius`` bits agree on all but
``radius`` of ``blocks`` parts of the 64 bits, so each is sent to one bucket for every choice of parts that
agree. Inside a task the rows stand in order of their buckets, and bit planes are stored vertically: plane i
holds bit i of all rows of a block, one row a bit. Shifting a plane by ``off`` and combining it with itself gives
the rows that differ from the row ``off`` further on; two carry-save counters add those up for all rows at
once, and a block is abandoned once every pair is over the radius. Of the links in a bucket a spanning
forest leaves the task: no component changes, and a group of n copies sends n - 1 links, not n * n.

Buckets are bounded by construction. One with over ``HOT`` fingerprints is dealt again by choices of all but
``radius`` of ``HOT_BLOCKS`` parts: what doesn't agree there is at most 15 bits, so no bucket can hold more than 2**15
distinct fingerprints, whatever the data. Components of the links are found by ``components``.

Defined cases: null and empty texts have no word and fingerprint zero, which links like any other; repeated
rows each get their row; a null key stays a row of its own fingerprint and never names a component that
has another key; an empty table gives an empty table; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import cut, whole_text
from seriesforge.llm.components import components

SEED = 42
HOT = 2048
HOT_BLOCKS = 9
BLOCK_ROWS = 4096
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of the shingles of ``width`` words, A-Z lower-cased, repeats included."""
    words = text.encode().lower().split()  # bytes: A-Z only, and splits at \x20 and \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    spans = map(slice, starts[:len(words) - width + 1], ends[width - 1:])
    n = len(words) - width + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; counted eight bits at a time, in lanes of a byte."""
    n = len(hashes)
    if not n:
        return 0
    starts = np.arange(0, n, 255)
    out = 0
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * byte + k)
    return out


def fingerprint(text: str, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp) with the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), width) for t in batch], np.uint64).view(np.int64))

    return df.select(F.col(key).alias("key"), fp.asNondeterministic()(whole_text(text)).alias("fp"))


def _choices(blocks: int, radius: int) -> list[int]:
    """Masks of the bits that agree: every choice of all but ``radius`` of the blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _buckets(fps: DataFrame, blocks: int, radius: int, first: int = 0) -> DataFrame:
    """(choice, bits, fp): a row for each choice of bits that agree."""
    rows: list[Column] = [F.struct(F.lit(first + i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
                          for i, m in enumerate(_choices(blocks, radius))]
    return fps.select("fp", F.explode(F.array(*rows)).alias("b")).select("b.choice", "b.bits", "fp")


def links_in_block(fps: np.ndarray, run: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of the same run; runs stand together."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]
    label = np.arange(n)
    last = np.flatnonzero(np.append(run[1:] != run[:-1], True))
    end = last[np.searchsorted(last, np.arange(n))]  # the last row of each row's run
    left = (end - np.arange(n))  # how far each row's partners reach
    forest = []
    for off in range(1, int(left.max(initial=0)) + 1):
        open_rows = left >= off
        if not open_rows.any():
            break
        alive = int.from_bytes(np.packbits(open_rows, bitorder="little").tobytes(), "little")
        ones = twos = 0
        for plane in planes:
            differ = (plane ^ (plane >> off)) & alive
            carry = ones & differ
            ones ^= differ
            over = twos & carry
            twos ^= carry
            alive &= ~(over | _above(ones, twos, radius))
            if not alive:
                break  # every pair of the block is over the radius
        if not alive:
            continue
        found = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))
        for i in found[label[found] != label[found + off]].tolist():
            a, b = label[i], label[i + off]
            if a != b:
                label[label == b] = a
                forest.append((i, i + off))
                own = slice(int(np.searchsorted(run, run[i])), int(end[i]) + 1)
                if (label[own] == a).all():
                    left[own] = 0  # the run is one component
    return forest


def _above(ones: int, twos: int, radius: int) -> int:
    """Rows whose counter is over the radius (of 0 to 3)."""
    return {0: ones | twos, 1: twos, 2: ones & twos}[radius]


def _compare(radius: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by bucket; a bucket is never cut."""
        rest: list[pd.DataFrame] = []

        def blocks(df: pd.DataFrame) -> pd.DataFrame:
            fps = df["fp"].to_numpy().view(np.uint64)
            new = (df["choice"].to_numpy()[1:] != df["choice"].to_numpy()[:-1]) | (df["bits"].to_numpy()[1:] != df["bits"].to_numpy()[:-1])
            run = np.concatenate(([0], np.cumsum(new)))
            shared = np.bincount(run)[run] > 1
            fps, run = fps[shared], run[shared]
            a, b = [], []
            at = 0
            while at < len(fps):
                to = int(np.searchsorted(run, run[min(at + BLOCK_ROWS, len(run)) - 1], side="right"))
                for i, j in links_in_block(fps[at:to], run[at:to], radius):
                    a.append(fps[at + i])
                    b.append(fps[at + j])
                at = to
            return pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})

        for batch in batches:
            if not len(batch):
                continue
            last = (batch["choice"].iat[-1], batch["bits"].iat[-1])
            ends = ((batch["choice"] != last[0]) | (batch["bits"] != last[1])).to_numpy()
            cut_at = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
            if cut_at:
                yield blocks(pd.concat([*rest, batch.iloc[:cut_at]]))
                rest = []
            rest.append(batch.iloc[cut_at:])
        if rest:
            yield blocks(pd.concat(rest))

    return compare


def near_links(fps: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints at most ``radius`` (0 to 2) bits apart."""
    if radius not in (0, 1, 2):
        raise ValueError("the counters hold radii 0 to 2")
    rows = _buckets(fps, blocks, radius)
    hot = rows.groupBy("choice", "bits").count().filter(F.col("count") > HOT).select("choice", "bits")
    again = _buckets(rows.join(hot, ["choice", "bits"], "left_semi").select("fp").distinct(), HOT_BLOCKS, radius, first=1000)
    rows = rows.join(hot, ["choice", "bits"], "left_anti").unionByName(again)
    return (rows.repartition("choice", "bits").sortWithinPartitions("choice", "bits")
            .mapInPandas(_compare(radius), "a long, b long"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """(key, fp, component): fingerprints, and the smallest key that links lead to."""
    own = cut(fingerprints(df, key, text, width))
    distinct = own.groupBy("fp").agg(F.min("key").alias("least"))
    roots = components(near_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return own.join(named, "fp").select(F.col("key").alias(key), "fp", "component")
