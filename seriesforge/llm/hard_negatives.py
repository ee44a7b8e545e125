"""Hard negatives of stated anchors, by bounds from segment summaries.

A vector is cut into equal segments; of each the mean and the deviation (root of the sum of squares about the mean) are stored. The product
of two segments is ``length * mean * mean'`` plus or minus ``deviation * deviation'``, so sums over segments bound a score from both
sides. A pair is bounded by one segment first, then by 2, 4, ... segments, and only what its bounds can't settle is refined
further; what is left at the end is scored exactly.

* Index: each row's vector in whole numbers and the summaries of its finest segments (coarser ones follow from them), written once. Rows
  are dealt evenly into chunks of at most ``CHUNK`` by their place, so neither a hot label nor a vector that many rows share matters.
* Anchors against chunks, in blocks: each anchor goes to every chunk, whose task holds the chunk and lets anchors stream past. A chunk
  sends at most ``positives`` (then ``negatives`` a window) rows for an anchor; Spark ranks them with a limit on both sides of the shuffle.
* Positives first: the threshold is the k-th best lower bound of the chunk. Then negatives: each positive's score opens a
  window; a row matters while its interval reaches the window above the k-th best lower bound of those that surely lie inside.

Scores are exact whole numbers; bounds are widened by more than their rounding. Nothing passes through the driver but the numbers of rows
and dimensions; a lost executor repeats its tasks from the index's files.

Defined cases: rows without id or label, without a vector or with a null or non-finite component take no part; shorter vectors are
filled up with zeros, so an empty one scores 0; components are cut at +-2^23 after scaling; rows that repeat count as a row each, and
other rows are those with another id; an anchor row with no positive or no negative in the window gives no row; ties go to the smaller
id; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesforge.llm.common import scratch_path

CHUNK = 1 << 18  # rows that a task holds
LEAST_CHUNK = 1024
SEGMENT = 8  # dimensions of the finest segments, at least
LARGEST = 1 << 23
INDEX = "row long, chunk long, anchor boolean, id long, label long, vector binary, means binary, deviations binary"


def segments(dims: int) -> tuple[int, int]:
    """Number (a power of two) and length of the finest segments."""
    count = 1
    while count * 2 * SEGMENT <= dims:
        count *= 2
    return count, max(-(-dims // count), 1)


def summary(vectors: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations (rows x segments) of rows of vectors."""
    parts = vectors.reshape(len(vectors), count, -1).astype(np.float64)
    means = parts.mean(axis=2)
    return means, np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))


def coarser(means: np.ndarray, deviations: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The summaries of pairs of neighbouring segments of this length."""
    left, right = means[:, ::2], means[:, 1::2]
    both = deviations[:, ::2] ** 2 + deviations[:, 1::2] ** 2 + length * (left - right) ** 2 / 2
    return (left + right) / 2, np.sqrt(both)


def hierarchy(means: np.ndarray, deviations: np.ndarray, length: int) -> list[tuple]:
    """(length, means, deviations) from one segment to the finest."""
    levels = [(length, means, deviations)]
    while levels[0][1].shape[1] > 1:
        length, means, deviations = levels[0]
        levels.insert(0, (2 * length, *coarser(means, deviations, length)))
    return levels


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Block:
    """Rows of the index with all levels of their summaries."""

    def __init__(self, rows: pa.Table, length: int):
        self.ids, self.labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        whole = rows.combine_chunks()
        self.vectors = _matrix(whole.column("vector"), "<i4")
        self.levels = hierarchy(_matrix(whole.column("means"), "<f8"), _matrix(whole.column("deviations"), "<f8"), length)
        _, means, deviations = self.levels[0]
        self.norms = np.sqrt(self.levels[0][0] * means[:, 0] ** 2 + deviations[:, 0] ** 2)
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def bounds(self, level: int, rows: np.ndarray, anchor: Block, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the rows' scores with the anchor."""
        length, means, deviations = self.levels[level]
        _, mean, deviation = anchor.levels[level]
        middle = length * (means[rows] @ mean[a])
        width = deviations[rows] @ deviation[a] + 1e-12 * anchor.norms[a] * self.norms[rows] + 0.5
        return middle - width, middle + width

    def scores(self, rows: np.ndarray, anchor: Block, a: int) -> np.ndarray:
        kind = np.float64 if self.largest * anchor.largest * self.vectors.shape[1] < 1 << 53 else np.int64
        return (self.vectors[rows].astype(kind) @ anchor.vectors[a].astype(kind)).astype(np.int64)


def kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by smaller id."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= kth(scores, k))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def find_positives(block: Block, anchor: Block, a: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k best of the anchor's label."""
    rows = np.flatnonzero((block.labels == anchor.labels[a]) & (block.ids != anchor.ids[a]))
    for level in range(len(block.levels)):
        if len(rows) <= k:
            break
        low, high = block.bounds(level, rows, anchor, a)
        rows = rows[high >= kth(low, k)]
    scores = block.scores(rows, anchor, a)
    best = first(block.ids[rows], scores, k)
    return rows[best], scores[best]


def find_negatives(block: Block, anchor: Block, a: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, rows and scores of the k best of other labels inside it."""
    rows = np.flatnonzero(block.labels != anchor.labels[a])
    for level in range(len(block.levels)):
        if not len(rows):
            break
        low, high = block.bounds(level, rows, anchor, a)
        keep = np.zeros(len(rows), bool)
        for least, most in windows:
            sure = low[(low >= least) & (high <= most)]
            reach = max(least, kth(sure, k)) if len(sure) >= k else least
            keep |= (high >= reach) & (low <= most)
        rows = rows[keep]
    scores = block.scores(rows, anchor, a)
    out = []
    for least, most in windows:
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        best = inside[first(block.ids[rows[inside]], scores[inside], k)]
        out.append((rows[best], scores[best]))
    return out


def _streamed(length: int, emit: Callable) -> Callable:
    """Rows sorted by chunk, the chunk's own before the anchors: each batch of anchors meets the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, block = None, [], None
        for batch in batches:
            of, visits = batch.column("chunk").to_numpy(), batch.column("visits").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (visits[1:] != visits[:-1])))
            for at, to in zip(edges, np.append(edges[1:], len(of))):
                part = batch.slice(at, to - at)
                if of[at] != chunk:
                    chunk, held, block = of[at], [], None
                if not visits[at]:
                    held.append(part)
                    continue
                if block is None and held:
                    block, held = Block(pa.Table.from_batches(held), length), []
                if block is not None:
                    yield from emit(block, Block(pa.Table.from_batches([part]), length), part)

    return run


def _table(names: str, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names.split())


def _positives(k: int) -> Callable:
    def emit(block: Block, anchors: Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for a, row in enumerate(part.column("row").to_pylist()):
            rows, scores = find_positives(block, anchors, a, k)
            out.append((np.full(len(rows), row), block.ids[rows], scores))
        yield from _table("row positive_id positive_score", out)

    return emit


def _negatives(k: int, share: tuple[int, int]) -> Callable:
    def emit(block: Block, anchors: Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for a, (row, positives) in enumerate(zip(part.column("row").to_pylist(), part.column("positives").to_pylist())):
            windows = [(-(-share[0] * p["positive_score"] // 100), share[1] * p["positive_score"] // 100) for p in positives]
            for p, (rows, scores) in zip(positives, find_negatives(block, anchors, a, windows, k)):
                out.append((np.full(len(rows), row), np.full(len(rows), p["nth"], np.int32), block.ids[rows], scores))
        yield from _table("row nth negative_id negative_score", out)

    return emit


def indexed(df: DataFrame, anchor: Column, id: str, label: str, vector: str, scale: float) -> tuple[DataFrame, int, int]:
    """The index as a written table, its number of chunks, and the length of its finest segments."""
    spark = df.sparkSession
    values = F.col(vector).cast("array<double>")
    fit = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(values, lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    rows = df.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fit).select(
        anchor.alias("anchor"), F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("whole"))
    total, dims = df.agg(F.count("*"), F.max(F.size(vector))).first()
    count, length = segments(max(dims or 0, 1))
    chunks = max(-(-total // CHUNK), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_CHUNK)), 1)

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("whole")
            sizes = lists.value_lengths().to_numpy()
            vectors = np.zeros((len(sizes), count * length), "<i4")
            vectors[np.arange(count * length) < sizes[:, None]] = lists.flatten().to_numpy()
            packed = [vectors, *(m.astype("<f8") for m in summary(vectors, count))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "chunk", "anchor", "id", "label")]
                + [pa.array([r.tobytes() for r in m], pa.binary()) for m in packed], [c.split()[0] for c in INDEX.split(", ")])

    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("chunk", F.pmod("row", F.lit(chunks))).mapInArrow(summarised, INDEX)
    path = scratch_path(spark, "segments")
    rows.write.parquet(path)
    return spark.read.schema(INDEX).parquet(path), chunks, length


def mine(df: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5,
         negatives: int = 10, share: tuple[int, int] = (30, 90), scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``anchor`` holds.

    Negatives score between the two percentages of the positive's score. Scores are inner products of ``floor(scale * component)``.
    """
    index, chunks, length = indexed(df, anchor, id, label, vector, scale)
    rows = index.select("chunk", F.lit(False).alias("visits"), "row", "id", "label", "vector", "means", "deviations")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk")
    anchors = index.filter("anchor").drop("chunk", "anchor")

    def searched(visitors: DataFrame, emit: Callable, schema: str) -> DataFrame:
        own = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in visitors.schema if f.name not in rows.columns])
        both = own.unionByName(visitors.select("*", every, F.lit(True).alias("visits")))
        return (both.repartitionById(chunks, F.col("chunk").cast("int")).sortWithinPartitions("chunk", "visits")
                .mapInArrow(_streamed(length, emit), schema))

    found = searched(anchors, _positives(positives), "row long, positive_id long, positive_score long")
    best = W.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= positives)
    lists = found.groupBy("row").agg(F.collect_list(F.struct("nth", "positive_id", "positive_score")).alias("positives"))
    anchors = anchors.join(lists, "row")
    hard = searched(anchors, _negatives(negatives, share), "row long, nth int, negative_id long, negative_score long")
    best = W.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    named = anchors.select("row", F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("row", "anchor_id", "p.*")
    return hard.join(named, ["row", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
