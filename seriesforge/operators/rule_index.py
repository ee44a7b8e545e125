"""Rule tables of any size against names: candidates by literal q-grams, patterns only to verify.

A rule is a row with a pattern for the name and one for the unit; case does not matter, and both have to be found on the same row. Matching every
rule with every name would cost their product. But nearly every pattern has literals that each match contains, and so all of
the literals' q-grams, short and long. Of these one that few names have is the rule's key; a row goes to the keys that its name contains,
and only the rules and rows that meet are tested, first for the literals, then with the patterns. A key that very many rows have is split over tasks.

Grams themselves are never shuffled. How many names have a gram is counted in a table of bounded size, by the gram's hash: where hashes meet a count is
too high, so that a rule may take another key, but never loses a match; a gram counted 0 is in no name and settles its rule. The keys are
put into a Bloom filter, likewise bounded, that tells the tasks with names which grams to send; what it lets through in error finds no rule. Rules are
written once with their keys, and shuffled once; rows are shuffled once to be spread and once for each key. Spark can't know how many rows
an explode makes, so the join is a merge.

Rules without a literal of ``GRAMS[0]`` characters (say ``a|b``) can't have a key. They are applied as expressions to every row, a bounded number
at a time, in blocks; that costs rows times such rules, which no index can spare.

Literals are read conservatively: only ASCII characters outside classes and alternatives that no quantifier makes optional.

Defined cases: null names or units match nothing, null patterns neither; repeated rules and rows match each, and so does each of several
patterns under one rule_id; rules without rule_id match only if they have no literal; a pattern that isn't valid raises the
regex engine's error; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.operators.star import HOT_ROWS, join_keys
from seriesforge.sources.tables import brief_shuffles, scratch_path

GRAMS = (3, 4, 6, 9, 14)  # bytes
COUNT_BITS = (12, 22)  # least and most bits of a gram's hash that tell its place among the counts of its length
COUNT_SLICE = 16  # bits of a place within the slice that one task adds up
FILTER_SLICE, FILTER_SLICES, PROBES = 20, 9, 6  # of the keys' filter: bits of a place within a slice, most bits that tell the slice, places of a key
PIECE = 1 << 20  # bytes of text that are arrays at a time
BLOCK = 200  # rules without a literal that are one expression
SPECIAL = set(".^$*+?{}[]()|\\")


def literals_of(pattern: str | None) -> list[str]:
    """Runs of characters, in lower case and long enough for a gram, that every match of the pattern contains."""
    if pattern is None or "\\Q" in pattern:
        return []
    return sorted({run.lower() for run in _certain(pattern, 0)[0] if len(run) >= GRAMS[0]})


def _certain(pattern: str, at: int) -> tuple[list[str], int]:
    """Runs that are certain in the part from ``at`` to the end of its group, and where that is; none where it has alternatives."""
    runs, run, several = [], "", False
    while at < len(pattern) and pattern[at] != ")":
        c, optional = pattern[at], pattern[at + 1:at + 2] in ("*", "?", "{")
        if c == "(":
            runs.append(run)
            run, kind = "", re.match(r"\((\?=|\?:|(?!\?))", pattern[at:])
            inner, at = _certain(pattern, at + (kind.end() if kind else 1))
            if kind and pattern[at + 1:at + 2] not in ("*", "?", "{"):
                runs += inner
        elif c == "[":
            runs.append(run)
            run, at = "", at + len(re.match(r"\[\^?\]?(?:\\.|[^\]\\])*", pattern[at:])[0])
        elif c == "\\" and at + 1 < len(pattern):
            at += 1
            if pattern[at].isalnum() or pattern[at + 1:at + 2] in ("*", "?", "{"):
                runs.append(run)
                run = ""
            else:
                run += pattern[at]
        elif c == "{":
            runs.append(run)
            run, at = "", pattern.find("}", at) if "}" in pattern[at:] else len(pattern)
        elif c in SPECIAL or optional or not c.isascii():
            runs.append(run)
            run, several = "", several or c == "|"
        else:
            run += c
        at += 1
    return ([] if several else [*runs, run]), at


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: its number, the places of the grams in the joined texts, the texts they are in, and their hashes."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data, base = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64), 0x9E3779B97F4A7C15
    owner, end = np.repeat(np.arange(len(texts)), lengths), np.repeat(np.cumsum(lengths), lengths)
    power, back = (np.cumprod(np.full(len(data), x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(data + np.uint64(1)) * power)])
    for k, size in enumerate(GRAMS):
        at = np.flatnonzero(np.arange(size, len(data) + size) <= end)
        yield k, at, owner[at], _mix((sums[at + size] - sums[at]) * back[at] + np.uint64(size))


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """From where to where rows are taken together: about ``PIECE`` bytes, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > PIECE:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _counts(names: DataFrame, bits: int) -> bytes:
    """For each length and place a byte: 0 where no gram of ``_name`` is, else 1 + 4 log2 of how many are there, rounded up."""
    width = 1 << min(COUNT_SLICE, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(GRAMS), 1 << bits), np.uint32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _pieces([len(t) for t in texts]):
                for k, _, _, hashes in _grams(texts[a:b]):
                    np.add.at(found[k], _place(hashes, bits), np.uint32(1))
        for i, part in enumerate(found.reshape(-1, width)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": [zlib.compress(part.astype("<u4").tobytes(), 1)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(part), "<u4").astype(np.int64)
        for i, part in sums.items():
            level = np.where(part > 0, np.ceil(4 * np.log2(np.maximum(part, 1))) + 1, 0)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": [level.astype(np.uint8).tobytes()]})

    # A few tasks for each core are enough, and each may send all slices.
    few = names.select(F.col("_name").cast("binary")).filter("_name IS NOT NULL").coalesce(2 * names.sparkSession.sparkContext.defaultParallelism)
    levels = np.zeros(len(GRAMS) << bits, np.uint8)
    for row in few.mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(add, "slice int, counts binary").collect():
        levels[row["slice"] * width:(row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.uint8)
    return levels.tobytes()


def _best(literals: list[list[str]], levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each list of literals, a gram that few names have and rather a long one, and a bound on how many rows have it; 0 of an empty list."""
    bits = levels.shape[1].bit_length() - 1
    best, keys = np.full(len(literals), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(literals), np.uint64)
    owner = np.repeat(np.arange(len(literals)), [len(x) for x in literals])
    for k, at, run, hashes in _grams([run.encode() for runs in literals for run in runs]):
        if not len(at):
            continue
        level, rule = levels[k][_place(hashes, bits)].astype(np.uint64), owner[run]
        # Doublings of the count, then the length, then the count.
        cost = (((level + np.uint64(3)) // np.uint64(4)) << np.uint64(48)) | np.uint64(len(GRAMS) - k << 40) | (level << np.uint64(32)) | np.arange(len(at), dtype=np.uint64)
        starts = np.flatnonzero(np.diff(rule, prepend=-1))
        least, rules = np.minimum.reduceat(cost, starts), rule[starts]
        better = least < best[rules]
        best[rules[better]] = least[better]
        keys[rules[better]] = hashes[(least[better] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    level = (best >> np.uint64(32) & np.uint64(0xFF)).astype(np.float64)
    rows = np.where((level > 0) & (best < np.iinfo(np.uint64).max), np.ceil(np.exp2(np.minimum((level - 1) / 4, 62))), 0)
    return keys.view(np.int64), rows.astype(np.int64)


def with_keys(rules: DataFrame, levels: Broadcast) -> DataFrame:
    """Adds ``literals`` to rows with ``name_pattern``, and their key ``_gram`` with a bound on the rows that have it."""

    @F.pandas_udf("literals array<string>, _gram long, _rows long")
    def keyed(patterns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counted = np.frombuffer(levels.value, np.uint8).reshape(len(GRAMS), -1)
        for batch in patterns:
            literals = [literals_of(p) for p in batch]
            found = [_best(literals[a:b], counted) for a, b in _pieces([sum(map(len, x)) for x in literals])]
            keys, rows = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            yield pd.DataFrame({"literals": literals, "_gram": keys, "_rows": rows})

    return rules.withColumn("_key", keyed.asNondeterministic()("name_pattern")).select(*rules.columns, "_key.*")


def _bit(hashes: np.ndarray, slices: int, probe: int) -> np.ndarray:
    """Each key's place in the filter."""
    mask = np.uint64((1 << FILTER_SLICE) - 1)
    step = (hashes >> np.uint64(FILTER_SLICE) & mask) | np.uint64(1)
    return (_place(hashes, slices) << FILTER_SLICE) | (hashes + np.uint64(probe) * step & mask).astype(np.int64)


def _filter(keys: DataFrame, slices: int) -> bytes:
    """The Bloom filter of ``_gram``, put together from slices."""
    size = 1 << FILTER_SLICE - 3

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            of, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for i in np.unique(of):
                bits = own.setdefault(int(i), np.zeros(size, np.uint8))
                for probe in range(PROBES):
                    at = _bit(hashes[of == i].view(np.uint64), 0, probe)
                    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for i, bits in own.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "bits": [bits.tobytes()]})

    of = F.shiftrightunsigned("_gram", 64 - slices).cast("int") if slices else F.lit(0)
    out = bytearray(size << slices)
    for row in keys.select(of.alias("slice"), "_gram").repartition("slice").mapInArrow(fill, "slice int, bits binary").collect():
        out[row["slice"] * size:(row["slice"] + 1) * size] = row["bits"]
    return bytes(out)


def _hits(texts: list[bytes], bits: np.ndarray, slices: int) -> list[np.ndarray]:
    """The grams of each text that the filter knows, each once."""
    rows, keys = [], []
    for _, _, row, hashes in _grams(texts):
        for probe in range(PROBES):
            at = _bit(hashes, slices, probe)
            known = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row, hashes = row[known], hashes[known]
        rows.append(row)
        keys.append(hashes.view(np.int64))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(key, prepend=0) != 0))
    return np.split(key[first], np.searchsorted(row[first], np.arange(1, len(texts))))


def _sent(rows: DataFrame, name: Column, known: Broadcast, slices: int) -> DataFrame:
    """(_gram, _row): each row once for each key that its name contains, and seldom for another gram."""

    @F.pandas_udf("array<long>")
    def hits(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.frombuffer(known.value, np.uint8)
        for batch in names:
            texts = [b"" if t is None else t for t in batch]
            yield pd.Series([h for a, b in _pieces([len(t) for t in texts]) for h in _hits(texts[a:b], bits, slices)], dtype=object)

    return rows.withColumn("_grams", hits.asNondeterministic()(name.cast("binary"))).select(F.explode("_grams").alias("_gram"), "_row")


def match_rule_table(dim: DataFrame, rules: DataFrame, name_column: str = "name", unit_column: str = "units", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(rule_id, title and all columns of ``dim``): a row for each pair of rule (rule_id, title, name_pattern, unit_pattern) and row that match."""
    spark = dim.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, name = dim.select(F.struct(*dim.columns).alias("_row")), F.lower(F.col("_row")[name_column])
    asked = rules.select("rule_id", "title", "name_pattern", "unit_pattern").filter(F.col("name_pattern").isNotNull() & F.col("unit_pattern").isNotNull())
    path = scratch_path(spark, "rules")
    with brief_shuffles(spark):
        places = min(max((4 * rows.count()).bit_length(), COUNT_BITS[0]), COUNT_BITS[1])
        levels = spark.sparkContext.broadcast(_counts(rows.select(name.alias("_name")), places))
        with_keys(asked.repartition(tasks), levels).write.option("compression", "zstd").parquet(path)
    known = spark.read.parquet(path)
    # A gram that no name has settles its rule: such a rule matches nothing.
    indexed = known.filter((F.size("literals") > 0) & F.col("rule_id").isNotNull() & (F.col("_rows") > 0))
    slices = min((16 * indexed.count() >> FILTER_SLICE).bit_length(), FILTER_SLICES)
    with brief_shuffles(spark):
        keys = spark.sparkContext.broadcast(_filter(indexed, slices))
    # One exchange for both uses: nulls, which match nothing, go before it in either.
    spread = rows.filter(F.col("_row")[name_column].isNotNull()).repartition(tasks)
    hot = indexed.filter(F.col("_rows") > hot_rows).groupBy("_gram").agg(F.max("_rows").alias("_rows"))
    pairs = join_keys(indexed.drop("_rows"), _sent(spread, name, keys, slices), "_gram", hot_rows, hint="merge", counts=hot)
    fits = F.expr(f"_row.`{name_column}` RLIKE concat('(?i)', name_pattern) AND _row.`{unit_column}` RLIKE concat('(?i)', unit_pattern)")
    found = pairs.filter(F.forall("literals", lambda run: F.contains(name, run))).filter(fits).select("rule_id", "title", "_row")
    rest = known.filter(F.size("literals") == 0).select("rule_id", "title", "name_pattern", "unit_pattern")
    if blocks := -(-rest.count() // BLOCK):
        found = found.unionByName(_without_literal(spread, name, rest, blocks, tasks, fits))
    return found.select("rule_id", "title", "_row.*")


def _without_literal(rows: DataFrame, name: Column, rules: DataFrame, blocks: int, shares: int, fits: Column) -> DataFrame:
    """Every row against rules in blocks of bounded size; a single block is broadcast, several are each copied to every share of the rows."""
    block = F.collect_list(F.struct(*rules.columns)).alias("_rules")
    if blocks == 1:
        met = rows.crossJoin(F.broadcast(rules.agg(block)))
    else:
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        listed = (rules.groupBy(F.pmod(F.xxhash64("rule_id", "name_pattern", "unit_pattern"), F.lit(blocks)).cast("int").alias("_block"))
                  .agg(block).withColumn("_share", numbers(shares)))
        met = rows.withColumns({"_block": numbers(blocks), "_share": F.pmod(F.xxhash64(name), F.lit(shares)).cast("int")})
        met = met.join(listed.hint("merge"), ["_block", "_share"])
    return met.select("_row", F.inline("_rules")).filter(fits).select("rule_id", "title", "_row")
