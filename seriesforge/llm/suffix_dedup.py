"""Removal of repeated strings by distributed prefix doubling over a consistent sample of positions.

A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller key.
Doubling over every position would move each byte of the corpus some thirty times as (position, rank) pairs. So only
sampled positions are ranked: of every string of ``length`` bytes the position whose first ``2/5 length`` bytes have the
least name, leftmost among equals. Equal strings choose the same position, so each repeated string meets its
copies there, and about one position in sixteen is left.

* Round 0, inside a task: names of 1, 2, 4, ... bytes, each from the pair of names at the growing offset.
* Round 1: positions are dealt by the name of ``2/5 length`` bytes and sorted by the pairs of that name and the name of the
  next, or the previous, bytes. Pairs held by one text only are unique (copies of a whole text are found by digest): their strings end here. A pair that a batch of documents repeats sends two of its positions,
  whatever their number, as the others are known to be repeated.
* Round 2: what is left is dealt by that name again, together with the bytes around it, equal bytes of a task once, and ranked by
  the pairs of names that reach ``length`` bytes, past the threshold. A string is repeated where the least key of its rank
  is smaller than its own. The strings of names with over ``HOT`` positions are dealt by their own names instead, equal strings of a batch
  once, so no group meets in one task.

What a task already knows to be repeated takes no part in a round: it goes along as spans, merged for each document.

Names are hashes; equal strings always have equal names, and strings count as equal when two 64-bit names agree
among those that share the first one too. Texts travel
compressed; what round 1 finds is written to the shared folder, all else is in shuffles, so a lost executor costs its own tasks.

Defined cases: null and empty texts have no bytes; keys decide what is smaller, so equal keys never remove each other,
and a null key neither removes nor loses anything; repeated rows get equal results each; documents shorter than
``length`` stay whole; other columns pass through unless an output column has their name; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.llm.common import scratch_path, whole_text, written

HOT = 100_000  # positions of one name
BUCKET_BYTES = 24 << 20  # text whose sampled positions are sorted together
CHUNK_ROWS = 30_000
PART_BYTES = 16 << 20  # text whose positions a task sorts at a time
OUT_POSITIONS = 1 << 17  # positions that a task writes at a time
BLOCK_BYTES = 1 << 18  # bytes whose names are doubled together
SMALL_PART_BYTES = 2 << 20  # compressed text that a task works on at a time
U = np.uint64


def _table(seed: int) -> np.ndarray:
    """A 64-bit name for each byte, by the splitmix recurrence."""
    x = (np.arange(1, 257, dtype=U) + U(seed * 256)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLES = (_table(0), _table(1))


def names(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The name of the ``length`` bytes from each position on, doubled from pairs at growing offsets."""
    power, size = TABLES[seed][data], 1
    out, have = None, 0
    while True:
        if length & size:
            out = power if out is None else _pair(out, power, have)
            have += size
        if 2 * size > length:
            return out
        power = _pair(power, power, size)
        size *= 2


def _pair(first: np.ndarray, second: np.ndarray, offset: int) -> np.ndarray:
    n = len(second) - offset
    if n <= 0:
        return first[:0]
    x, y = first[:n] * U(0x9E3779B97F4A7C15), second[offset:] ^ U(0x5851F42D4C957F2D)
    x += y
    np.right_shift(x, U(32), out=y)
    x ^= y
    x *= U(0xD6E8FEB86659FD93)
    return x


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(position, name, first start, last start) of each sampled position and the strings that choose it."""
    k = max(2 * length // 5, 1)
    least = names(data, k)
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, U, np.int64, np.int64))
    all_names, wide = least, length - k + 1
    # 32 bits of the name, by which equal strings still choose alike, above the position: leftmost among equals
    least, size = (least & U(0xFFFFFFFF00000000)) | np.arange(len(least), dtype=U), 1
    while size < wide:
        step = min(size, wide - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    where = (least & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
    at = where[first]
    return at, all_names[at], first, np.append(first[1:], len(where)) - 1


def _parts(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in a column, one row at least."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def _codes(data: np.ndarray, at: np.ndarray, name: np.ndarray, length: int) -> np.ndarray:
    """48 bits of the name and a byte each for the next and the previous few bytes (0: the text has none there).

    A string that chose a position holds the next or the previous ``(length - 2/5 length) / 2`` bytes whole, so a repeated one
    shares name and next, or name and previous.
    """
    k = max(2 * length // 5, 1)
    far = min(8, (length - k) // 2)
    code = name & U(0xFFFFFFFFFFFF0000)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each position on
    for shift, start in ((U(8), at + k), (U(0), at - far)):
        there = np.flatnonzero((start >= 0) & (start + far <= len(data)))
        x = (eight[start[there]] & U((1 << 8 * far) - 1)) * U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        code[there] |= (U(1) + (x >> U(40)) % U(255)) << shift
    return code


def _keys(name: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of the name."""
    return ((name >> U(16)) % U(buckets) << U(32)) | (name >> U(32))


def _positions(length: int, buckets: int):
    """Round 1's rows: for each batch and bucket the sampled positions, and those known to be repeated."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "text", PART_BYTES):
            doc, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            texts = batch.column("text")
            order = np.lexsort((doc, tag))
            copy = np.zeros(len(doc), bool)  # of a text of the batch with a smaller key: judged as a copy later
            for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
                copy[b] = tag[a] == tag[b] and doc[b] > doc[a] and texts[a] == texts[b]
            pos, code, rows = [], [], np.flatnonzero(~copy)
            for r in rows.tolist():
                data = np.frombuffer(texts[r].as_buffer(), np.uint8)
                at, name = anchors(data, length)[:2]
                pos.append(at.astype(np.int32))
                code.append(_codes(data, at, name, length))
            if not sum(map(len, pos)):
                continue
            row = np.repeat(rows.astype(np.int32), [len(x) for x in pos])
            pos = np.concatenate(pos)
            code = np.concatenate(code)
            known, weight = known_pairs(code, row, tag)
            bucket = (code >> U(16)) % U(buckets)
            bucket = bucket.astype(np.int32)
            for direct in (True, False):
                chosen = np.flatnonzero(known == direct).astype(np.int32)
                chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
                ends, at = np.cumsum(np.bincount(bucket[chosen], minlength=buckets)), 0
                while at < len(chosen):  # whole buckets, about so many positions at a time
                    to = int(ends[min(np.searchsorted(ends, at + OUT_POSITIONS), buckets - 1)])
                    yield _packed(chosen[at:to], direct, doc, tag, row, pos, bucket, code, weight)
                    at = to

    def known_pairs(code: np.ndarray, row: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a position is known to be repeated, and for how many it stands."""
        known, weight = np.zeros(len(code), bool), np.ones(len(code), np.int32)
        order, start, size = _runs(code)
        if len(order):
            own = tag[row[order]]
            other = np.flatnonzero(own != np.repeat(own[start], size))  # of another text than the first of the run
            run, which = np.unique(np.searchsorted(start, other, side="right") - 1, return_index=True)
            several = np.zeros(len(start), bool)
            several[run] = True
            known[order[np.repeat(several, size)]] = True
            known[order[start]] = known[order[other[which]]] = False
            weight[order[start[run]]] = size[run] - 1
        return known, weight

    return emit


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of keys that occur twice at least, run by run, where the runs start among these, and their sizes."""
    if len(key) < 2:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    order = np.argsort(key).astype(np.int32)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    del ordered
    inside = np.append(False, same)
    twice = inside | np.append(same, False)
    order, start = order[twice], np.flatnonzero(~inside[twice])
    return order, start, np.diff(np.append(start, len(order)))


POSITIONS = ("bucket int, direct boolean, doc array<long>, tag array<long>, n array<int>, low array<short>, high array<short>, "
             "name array<int>, near array<short>, weight array<int>")


def _packed(chosen, direct, doc, tag, row, pos, bucket, code, weight) -> pa.RecordBatch:
    """A row for each bucket; documents once with the number of their positions, numbers in their fewest bytes."""
    row, pos, bucket, code = row[chosen], pos[chosen], bucket[chosen], code[chosen]
    new = np.append(True, bucket[1:] != bucket[:-1])
    starts = np.flatnonzero(new)
    docs = np.flatnonzero(new | np.append(True, row[1:] != row[:-1]))
    by_doc = pa.array(np.append(np.searchsorted(docs, starts), len(docs)), pa.int32())
    by_pos = pa.array(np.append(starts, len(pos)), pa.int32())
    columns = [(by_doc, doc[row[docs]]), (by_doc, tag[row[docs]]), (by_doc, np.diff(np.append(docs, len(pos))).astype(np.int32)),
               (by_pos, (pos & 0xFFFF).astype(np.uint16).view(np.int16)), (by_pos, (pos >> 16).astype(np.int16)),
               (by_pos, (code >> U(32)).astype(np.uint32).view(np.int32)),
               (by_pos, code.astype(np.uint16).view(np.int16)), (by_pos, weight[chosen])]
    if direct:  # only documents and places are needed
        empty = pa.array(np.zeros(len(starts) + 1), pa.int32())
        columns[5:] = [(empty, c[1][:0]) for c in columns[5:]]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts]), pa.array(np.full(len(starts), direct)), *(pa.ListArray.from_arrays(o, pa.array(v)) for o, v in columns)],
        ["bucket", "direct", "doc", "tag", "n", "low", "high", "name", "near", "weight"])


def _shared(hot: int):
    """Positions that more than one document shares, as a row for each document; names with over ``hot`` positions."""

    def flat(parts: list, column: str) -> np.ndarray:
        return np.concatenate([p.column(column).flatten().to_numpy(zero_copy_only=False) for p in parts])

    def places(parts: list) -> tuple[np.ndarray, ...]:
        """Documents and tags, and of each position the number of its document and the place."""
        n = flat(parts, "n")
        pos = flat(parts, "high").astype(np.int32)
        pos <<= 16
        pos |= flat(parts, "low").view(np.uint16)
        return flat(parts, "doc"), flat(parts, "tag"), np.repeat(np.arange(len(n), dtype=np.int32), n), pos

    def rows(doc, tag, pos):
        order = np.lexsort((pos, tag, doc))
        doc, tag, pos = doc[order], tag[order], pos[order]
        ends = np.append(np.flatnonzero((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])) + 1, len(doc))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[ends - 1]), pa.array(tag[ends - 1]), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(pos)),
             pa.nulls(len(ends), pa.int64())], ["doc", "tag", "pos", "hot"])

    def repeated(name: np.ndarray, near: np.ndarray, tag: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether texts of several tags have the pair; nothing is near where that is 0."""
        order, start, size = _runs(name.astype(U) << U(8) | near)
        out = np.zeros(len(name), bool)
        if len(order):
            own = tag[row[order]]
            out[order] = np.repeat(np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start), size)
        out &= near > 0
        return out

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                if row.column("direct")[0].as_py():
                    doc, tag, of, pos = places([row])
                    yield rows(doc[of], tag[of], pos)
                else:
                    held.setdefault(row.column("bucket")[0].as_py(), []).append(row)
        for bucket in list(held):
            parts = held.pop(bucket)
            doc, tag, row, pos = places(parts)
            name, near, weight = flat(parts, "name").view(np.uint32), flat(parts, "near").view(np.uint16), flat(parts, "weight")
            del parts
            keep = repeated(name, (near >> 8).astype(np.uint8), tag, row)
            keep |= repeated(name, near.astype(np.uint8), tag, row)
            if not keep.any():
                continue
            row, name, weight = row[keep], name[keep], weight[keep]
            yield rows(doc[row], tag[row], pos[keep])
            names_, of = np.unique(name, return_inverse=True)
            many = names_[np.bincount(of, weight) > hot].astype(np.int64) | bucket << 32
            none = pa.nulls(len(many))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.list_(pa.int32())), pa.array(many)],
                                             ["doc", "tag", "pos", "hot"])

    return share


ROWS = "name long, doc long, tag long, starts array<int>, size int, bytes binary"
ROWS_ARROW = pa.schema([("name", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("starts", pa.list_(pa.int32())),
                        ("size", pa.int32()), ("bytes", pa.binary())])
FOUND = "doc long, tag long, pos array<int>, hot long"
RANKED = "doc long, tag long, lo int, hi int"


def _settled(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Rows without bytes, one for each document with its spans as (first byte, end) in ``starts``, merged where they touch.

    Their names are negative.
    """
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = doc[order], tag[order], lo[order], hi[order]
    own = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))
    shift = np.cumsum(own) << 32  # spans of different documents never touch
    top = np.maximum.accumulate(hi + shift)
    new = np.flatnonzero(np.append(True, (lo + shift)[1:] > top[:-1]))
    pairs = np.column_stack((lo[new], (top - shift)[np.append(new[1:], len(lo)) - 1])).astype(np.int32)
    first = np.flatnonzero(own)
    doc, tag = doc[first], tag[first]
    ends = 2 * np.append(np.searchsorted(new, first), len(new))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.where(doc >= 0, ~doc, doc)), pa.array(doc), pa.array(tag), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs.ravel())),
         pa.array(np.zeros(len(doc), np.int32)), pa.nulls(len(doc), pa.binary())], schema=ROWS_ARROW)


def _repeat_lists(lists: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the rows ``of`` one after the other, and their sizes."""
    size = lists.value_lengths().to_numpy()
    begin, n = np.cumsum(size) - size, size[of]
    return lists.flatten().to_numpy()[np.repeat(begin[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], n


def _strings(table: pa.Table | pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """All bytes of the rows; the row, the place in it and the place among all bytes of each string; its two names."""
    size = table.column("size").to_numpy()
    data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    count = size.astype(kind) - length + 1
    row = np.repeat(np.arange(len(size), dtype=np.int32), count)
    inside = np.arange(len(row), dtype=kind)
    inside -= np.repeat(np.cumsum(count, dtype=kind) - count, count)
    at = np.repeat(np.cumsum(size, dtype=kind) - size, count)
    at += inside
    return data, row, inside, at, _names_at(data, at, length, 0), _names_at(data, at, length, 1)


def _names_at(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The names of the ``length`` bytes from growing positions on, doubled for a block of the data at a time."""
    out = np.empty(len(at), U)
    for start in range(0, len(data), BLOCK_BYTES):
        lo, hi = np.searchsorted(at, (start, start + BLOCK_BYTES))
        if lo < hi:
            out[lo:hi] = names(data[start:start + BLOCK_BYTES + length - 1], length, seed)[at[lo:hi] - start]
    return out


def _least(one: np.ndarray, two: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least key among the strings with the same two names, for each string."""
    order, start, size = _runs(one)
    least = own.copy()
    if not len(order):
        return least
    other = two[order]
    if (other != np.repeat(other[start], size)).any():  # two strings with the same first name
        order = order[np.lexsort((other, one[order]))]
        start = np.flatnonzero(np.append(True, (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])))
        size = np.diff(np.append(start, len(order)))
    least[order] = np.repeat(np.minimum.reduceat(own[order], start), size)
    return least


def _contexts(length: int, buckets: int, one_text: bool, hot: np.ndarray | None = None):
    """Round 2's rows: the name, the first starts and the bytes of all strings that chose a position.

    Equal bytes meet in the task already: the least document of a part sends them once, with all its starts. For the others it
    is settled that all these strings are repeated; their spans go along without bytes. Rows of ``hot`` names are split
    here, by the same worker.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in _parts(batches, "_packed", SMALL_PART_BYTES):
            seen: dict = {}  # (bytes, tag) -> number
            parts = []  # (number, document, tag, name, first byte, end) of each place
            for doc, tag, known, lists, packed in zip(*(batch.column(c).to_pylist() for c in ("doc", "_tag", "_known", "pos", "_packed"))):
                if not known:
                    continue
                tag, raw = 0 if one_text else tag, unpack.decompress(packed)
                at, name, first, last = anchors(np.frombuffer(raw, np.uint8), length)
                asked = np.zeros(len(raw), bool)
                for positions in lists:
                    asked[positions] = True
                chosen = np.flatnonzero(asked[at])
                lo, hi = first[chosen], last[chosen] + length
                strings = map(raw.__getitem__, map(slice, lo.tolist(), hi.tolist()))
                numbers = [seen.setdefault(x if one_text else (x, tag), len(seen)) for x in strings]
                key = _keys(name[chosen] & U(0xFFFFFFFFFFFF0000), buckets).view(np.int64)
                parts.append(np.array([numbers, np.full(len(lo), doc), np.full(len(lo), tag), key, lo, hi], np.int64))
            if not seen:
                continue
            number, doc, tag, key, lo, hi = np.concatenate(parts, axis=1)
            least = np.full(len(seen), np.iinfo(np.int64).max)
            np.minimum.at(least, number, doc)
            gone = doc > least[number]
            if gone.any():
                yield _settled(doc[gone], tag[gone], lo[gone], hi[gone])
            kept = np.flatnonzero(~gone)
            kept = kept[np.argsort(number[kept], kind="stable")]
            start = np.flatnonzero(np.append(True, number[kept[1:]] != number[kept[:-1]]))  # one for each string, in the order of seen
            of = kept[start]
            starts = pa.ListArray.from_arrays(pa.array(np.append(start, len(kept)), pa.int32()), pa.array(lo[kept].astype(np.int32)))
            text = pa.array(list(seen) if one_text else [x for x, _ in seen], pa.binary())
            rows = pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(least), pa.array(tag[of]), starts, pa.array((hi - lo)[of].astype(np.int32)), text],
                                              schema=ROWS_ARROW)
            for k in range(0, rows.num_rows, CHUNK_ROWS):
                yield rows.slice(k, CHUNK_ROWS)

    def marked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.append_column("hot", pa.array(np.ones(batch.num_rows, bool), mask=~np.isin(batch.column("name").to_numpy(), hot)))

    if hot is None or not len(hot):
        return emit
    return lambda batches: _split(length)(marked(emit(batches)))


def _split(length: int):
    """Rows as they are, but of hot names' a row for each string, named by the string; what the batch shows to be repeated is settled."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = pa.compute.is_valid(batch.column("hot"))
            yield batch.filter(pa.compute.invert(hot)).select(ROWS_ARROW.names)
            batch = batch.filter(hot)
            for part in _parts(iter([batch]), "bytes", PART_BYTES // 16):
                yield from strings(part)

    def strings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, tag = (batch.column(c).to_numpy() for c in ("doc", "tag"))
        data, row, inside, at, one, two = _strings(batch, length)
        own = doc[row]
        gone = own > _least(one, two, own)
        start, n = _repeat_lists(batch.column("starts"), row)
        start = (start + np.repeat(inside, n)).astype(np.int32)
        if gone.any():
            lo, of = start[np.repeat(gone, n)].astype(np.int64), np.repeat(row[gone], n[gone])
            yield _settled(doc[of], tag[of], lo, lo + length)
        kept = np.flatnonzero(~gone)
        ends = pa.array(np.append(0, np.cumsum(n[kept])), pa.int32())
        text = np.lib.stride_tricks.sliding_window_view(data, length)[at[kept]] if len(kept) else data[:0]
        text = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(kept), [None, pa.py_buffer(text)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(one[kept].view(np.int64)), pa.array(doc[row[kept]]), pa.array(tag[row[kept]]), pa.ListArray.from_arrays(ends, pa.array(start[np.repeat(~gone, n)])),
             pa.array(np.full(len(kept), length, np.int32)), text.cast(pa.binary())], schema=ROWS_ARROW)

    return emit


def _ranked(length: int):
    """Spans to remove among rows sorted by name; a name's rows are never cut."""

    def spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        settled = table.filter(pa.compute.is_null(table.column("bytes")))
        if settled.num_rows:
            starts = settled.column("starts").combine_chunks()
            of = np.repeat(np.arange(settled.num_rows), starts.value_lengths().to_numpy() // 2)
            flat = starts.flatten()
            yield pa.RecordBatch.from_arrays([settled.column("doc").take(of).combine_chunks(), settled.column("tag").take(of).combine_chunks(),
                                              flat[::2], flat[1::2]], ["doc", "tag", "lo", "hi"])
        table = table.filter(pa.compute.is_valid(table.column("bytes")))
        if not table.num_rows:
            return
        doc, tag = (table.column(c).to_numpy() for c in ("doc", "tag"))
        row, inside, one, two = operator.itemgetter(1, 2, 4, 5)(_strings(table, length))
        own = doc[row]
        gone = own > _least(one, two, own)
        del one, two, own
        edge = np.append(True, row[1:] != row[:-1])
        lo = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
        hi = np.flatnonzero(gone & np.append(edge[1:] | ~gone[1:], True))
        start, n = _repeat_lists(table.column("starts").combine_chunks(), row[lo])
        of = np.repeat(row[lo], n)
        yield pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(tag[of]), pa.array((start + np.repeat(inside[lo], n)).astype(np.int32)),
                                          pa.array((start + np.repeat(inside[hi] + length, n)).astype(np.int32))], ["doc", "tag", "lo", "hi"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column("name").to_numpy()
            before = np.flatnonzero(name != name[-1])
            cut_at = int(before[-1]) + 1 if len(before) else 0
            if cut_at:
                yield from spans(pa.Table.from_batches([*rest, batch.slice(0, cut_at)]))
                rest = []
            rest.append(batch.slice(cut_at))
        if rest:
            yield from spans(pa.Table.from_batches(rest))

    return rank


def _tag(text):
    """Tells apart different texts under the same key."""
    return F.xxhash64(text)


def _same(by: list[str]):
    return functools.reduce(lambda a, b: a & b, [F.col({"doc": "_key", "tag": "_tag"}[c]) == F.col(c) for c in by])


def packed_texts(text: str):
    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.array([squeeze.compress(t.as_buffer()) for t in batch], pa.binary())

    return pack(text)


def repeated_spans(docs: DataFrame, texts: DataFrame, copies: DataFrame, length: int, one_text: bool) -> DataFrame:
    """(doc, tag, lo, hi): byte spans to remove from rows (doc, tag, text) with keys and hashes of texts.

    ``texts`` has the compressed texts (_key, _tag, _packed). ``copies`` (doc, tag) have the text of a smaller key. They go whole, and
    what they hold starts in that document too, so they need not be ranked. Where each key has ``one_text``, tags are
    left out of what is shuffled.
    """
    spark = docs.sparkSession
    known = docs.filter("doc IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    found = written(known.mapInArrow(_positions(length, buckets), POSITIONS)
                    .repartitionById(buckets, F.col("bucket"))
                    .mapInArrow(_shared(HOT), FOUND), scratch_path(spark, "repeats"))
    by = ["doc"] if one_text else ["doc", "tag"]
    shared = (found.filter("hot IS NULL").groupBy(*by).agg(F.collect_list("pos").alias("pos"))
              .join(copies, by, "left_anti"))
    # At most one name for every HOT positions, so these are few.
    hot = np.array([r.hot for r in found.filter("hot IS NOT NULL").select("hot").collect()], np.int64)
    rows = texts.join(shared, _same(by)).mapInArrow(_contexts(length, buckets, one_text, hot), ROWS)
    # The window sorts by name, and demands that a name's rows stay together: adaptive execution may not split them for a join.
    in_order = F.row_number().over(W.partitionBy("name").orderBy("doc"))
    return rows.repartition("name").withColumn("nth", in_order).mapInArrow(_ranked(length), RANKED)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, out: str = "dedup",
                   whole_characters: bool = False) -> DataFrame:
    """Adds a struct to every row: n_bytes, the removed ``spans`` (lo, hi) in order, n_removed, kept bytes.

    With ``whole_characters`` a character goes only with all of its bytes, so that what is kept stays UTF-8.
    """
    if length < 2:
        raise ValueError("strings of two bytes at least")
    plain = df.select(F.col(key).alias("doc"), whole_text(text).alias("text")).select(
        "doc", _tag("text").alias("tag"), "text")
    thin = plain.filter("doc IS NOT NULL").select("doc", "tag")
    one_text = thin.groupBy("doc").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).filter("a <> b").isEmpty()
    copies = plain.filter(F.octet_length("text") >= length).select("doc", "tag", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("hi"))
    first = copies.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = copies.join(first, "digest").filter("doc > first").select("doc", "tag", F.lit(0).alias("lo"), "hi").distinct()
    rest = [c for c in df.columns if c not in (text, out)]
    # Both joins below take the texts from the same shuffle, so both need the same columns and no filter of their own.
    own = df.select(F.struct(*rest).alias("_row"), F.coalesce(key, F.lit(0)).alias("_key"), F.col(key).isNotNull().alias("_known"),
                    _tag(whole_text(text)).alias("_tag"), packed_texts(whole_text(text)).alias("_packed"))
    spans = repeated_spans(plain, own, copies.select("doc", "tag"), length, one_text)
    by = ["doc"] if one_text else ["doc", "tag"]
    spans = spans.unionByName(copies).groupBy(*by).agg(F.collect_list(F.struct("lo", "hi")).alias("_found"))
    joined = own.join(spans, _same(by), "left")

    result = T.StructType([own.schema["_row"], T.StructField(out, T.StructType.fromDDL(RESULT))])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in _parts(batches, "_packed", SMALL_PART_BYTES):
            rows = [_without(unpack.decompress(p), f, whole_characters)
                    for p, f in zip(batch.column("_packed").to_pylist(), pa.compute.if_else(batch.column("_known"), batch.column("_found"), None).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(rows, RESULT_ARROW)], ["_row", out])

    return joined.select(*own.columns, "_found").mapInArrow(remove, result).select("_row.*", out)


RESULT = "n_bytes long, n_removed long, spans array<struct<lo int, hi int>>, kept binary"
RESULT_ARROW = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                          ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), ("kept", pa.binary())])


def _without(raw: bytes, found, whole_characters: bool) -> dict:
    n = len(raw)
    if found is None or not len(found):
        return {"n_bytes": n, "n_removed": 0, "spans": [], "kept": raw}
    spans = np.array([(s["lo"], s["hi"]) for s in found], np.int64)
    level = np.zeros(n + 1, np.int64)
    np.add.at(level, spans[:, 0], 1)
    np.add.at(level, np.minimum(spans[:, 1], n), -1)
    gone = np.cumsum(level)[:n] > 0
    data = np.frombuffer(raw, np.uint8)
    if whole_characters and n:
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        whole = np.logical_and.reduceat(gone, starts)
        gone = np.repeat(whole, np.diff(np.append(starts, n)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    pairs = [{"lo": int(a), "hi": int(b)} for a, b in zip(edges[::2], edges[1::2])]
    return {"n_bytes": n, "n_removed": int(gone.sum()), "spans": pairs, "kept": data[~gone].tobytes()}
