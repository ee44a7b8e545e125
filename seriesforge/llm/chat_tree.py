"""Chat formatting as prefix trees.

Conversations that begin with the same turns share those turns' tokens. Each turn becomes a node named by a digest
of its parent's name, its role and its text, so equal beginnings have equal names wherever they are. A conversation's sort key is the
chain of nodes it takes where its tree branches; sorted by it, conversations stand in depth-first order, and a task
that reads them in turn encodes and writes a node only where the path leaves the one before. What is shuffled are turns' texts, never tokens; who
owns a node, and where each conversation stands, is settled before on names alone. What a task writes are packs of
bounded size: token ids, position ids that count along the path from the root, and for each segment the intervals of the pack that its
ancestors fill. Attention to these and to itself makes every conversation read as if it stood alone. Where a pack ends
inside a tree, the next one repeats the open path, marked as context without loss; its ``targets`` still say which of its tokens carry loss in the
pack that owns it.

The template is <|im_start|>role, newline, text, <|im_end|>, newline. Control strings in roles and texts are escaped reversibly: a backslash
is doubled, and one is put behind the first character of a control string. Header, text and end of a turn are
encoded apart, so the loss mask covers the tokens of assistants' texts and nothing else.

Groups: a first turn that a third of all conversations share is one key of sums that are combined before their shuffle, and
of joins that adaptive execution splits; sorted by whole paths, its tree spreads over many tasks. One conversation must fit into
a task's memory. Defined cases: null texts and roles are empty; turns are read by turn, role and text, nulls first; repeated rows are
turns of their own; equal conversations end at the same node; a null conv_id is one conversation; other columns
are ignored; an empty table gives no pack.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesforge.llm.common import cut, in_pieces

PACK_TOKENS = 16384
OPEN, END = "<|im_start|>", "<|im_end|>\n"
# Strings that chat templates use as controls.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<pad>", "<unk>",
           "<start_of_turn>", "<end_of_turn>"]
_FIRST = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _FIRST.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _tokenizer(model: str) -> Tokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(model)
    tokenizer.encode_special_tokens = True  # texts hold no special tokens, only text
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


NODES = "conv_id long, depth int, node binary, parent binary"
TURNS = "key binary, conv_id long, depth int, node binary, owner boolean, role string, text string"


def _name(parent: bytes, role: str, text: str) -> bytes:
    own = role.encode()
    return hashlib.blake2b(b"".join((parent, len(own).to_bytes(8, "little"), own, text.encode())), digest_size=16).digest()


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list, list]]:
    """Names and depths of the turns of sorted conversations; a conversation may span batches."""
    conv, name, depth = object(), b"", 0
    for batch in batches:
        rows, parents = [], []
        for c, role, text in zip(batch["conv_id"].astype(object), batch["role"], batch["text"]):
            c = None if pd.isna(c) else int(c)
            if c != conv:
                conv, name, depth = c, b"", 0
            parents.append(name)
            name = _name(name, role, text)
            rows.append((c, depth, name))
            depth += 1
        yield batch, rows, parents


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, rows, parents in _chain(batches):
        out = pd.DataFrame(rows, columns=["conv_id", "depth", "node"]).assign(parent=parents)
        yield out.astype({"conv_id": "Int64"})


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The turns of conversations whose head comes first, each with the conversation's key and whether it owns the turn's node."""
    name, depth, key, owned = b"", 0, b"", []
    for batch in batches:
        out = []
        columns = (batch["kind"], batch["conv_id"].astype(object), batch["key"], batch["owned"], batch["role"], batch["text"])
        for kind, c, own_key, own, role, text in zip(*columns):
            if kind == 0:
                name, depth, key, owned = b"", 0, own_key, own
                continue
            name = _name(name, role, text)
            out.append((key, None if pd.isna(c) else int(c), depth, name, bool(owned[depth]), role, text))
            depth += 1
        yield pd.DataFrame(out, columns=[x.split()[0] for x in TURNS.split(", ")]).astype({"conv_id": "Int64"})


PACKS = ("pack string, ids array<int>, positions array<int>, loss array<boolean>, segments array<struct<node binary, parent int, role string, "
         "start int, text_start int, text_end int, end int, context boolean, targets array<struct<start int, end int>>, visible array<struct<start int, end int>>>>, "
         "leaves array<struct<conv_id long, segment int>>")


class _Encoder:
    """Tokens of turns: header, text and end apart. What the path before and the open one hold is remembered."""

    def __init__(self, model: str):
        self.tokenizer, self.marks, self.known = _tokenizer(model), {}, {}

    def _mark(self, text: str) -> list[int]:
        if text not in self.marks:
            if len(self.marks) > 1000:
                self.marks.clear()
            self.marks[text] = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.marks[text]

    def encode(self, path: list, needed: set[bytes]) -> None:
        """Makes the tokens of the path's needed nodes known, and forgets other paths."""
        new = [r for r in path if r.node in needed and r.node not in self.known]
        texts = (e.ids for part in in_pieces((escape(r.text) for r in new), 1 << 17)
                 for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))
        fresh = {r.node: (self._mark(f"{OPEN}{escape(r.role)}\n"), text, self._mark(END)) for r, text in zip(new, texts)}
        self.known = {r.node: fresh.get(r.node) or self.known[r.node] for r in path if r.node in fresh or r.node in self.known}

    def size(self, node: bytes) -> int:
        return sum(map(len, self.known[node]))


class _Pack:
    def __init__(self):
        self.ids, self.positions, self.loss, self.segments, self.leaves, self.at, self.after = [], [], [], [], [], {}, []

    def size(self) -> int:
        return self.segments[-1]["end"] if self.segments else 0

    def add(self, row, tokens: tuple, parent: int, context: bool) -> int:
        head, text, end = tokens
        start, n = self.size(), len(head) + len(text) + len(end)
        up = self.segments[parent] if parent >= 0 else None
        visible = [dict(v) for v in up["visible"]] if up else []
        if up and visible and visible[-1]["end"] == up["start"]:
            visible[-1]["end"] = up["end"]
        elif up:
            visible.append({"start": up["start"], "end": up["end"]})
        text_start, offset = start + len(head), self.after[parent] if up else 0
        targets = [{"start": text_start, "end": text_start + len(text)}] if row.role == "assistant" and len(text) else []
        self.segments.append({"node": row.node, "parent": parent, "role": row.role, "start": start, "text_start": text_start,
                              "text_end": text_start + len(text), "end": start + n, "context": context, "targets": targets, "visible": visible})
        self.ids.append(np.array([*head, *text, *end], np.int32))
        self.positions.append(np.arange(offset, offset + n, dtype=np.int32))
        mask = np.zeros(n, bool)
        if not context:
            for t in targets:
                mask[t["start"] - start:t["end"] - start] = True
        self.loss.append(mask)
        self.after.append(offset + n)
        self.at[row.node] = len(self.segments) - 1
        return len(self.segments) - 1

    def row(self) -> tuple:
        name = hashlib.blake2b(b"".join(s["node"] for s in self.segments) + repr(self.leaves).encode(), digest_size=16).hexdigest()
        return (name, np.concatenate(self.ids), np.concatenate(self.positions), np.concatenate(self.loss), self.segments, self.leaves)


def _packed(limit: int, model: str):
    """Packs of conversations that come in depth-first order, whole paths each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["pack", "ids", "positions", "loss", "segments", "leaves"]
        current, path, encoder = _Pack(), [], _Encoder(model)

        def close() -> Iterator[pd.DataFrame]:
            """The path just read goes into the pack, or into the next one."""
            nonlocal current
            if not path:
                return
            encoder.encode(path, {r.node for r in path if r.node not in current.at})
            new = sum(encoder.size(r.node) for r in path if r.node not in current.at)
            if current.segments and current.size() + new > limit:
                yield pd.DataFrame([current.row()], columns=names)
                current = _Pack()
                encoder.encode(path, {r.node for r in path})
            at = -1
            for r in path:
                known = current.at.get(r.node)
                at = current.add(r, encoder.known[r.node], at, not r.owner) if known is None else known
            conv = path[-1].conv_id
            current.leaves.append({"conv_id": None if pd.isna(conv) else int(conv), "segment": at})
            path.clear()

        for batch in batches:
            for r in batch.itertuples(index=False):
                if path and r.depth == 0:
                    yield from close()
                path.append(r)
        yield from close()
        if current.segments:
            yield pd.DataFrame([current.row()], columns=names)

    return pack


def format_chats(conversations: DataFrame, tokenizer_json: str, limit: int = PACK_TOKENS) -> DataFrame:
    """Packs (see ``PACKS``) of all conversations (conv_id, turn, role, text), with at most ``limit`` tokens unless one conversation has more."""
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    thin = cut(ordered.mapInPandas(_nodes, NODES))
    edges = thin.groupBy("parent", "node").agg(F.min("depth").alias("depth"))
    branching = edges.filter("depth > 0").groupBy("parent").count().filter("count > 1").select("parent")
    choices = thin.filter("depth > 0").join(branching, "parent", "left_semi").unionByName(thin.filter("depth = 0"))
    keys = (choices.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("way"))
            .select("conv_id", F.aggregate("way", F.lit(b""), lambda acc, x: F.concat(acc, x["node"])).alias("key")))
    by_conv = F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))
    placed = cut(thin.alias("t").join(keys.alias("k"), by_conv).select("t.conv_id", "depth", "node", "key"))
    owners = placed.groupBy("node").agg(F.min(F.struct("key", "conv_id")).alias("first")).select("node", F.col("first.conv_id").alias("owner"))
    owned = F.transform(F.array_sort(F.collect_list(F.struct("depth", F.col("conv_id").eqNullSafe(F.col("owner")).alias("own")))), lambda x: x["own"])
    heads = placed.join(owners, "node").groupBy("conv_id").agg(F.first("key").alias("key"), owned.alias("owned")).withColumn("kind", F.lit(0))
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    keyed = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").mapInPandas(_turns, TURNS)
    return (keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id", "depth")
            .mapInPandas(_packed(limit, tokenizer_json), PACKS))


def read_back(packs: DataFrame, tokenizer_json: str) -> DataFrame:
    """(conv_id, turns, formatted, loss_text) of each conversation, from the packs alone.

    ``loss_text`` is what the tokens under the loss mask decode to, unescaped; of a repeated context, whose loss is with its owner, what its
    ``targets`` cover.
    """
    schema = "conv_id long, turns array<struct<role string, text string>>, formatted string, loss_text string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(tokenizer_json)
        decode = lambda ids: tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        for batch in batches:
            for p in batch.itertuples(index=False):
                out, nodes = [], []
                for s in p.segments:
                    head, text, end = (decode(p.ids[a:b]) for a, b in (
                        (s["start"], s["text_start"]), (s["text_start"], s["text_end"]), (s["text_end"], s["end"])))
                    masked = decode(p.ids[s["start"]:s["end"]][p.loss[s["start"]:s["end"]]])
                    if s["context"]:
                        masked = "".join(decode(p.ids[t["start"]:t["end"]]) for t in s["targets"])
                    nodes.append((unescape(head[len(OPEN):-1]), unescape(text), head + text + end, unescape(masked)))
                for leaf in p.leaves:
                    path, at = [], leaf["segment"]
                    while at >= 0:
                        path.append(nodes[at])
                        at = p.segments[at]["parent"]
                    path.reverse()
                    out.append((leaf["conv_id"], [{"role": r, "text": t} for r, t, _, _ in path], "".join(x[2] for x in path), "".join(x[3] for x in path)))
                yield pd.DataFrame(out, columns=["conv_id", "turns", "formatted", "loss_text"]).astype({"conv_id": "Int64"})

    return packs.mapInPandas(read, schema)
