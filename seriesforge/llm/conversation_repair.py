"""Cheapest repair of conversations' turns, by dynamic programming over a grammar that all conversations share.

A repaired conversation's roles are an optional system turn and then user and assistant in turn, or nothing. Edits of a row: keep it (0),
give it the role of user or assistant (2), delete it (3); anywhere a user or assistant row without text may be inserted (2). Blank rows and
rows whose role and text came before must be deleted; a row that stays without a full stop at its end costs 1 more. Of the cheapest
repairs the one whose audit, the edits' initials in order, comes first in ASCII is taken.

* Rows become symbols of role and fault (nine of them). They are sorted by conversation and turn over ranges of both, so that a conversation of
  any length is spread over tasks, and packed in order into pieces of at most ``PIECE`` symbols.
* Re-Pair: over all distinct pieces, weighted by their number, Spark counts neighbouring symbols; the most frequent pairs become symbols of
  their own, round after round. What the driver sees is the ``RULES`` first pairs of a round.
* Each symbol has one min-plus transfer matrix over the four states of the role grammar (nothing yet, after system, after user, after
  assistant). An entry is the least cost and a rope of its audit. A rule's matrix is the product of its two symbols' matrices, so it is evaluated
  once, bottom-up, whatever the number of conversations; a piece is the product over its few remaining symbols.
* Insertions count to the row they come before, so an entry's audit ends with a row's edit. Of one piece's audits none is then the
  beginning of another, and the least audit of a whole is made of least audits of its pieces.
* A conversation's pieces are joined by costs from the back, then by choices from the front; then its rows stream past and are edited. Only
  the audit is held, never a conversation's texts.

Defined cases: null roles and texts are empty; a null turn comes before all others, a null conversation is one conversation; rows with equal turns
are ordered by role, then by the MD5 of role and text; repeated rows are duplicates but for the first; empty and very long texts are treated
alike; conversations of ``among`` without rows get a report of zeros; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seriesforge.llm.common import cut

PIECE = 1024  # symbols
ROUNDS, RULES = 8, 32
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
FIRST_RULE = 0xE000  # code points of private use
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {USER: "user", ASSISTANT: "assistant"}
# Where a turn's initial leads, and the inserted turns between two states.
NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
INSERTED = {(BEGIN, USER): 1, (BEGIN, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1,
            **{(x, x): 0 for x in range(4)}}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ENDS = {BEGIN: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECES = ("part int, nth int, symbols string, first_turn long, last_turn long, turns long, first string, last string, "
          "blank long, duplicate long, truncated long, illegal long")

Entry = tuple  # (cost, rope); a rope is a string or a pair of ropes
Matrix = dict  # (state, state) -> entry


def audit_of(rope) -> str:
    """The rope's letters."""
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += (top[1], top[0])
    return "".join(out)


def better(entry: Entry, other: Entry | None) -> bool:
    if other is None or entry[0] != other[0]:
        return other is None or entry[0] < other[0]
    return audit_of(entry[1]) < audit_of(other[1])


def terminal(symbol: str) -> Matrix:
    """The matrix of a row: turns inserted before it, then its edit."""
    edits = [(x, x, DELETE, "D") for x in range(4)]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        edits += [(x, y, KEEP + more, "K") for (x, role), y in NEXT.items() if role == symbol.lower()]
        edits += [(x, y, REROLE + more, "R") for (x, role), y in NEXT.items() if role != "s"]
    out: Matrix = {}
    for (x, z), n in INSERTED.items():
        for at, y, cost, letter in edits:
            if at == z:
                entry = (cost + n * INSERT, "I" * n + letter)
                if better(entry, out.get((x, y))):
                    out[x, y] = entry
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = {}
    for (x, z), (cost, rope) in left.items():
        for y in range(4):
            other = right.get((z, y))
            if other is not None:
                entry = (cost + other[0], (rope, other[1]))
                if better(entry, out.get((x, y))):
                    out[x, y] = entry
    return out


class Grammar:
    """Transfer matrices of all symbols, and of pieces by their symbols."""

    KEPT = 20_000

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.matrices = {s: terminal(s) for s in "xsuaoSUAO"}
        for symbol, pair in rules:
            self.matrices[symbol] = product(*(self.matrices[s] for s in pair))
        self.pieces: dict[str, Matrix] = {}

    def piece(self, symbols: str) -> Matrix:
        if symbols not in self.pieces:
            if len(self.pieces) >= self.KEPT:
                self.pieces.clear()
            first, *rest = encoded(symbols, self.rules)
            matrix = self.matrices[first]
            for symbol in rest:
                matrix = product(matrix, self.matrices[symbol])
            self.pieces[symbols] = matrix
        return self.pieces[symbols]

    def cheapest(self, pieces: list[str]) -> tuple[int, str]:
        """Cost and audit of a conversation given by its pieces in order; nothing costs nothing."""
        matrices = [self.piece(p) for p in pieces]
        behind = [{x: cost for x, (cost, _) in ENDS.items()}]
        for matrix in reversed(matrices):
            costs: dict[int, int] = {}
            for (x, y), (cost, _) in matrix.items():
                costs[x] = min(costs.get(x, cost + behind[-1][y]), cost + behind[-1][y])
            behind.append(costs)
        state, audit, cost = BEGIN, [], behind[-1][BEGIN]
        for matrix, then in zip(matrices, reversed(behind[:-1])):
            ways = [(cost_ + then[y], audit_of(rope), y) for (x, y), (cost_, rope) in matrix.items() if x == state]
            _, letters, state = min(ways)
            audit.append(letters)
        return cost, "".join(audit) + ENDS[state][1]


def encoded(symbols: str, rules: list[tuple[str, str]]) -> str:
    for symbol, pair in rules:
        symbols = symbols.replace(pair, symbol)
    return symbols


def re_pair(texts: DataFrame, rounds: int = ROUNDS, width: int = RULES) -> list[tuple[str, str]]:
    """Rules (symbol, pair) for a table (symbols, n): in each round the most frequent pairs that have no symbol in common."""
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        places = F.filter(F.sequence(F.lit(1), F.length("symbols")), lambda i: i < F.length("symbols"))
        pairs = texts.select(F.explode(F.transform(places, lambda i: F.substr("symbols", i, F.lit(2)))).alias("pair"), "n")
        counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(width).collect()
        new, used = [], set()
        for r in counted:
            if not used & set(r.pair):
                used |= set(r.pair)
                new.append((chr(FIRST_RULE + len(rules) + len(new)), r.pair))
        if not new:
            break
        rules += new
        column = F.col("symbols")
        for symbol, pair in new:
            column = F.replace(column, F.lit(pair), F.lit(symbol))
        texts = cut(texts.select(column.alias("symbols"), "n").groupBy("symbols").agg(F.sum("n").alias("n")))
    return rules


def _features(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                     F.coalesce(text, F.lit("")).alias("text"))
    same = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return rows.withColumns({"later": F.col("turn").isNotNull(), "digest": same})


def _pieces(df: DataFrame) -> DataFrame:
    """(conv, symbols and counts in order) of rows with features."""
    shown = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(shown == "", "x").when(F.right(shown, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    thin = df.select("conv", "later", "turn", "role", "digest", initial.alias("initial"), symbol.alias("symbol"))
    first = thin.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(
        F.min(F.struct("later", "turn")).alias("least"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    known = thin.join(first, same).select(*thin.columns, (~F.col("turn").eqNullSafe(F.col("least.turn"))).alias("again"))
    order = ["conv", "later", "turn", "role", "digest"]
    schema = T.StructType([T.StructField("conv", df.schema["conv"].dataType), *T.StructType.fromDDL(PIECES)])
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, own, before = TaskContext.get().partitionId(), [], None, None

        def finish():
            done.append((own["conv"], part, own["nth"], "".join(own["symbols"]), own["first_turn"], own["last_turn"], own["turns"], own["first"],
                         own["last"], own["blank"], own["duplicate"], own["truncated"], own["illegal"]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*order, "initial", "symbol", "again"])):
                (conv, _, turn, _, _), (initial, symbol, again) = row[:5], row[5:]
                if own is None or own["conv"] != conv or len(own["symbols"]) == PIECE:
                    if own is not None:
                        finish()
                    follows = own is not None and own["conv"] == conv
                    own = {"conv": conv, "nth": own["nth"] + 1 if follows else 0, "symbols": [], "first_turn": turn, "last_turn": None, "turns": 0,
                           "first": initial, "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                fault = "blank" if symbol == "x" else "duplicate" if again or row[:5] == before else "truncated" if symbol.isupper() else None
                before = row[:5]
                if fault:
                    own[fault] += 1
                own["symbols"].append("x" if fault == "duplicate" else symbol)
                if turn is not None and turn != own["last_turn"]:
                    own["turns"] += 1
                    own["first_turn"] = turn if own["first_turn"] is None else own["first_turn"]
                    own["last_turn"] = turn
                if own["last"] is not None:
                    own["illegal"] += own["last"] + initial not in ("su", "ua", "au")
                own["last"] = initial
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                done.clear()
        if own is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    return known.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, schema)


def _report(pieces: list[tuple], grammar: Grammar) -> dict:
    """The pieces (symbols, first turn, last turn, turns, first, last, four counts) of a conversation, in order, as one report."""
    out = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
    turns, least, last_turn, last = 0, None, None, None
    for _, first_turn, to_turn, n, first, to, *counts in pieces:
        for name, count in zip(("blank", "duplicate", "truncated", "illegal"), counts):
            out[name] += count
        out["illegal"] += last is not None and last + first not in ("su", "ua", "au")
        turns += n - (n > 0 and first_turn == last_turn)
        least = first_turn if least is None else least
        last_turn, last = to_turn if n else last_turn, to
    if turns:
        out["gaps"] = last_turn - least + 1 - turns
    out["cost"], out["audit"] = grammar.cheapest([p[0] for p in pieces])
    return out


def repaired(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             among: DataFrame | None = None) -> DataFrame:
    """(conv_id, nth, edit, turn, role, text, report): a row for each edit, in order, then one with the conversation's report.

    Deleted rows are there with their own role and text. Within a partition a conversation's rows follow each other in order.
    """
    rows = _features(df, conv_id, turn, role, text)
    pieces = cut(_pieces(rows))
    rules = re_pair(cut(pieces.groupBy("symbols").agg(F.count("*").alias("n"))))
    columns = ["kind", *pieces.columns, "later", "turn", "role", "digest", "text"]
    asked = (df if among is None else among).select(F.col(conv_id).alias("conv")).distinct().withColumn("kind", F.lit(0))
    both = (asked.unionByName(pieces.withColumn("kind", F.lit(1)), allowMissingColumns=True)
            .unionByName(rows.withColumn("kind", F.lit(2)), allowMissingColumns=True).select(*columns))
    schema = T.StructType([T.StructField(conv_id, rows.schema["conv"].dataType),
                           *T.StructType.fromDDL(f"nth long, edit string, turn long, role string, text string, report struct<{REPORT}>")])
    arrow = to_arrow_schema(schema)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, out, held = Grammar(rules), [], 0
        conv, started, packed, report, audit, state, nth = None, False, [], None, iter(""), BEGIN, 0

        def inserted_until_row():
            """Emits the insertions before the next row and gives the row's letter."""
            nonlocal state, nth
            for letter in audit:
                if letter != "I":
                    return letter
                state = ASSISTANT if state == USER else USER
                out.append((conv, nth, "I", None, ROLES[state], "", None))
                nth += 1
            return None

        def finish():
            nonlocal nth, report
            if started:
                report = report or _report(packed, grammar)
                inserted_until_row()
                out.append((conv, nth, None, None, None, None, report))

        for batch in batches:
            names = ["conv", "kind", "turn", "role", "text", "symbols", "first_turn", "last_turn", "turns", "first", "last", "blank", "duplicate",
                     "truncated", "illegal"]
            for own, kind, at, of, said, *piece in zip(*(batch.column(c).to_pylist() for c in names)):
                if not started or own != conv:
                    finish()
                    conv, started, packed, report, audit, state, nth = own, True, [], None, iter(""), BEGIN, 0
                if kind == 1:
                    packed.append(tuple(piece))
                elif kind == 2:
                    if report is None:
                        report = _report(packed, grammar)
                        audit = iter(report["audit"])
                    letter = inserted_until_row()
                    if letter == "R":
                        state = ASSISTANT if state == USER else USER
                        of = ROLES[state]
                    elif letter == "K":
                        state = NEXT[state, of[0]]
                    out.append((conv, nth, letter, at, of, said, None))
                    nth, held = nth + 1, held + len(said)
                if len(out) > 5000 or held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out.clear()
                    held = 0
        finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    order = ["conv", "kind", "part", "nth", "later", "turn", "role", "digest"]
    return both.repartition("conv").sortWithinPartitions(*order).mapInArrow(edit, schema)


def reports(edited: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, report's columns, repaired_sha256) of ``repaired``'s rows, straight from it: they are digested as they stream past."""
    schema = T.StructType([edited.schema[conv_id], *T.StructType.fromDDL(REPORT), *T.StructType.fromDDL("repaired_sha256 string")])
    arrow = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, any_yet = hashlib.sha256(), False
        for batch in batches:
            done = []
            for conv, letter, role, text, report in zip(*(batch.column(c).to_pylist() for c in (conv_id, "edit", "role", "text", "report"))):
                if letter is None:
                    done.append((conv, *report.values(), sha.hexdigest()))
                    sha, any_yet = hashlib.sha256(), False
                elif letter != "D":
                    sha.update(f"{chr(10) * any_yet}{role}:{text}".encode())
                    any_yet = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    return edited.mapInArrow(digest, schema)
