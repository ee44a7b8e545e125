"""Repairs against brute force: all sequences of edits of short conversations, a plain recursion for longer ones."""

import functools
import hashlib
import random
import re
import sys

import pytest

from seriesforge.llm import conversation_repair
from seriesforge.llm.conversation_repair import Grammar, encoded


def faults(rows):
    """(role, text, fault) of rows in order."""
    out, seen = [], set()
    for role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_repair(rows):
    """(cost, audit, result) of all repairs with at most two insertions at a place."""
    found = []

    def walk(k, cost, audit, result):
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in result)):
            found.append((cost, audit, result)) if k == len(rows) else None
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                walk(k, cost + 2, audit + "I", [*result, (role, "")])
        if k == len(rows):
            return
        role, text, fault = rows[k]
        walk(k + 1, cost + 3, audit + "D", result)
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            walk(k + 1, cost + more, audit + "K", [*result, (role, text)])
            for new in ("user", "assistant"):
                walk(k + 1, cost + 2 + more, audit + "R", [*result, (new, text)])

    walk(0, 0, "", [])
    return min(found, key=lambda f: (f[0], f[1]))


def slow_repair(rows):
    """Cost, audit and result by recursion over rows and the initials so far, without grammar or matrices."""
    @functools.cache
    def best(k, last, insertions):
        ways = [(0, "", ())] if k == len(rows) and last in ("", "a") else []
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[follow]
        if insertions < 2:
            c, a, r = best(k, follow, insertions + 1)
            ways.append((c + 2, "I" + a, ((name, ""), *r)))
        if k < len(rows):
            role, text, fault = rows[k]
            c, a, r = best(k + 1, last, 0)
            ways.append((c + 3, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] == follow or role[:1] == "s" and last == "":
                    c, a, r = best(k + 1, role[:1], 0)
                    ways.append((c + more, "K" + a, ((role, text), *r)))
                c, a, r = best(k + 1, follow, 0)
                ways.append((c + 2 + more, "R" + a, ((name, text), *r)))
        return min(ways, key=lambda w: w[:2]) if ways else (10 ** 9, "", ())

    return best(0, "", 0)


sys.setrecursionlimit(20_000)


def report(rows):
    """rows (turn, role, text) of a conversation."""
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (
        r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    found = faults([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, result = slow_repair(tuple(found)) if rows else (0, "", ())
    counts = [sum(f == name for *_, f in found) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, cost, audit), list(result)


TEXTS = ["Fine.", "Cut", "", " \t\n", "Really?  ", "No!", "ü é.", None, "Cut "]


def chats(seed, n, most):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for _ in range(rnd.randint(0, most)):
            rows.append((c, rnd.choice([None, *range(most)]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(TEXTS)))
    return rows


def test_recursion_against_all_sequences():
    rnd = random.Random(3)
    for _ in range(150):
        rows = faults([(rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["A.", "B", "C!", ""])) for _ in range(rnd.randint(0, 3))])
        assert tuple(map(repr, slow_repair(tuple(rows)))) == tuple(map(repr, (lambda c, a, r: (c, a, tuple(r)))(*every_repair(rows))))


def test_rules_change_nothing():
    rnd = random.Random(5)
    a, b, c, d, e = map(chr, range(0xE000, 0xE005))
    rules = [(a, "ua"), (b, a + a), (c, "xU"), (d, b + a), (e, "oo")]
    with_rules, without = Grammar(rules), Grammar([])
    for _ in range(300):
        symbols = "".join(rnd.choice(["ua", "ua", *"xsuaoSUAO"]) for _ in range(rnd.randint(1, 40)))
        at = rnd.randint(0, len(symbols))
        assert len(encoded(symbols, rules)) <= len(symbols)
        assert with_rules.cheapest([symbols]) == without.cheapest([symbols]) == with_rules.cheapest([p for p in (symbols[:at], symbols[at:]) if p])


@pytest.mark.parametrize("piece", [1024, 3])
def test_repaired(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    rows = chats(1, 150, 9) + [(500, t, "user" if t % 3 else "assistant", f"turn {t % 70}" + "." * (t % 2)) for t in range(400)]
    rows += [(None, 0, "user", "Without a name."), (None, 1, "assistant", "w" * 300_000), (None, 1, "assistant", "w" * 300_000)]
    df = spark.createDataFrame([(*r, "n", "k") for r in rows], "conv_id long, turn long, role string, text string, symbols string, part string").repartition(3)
    among = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {-7}], "conv_id long")
    edited = conversation_repair.repaired(df, among=among)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.reports(edited).collect()}
    told = {}
    for r in sorted(edited.collect(), key=lambda r: r.nth):
        if r.edit not in (None, "D"):
            told.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == {r[0] for r in rows} | {-7}
    for c in got:
        expected, result = report([r[1:] for r in rows if r[0] == c])
        assert told.get(c, []) == result
        assert got[c] == (*expected, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in result).encode()).hexdigest())


def test_pairs_are_counted_over_all_pieces(spark):
    pieces = spark.createDataFrame([("uaua", 5), ("uaxx", 1), ("sx", 1)], "symbols string, n long")
    rules = conversation_repair.re_pair(pieces)
    assert [pair for _, pair in rules] == ["ua", chr(0xE000) * 2]


def test_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.reports(conversation_repair.repaired(df)).count() == 0
