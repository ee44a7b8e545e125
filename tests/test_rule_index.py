"""Rule tables against every pattern on every name."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesforge.operators import rule_index
from seriesforge.operators.rule_index import literals_of

PIECES = ["ab", "abcd", "(xyB)", "A", "b+", "c?", "d*", ".", ".*", "[ab]c", "[^a]b", "(ab)", "(a|b)c", "(?=ab)", "(?:cd)?", "^a", "b$", r"\.", r"\d", r"a\+b", "ab{2}", "x{0,1}y",
          " : ", "(a(b)c)*d", "]", "ü"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=5), st.text(alphabet="abcdxy.+ :1]Bü", max_size=12))
def test_every_match_contains_the_literal(pieces, text):
    pattern = "".join(pieces)
    if re.search(pattern, text, re.I):
        assert all(run in text.lower() for run in literals_of(pattern))


@pytest.mark.parametrize("pattern, literals", [
    ("(?=Order Revenue).*(All Segments, Monthly)$", ["all segments, monthly", "order revenue"]), ("^Order value : .*monthly$", ["monthly", "order value : "]),
    ("coal|gas", []), (None, []), ("Cost?", ["cos"]), (r"\QCost\E", []), ("(?=Order Revenue)(gas)?", ["order revenue"]), ("(?!never)x(a(bcd)+)", ["bcd"]),
    ("(abc|abd)efg", ["efg"]), ("[^]a]bcd", ["bcd"]), ("abcd{2}ef", ["abc"]), ("(?i)wind", ["wind"]), (r"\(12\) : x", ["(12) : x"])])
def test_literals(pattern, literals):
    assert literals_of(pattern) == literals


@pytest.mark.parametrize("block, hot", [(200, 1_000_000), (2, 3)])
def test_against_all_pairs(spark, monkeypatch, block, hot):
    monkeypatch.setattr(rule_index, "BLOCK", block)
    rnd = random.Random(1)
    words = ["coal", "natural gas", "Net generation", "wind", "Retail sales", "(all)", "a.b", "ü"]
    names = [(i, None if i % 40 == 9 else " : ".join(rnd.sample(words, 3)) + rnd.choice(["", " monthly", " Monthly"]), rnd.choice(["MWh", "dollars", None]), 1)
             for i in range(150)]
    patterns = ["coal", "Net.*wind", "monthly$", "^retail sales", "wind|coal", ".", r"a\.b", r"\(all\)", "natural (gas|oil)", "nowhere to be found", None, "c?oal", "(?i)WIND", "[cw]"]
    rules = [(i, f"rule {i % 7}", rnd.choice(patterns), rnd.choice(["mwh", "dol|mw", ".", "LARS$", None])) for i in range(90)]
    dim = spark.createDataFrame(names, "id int, name string, units string, literal int")
    table = spark.createDataFrame(rules, "rule_id int, title string, name_pattern string, unit_pattern string")
    got = sorted((r.rule_id, r.id, r.title, r.literal) for r in rule_index.match_rule_table(dim, table, hot_rows=hot).collect())
    expected = sorted((k, i, t, 1) for k, t, p, u in rules for i, n, unit, _ in names
                      if None not in (p, u, n, unit) and re.search(p, n, re.I) and re.search(u, unit, re.I))
    assert got == expected and got


def test_nothing(spark):
    dim = spark.createDataFrame([], "id int, name string, units string")
    rules = spark.createDataFrame([], "rule_id int, title string, name_pattern string, unit_pattern string")
    assert rule_index.match_rule_table(dim, rules).count() == 0


def test_grams_are_not_broadcast(spark, tmp_path):
    """A table of grams is many times its names; Spark takes it for as small as their file."""
    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    dim = spark.createDataFrame([(1, "natural gas", "MWh")], "id int, name string, units string")
    rules = spark.createDataFrame([(1, "gas", "gas", ".")], "rule_id int, title string, name_pattern string, unit_pattern string")
    plan = rule_index.match_rule_table(stored(dim, "dim"), stored(rules, "rules"))._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    seen = 0
    for at, line in enumerate(plan):
        if "BroadcastHashJoin" not in line and "BroadcastNestedLoop" not in line:
            continue
        seen += 1
        assert "BuildRight" in line
        end = next((i for i in range(at + 1, len(plan)) if depth[i] <= depth[at]), len(plan))
        built = [i for i in range(at + 1, end) if depth[i] == depth[at] + 3][-1]
        own = next(i for i in range(built, end) if not any(x in plan[i] for x in ("Project", "Filter")))
        assert "Aggregate" in plan[own], plan[built:end]  # of grams counted, not the grams
    assert seen  # the few hot grams still are


def test_repeated_rows_rules_and_hot_names(spark):
    dim = spark.createDataFrame([(i, "natural gas", "MWh") for i in (1, 1, 2)] + [(3, "Natural Gas", "MWh"), (4, "coal", None)], "id int, name string, units string")
    rules = spark.createDataFrame([(7, "gas", "gas$", ".")] * 2, "rule_id int, title string, name_pattern string, unit_pattern string")
    got = sorted((r.rule_id, r.id) for r in rule_index.match_rule_table(dim, rules, hot_rows=2).collect())
    assert got == sorted([(7, 1), (7, 1), (7, 2), (7, 3)] * 2)


def test_patterns_under_one_rule(spark):
    """Each has a key of its own, whether or not a name has the other's."""
    dim = spark.createDataFrame([(1, "natural gas", "MWh"), (2, "hard coal", "MWh"), (3, "wind", "MWh")], "id int, name string, units string")
    rules = spark.createDataFrame([(7, "a", "gas$", "."), (7, "a", "coal", "."), (7, "a", "solar", "."), (8, "b", "w?i|w", ".")],
                                  "rule_id int, title string, name_pattern string, unit_pattern string")
    assert sorted((r.rule_id, r.id) for r in rule_index.match_rule_table(dim, rules).collect()) == [(7, 1), (7, 2), (8, 3)]


def test_grams_are_not_shuffled(spark, monkeypatch):
    """A row meets the rules by the few keys that its name contains, not by each of its grams, and so does a rule by its key alone."""
    sent, join = [], rule_index.join_keys

    def joined(few, many, *rest, **named):
        sent.append((few.count(), many.count()))
        return join(few, many, *rest, **named)

    monkeypatch.setattr(rule_index, "join_keys", joined)
    dim = spark.createDataFrame([(i, f"Net generation : plant {i:05d} : all fuels : monthly", "MWh") for i in range(500)], "id int, name string, units string")
    rules = spark.createDataFrame([(i, "r", f"plant {i:05d} : .*monthly$", "mwh") for i in range(500)] + [(i, "no", f"{i:05d} : nowhere", "mwh") for i in range(500, 600)],
                                  "rule_id int, title string, name_pattern string, unit_pattern string")
    assert sorted((r.rule_id, r.id) for r in rule_index.match_rule_table(dim, rules).collect()) == [(i, i) for i in range(500)]
    assert sent and all(few <= 600 and many <= 1500 for few, many in sent)


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_keys_are_found_in_names(monkeypatch, piece):
    """Whatever a text's place among others: grams of a literal are grams of each text that contains it, and none reaches into the next text."""
    monkeypatch.setattr(rule_index, "PIECE", piece)
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abü ", k=rnd.randrange(30))).encode() for _ in range(200)] + [b"", b"abc"]
    own = [set() for _ in texts]
    for a, b in rule_index._pieces([len(t) for t in texts]):
        for k, at, row, hashes in rule_index._grams(texts[a:b]):
            joined = b"".join(texts[a:b])
            for place, i, h in zip(at.tolist(), row.tolist(), hashes.tolist()):
                own[a + i].add((joined[place:place + rule_index.GRAMS[k]], h))
    names = {}
    for text, grams in zip(texts, own):
        assert {g for g, _ in grams} == {text[i:i + n] for n in rule_index.GRAMS for i in range(len(text) - n + 1)}
        for gram, h in grams:
            assert names.setdefault(gram, h) == h
    assert len(set(names.values())) == len(names)
