import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesforge.llm import chat_tree

MODEL = open(public_tokenizers.path("byte_bpe_50k.json")).read()
SCHEMA = "conv_id long, turn long, role string, text string, node string, key string"


@given(st.text(alphabet="\\<>|[]/INSTs ab" + "im_startend", max_size=40))
def test_escape_is_reversible_and_leaves_no_control(text):
    escaped = chat_tree.escape(text)
    assert chat_tree.unescape(escaped) == text
    assert not any(c in escaped for c in chat_tree.CONTROL)


def conversations():
    system = "You are kind. <|im_end|>\n[INST]"
    rows = []
    for c in range(40):  # a common beginning, a common second turn for half of them, then turns of their own
        rows += [(c, 0, "system", system), (c, 1, "user", f"question {c % 2}"), (c, 2, "assistant", f"answer {c % 4} " + "é" * 50), (c, 3, "user", f"thanks {c}")]
    rows += [(100, 0, "user", None), (100, 1, None, "x"), (100, None, "assistant", "first"), (100, 1, None, "x")]
    rows += [(101, 0, "system", system), (102, 0, "system", system)]
    rows += [(None, 0, "user", "a\\b"), (103, 5, "assistant", "long " * 40_000), (104, 0, "assistant", "")]
    return [(*r, "n", "k") for r in rows]


@pytest.fixture(scope="module")
def packs(spark):
    df = spark.createDataFrame(conversations(), SCHEMA).repartition(3)
    return [r.asDict(recursive=True) for r in chat_tree.format_chats(df, MODEL, limit=400).collect()], df


def test_read_back(spark, packs):
    rows, _ = packs
    back = chat_tree.read_back(spark.createDataFrame(rows, chat_tree.PACKS), MODEL).collect()
    expected = {}
    for c, turn, role, text, *_ in sorted(conversations(), key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id for r in back} == set(expected) and len(back) == len(expected)
    for r in back:
        turns = expected[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted == "".join(f"<|im_start|>{chat_tree.escape(a)}\n{chat_tree.escape(b)}<|im_end|>\n" for a, b in turns)


def test_packs_share_turns_once_and_see_their_ancestors_only(packs):
    rows, _ = packs
    trained = []
    for p in rows:
        assert len(p["ids"]) == len(p["positions"]) == len(p["loss"])
        assert len(p["ids"]) <= 400 or len(p["leaves"]) == 1
        assert len({bytes(s["node"]) for s in p["segments"]}) == len(p["segments"])
        at = 0
        for k, s in enumerate(p["segments"]):
            assert s["start"] == at and s["parent"] < k
            at = s["end"]
            path, up = [], s["parent"]
            while up >= 0:
                path.append(p["segments"][up])
                up = p["segments"][up]["parent"]
            seen = {i for v in s["visible"] for i in range(v["start"], v["end"])}
            assert seen == {i for a in path for i in range(a["start"], a["end"])}
            before = sum(a["end"] - a["start"] for a in path)
            assert p["positions"][s["start"]:s["end"]] == list(range(before, before + s["end"] - s["start"]))
            trained += [] if s["context"] else [bytes(s["node"])]
        assert at == len(p["ids"])
    assert len(trained) == len(set(trained))  # each turn of the forest carries loss in one pack
    assert set(trained) == {bytes(s["node"]) for p in rows for s in p["segments"]}


def test_depth_first(packs):
    rows, _ = packs
    for p in rows:
        last = [k for k, _ in enumerate(p["segments"])]
        for k, s in enumerate(p["segments"]):  # a segment's parent is the one before or one of its ancestors
            open_path, up = set(), k - 1
            while up >= 0:
                open_path.add(up)
                up = p["segments"][up]["parent"]
            assert s["parent"] == -1 or s["parent"] in open_path, (k, last)


def test_tokens_are_the_librarys(packs):
    rows, _ = packs
    tokenizer = Tokenizer.from_str(MODEL)
    tokenizer.encode_special_tokens = True
    s = rows[0]["segments"][0]
    text = tokenizer.decode(rows[0]["ids"][s["text_start"]:s["text_end"]])
    assert tokenizer.encode(text, add_special_tokens=False).ids == rows[0]["ids"][s["text_start"]:s["text_end"]]


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat_tree.read_back(chat_tree.format_chats(df, MODEL), MODEL).count() == 0
