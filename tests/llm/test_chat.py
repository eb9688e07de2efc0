"""Formatted conversations, read back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from framewright.llm import chat, queries

PIECES = ["\\", "### ", "</turn>", "\n", "### Assistant: ", "</turn>\n", ": ", "~", "b", "o", "c", "t", "\\b", "\\c", "é日", "", " ", "###", "</tu", "rn>", "$1", "\\\\"]
SCHEMA = "conv_id long, turn long, role string, text string, segments string, place int, loss int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "User", "~user", "x: y", "a\\tb", "### ", ""])
            rows.append((c, t, role, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))))
    rng.shuffle(rows)
    return rows


def conversations(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_every_text_is_read_back(spark, odd):
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(frame(spark, odd))).collect()}
    want = conversations(odd)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].learnt == "".join(text for role, text in turns if role == "assistant")


def test_digests_as_plain_python_has_them(spark, odd):
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.formatted(frame(spark, odd)))).collect()}
    for c, turns in conversations(odd).items():
        spelt = "".join(f"{role}\n{text}\n" for role, text in turns)
        learnt = "".join(text for role, text in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(spelt.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_segments_join_to_the_text(spark, odd):
    whole = {r.conv_id: r for r in chat.formatted(frame(spark, odd)).collect()}
    parts = {}
    for r in chat.segments(frame(spark, odd)).orderBy("conv_id", "segment").collect():
        parts.setdefault(r.conv_id, []).append(r)
    for c, r in whole.items():
        assert "".join(p.text for p in parts[c]) == r.formatted
        assert [(p.text, p.loss) for p in parts[c]] == [tuple(s) for s in r.segments]
        assert [p.segment for p in parts[c]] == list(range(len(parts[c])))
        assert all(p.loss == (p.role == "assistant" and p.segment % 3 == 1) for p in parts[c])


def test_order_of_roles(spark):
    def turns(c, *roles):
        return [(c, i, r, "t") for i, r in enumerate(roles)]
    rows = turns(1, "system", "user", "assistant") + turns(2, "user", "user", "assistant") + turns(3, "user", "assistant", "user")
    rows += turns(4, "user", "assistant", "tool", "tool", "assistant") + turns(5, "assistant") + turns(6, "user", "robot", "assistant")
    valid = {r.conv_id: r.valid for r in chat.formatted(frame(spark, rows)).collect()}
    assert valid == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    out = chat.segments(frame(spark, rows)).where(~F.col("in_order")).select("conv_id", "turn").distinct().collect()
    assert {tuple(r) for r in out} == {(2, 1), (5, 0), (6, 1), (6, 2)}


def test_a_template_of_ones_own(spark):
    own = chat.ChatTemplate(
        opening="<|", title_end="|>", closing="<|end|>", titles={"human": "H", "bot": "B"}, other="?", learnt=("bot", "human"),
        follows={chat.START: ("human",), "human": ("bot",), "bot": ("human",)}, last=("bot",),
        codes=(("^", "^e"), ("<|", "^l"), ("|>", "^r")), name_code="^n")
    rows = [(1, 0, "human", "say <|end|> ^l |>"), (1, 1, "bot", "<|B|>^e"), (1, 2, "o|>o", "")]
    r = chat.read_back(chat.formatted(frame(spark, rows), own), own).first()
    assert [tuple(t) for t in r.turns] == [(b, c) for _, _, b, c in rows] and r.learnt == rows[0][3] + rows[1][3]
    for wrong in ({"codes": (("\\", "\\b"), ("### ", "\\b"))}, {"closing": "end"}, {"titles": {"user": "U: "}}, {"titles": {"user": "~U"}}):
        with pytest.raises(ValueError):
            chat.ChatTemplate(**wrong)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, None), (None, 0, "user", "x"),
            (2, 0, "user", "</turn>" * 40_000), (None, 1, "assistant", None)]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.formatted(frame(spark, rows))).collect()}
    assert got == conversations(rows)
    assert got[1] == [("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    none = frame(spark, rows).where("1 = 0")
    assert chat.digests(chat.read_back(chat.formatted(none))).count() == chat.segments(none).count() == 0


def test_query_adds_the_planted_conversation_and_runs_no_python(spark, sf):
    df = queries.QUERIES["op11_chat_format"](spark, sf)
    r = df.where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") <= 2
