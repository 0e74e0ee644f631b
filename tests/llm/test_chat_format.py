"""Formatting: any turns come back from the parser, and the digests are those of the sources."""

import hashlib
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat_format
from millrace.llm.chat_format import parse, render_turn

QUOTING = "\\### Assistant: </turn> ok"
PARTS = st.lists(st.sampled_from(["\\", "### ", "Assistant", ": ", "</turn>", "\n", "### User: ", "role=x", "### role=: ", "<", "a é"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), st.text(max_size=5)), st.one_of(PARTS, st.text(max_size=20))), max_size=5))
def test_any_turns_come_back(turns):
    assert parse("".join(render_turn(r, t) for r, t in turns)) == turns


def test_only_conflicts_are_escaped():
    assert render_turn("user", "a \\ b ### c") == "### User: a \\ b ### c</turn>\n"
    assert render_turn("user", QUOTING) == "### User: \\\\\\### Assistant: \\</turn> ok</turn>\n"
    assert parse("### User: a") is None and parse("x") is None and parse("### User: a ### User: b</turn>\n") is None


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, 1, "assistant", "B", 9), (1, 0, "user", None, 9), (2, 0, None, QUOTING, 9), (2, None, "assistant", "x" * 200000, 9), (None, 0, "assistant", "n", 9), (None, 0, "assistant", "n", 9), (None, 1, "user", "m", 9), (3, 0, "user", "r", 9), (3, 0, "user", "r", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int").repartition(3)
    every = chat_format.read_back(chat_format.format_turns(df)).collect()
    assert sorted(r["n_turns"] for r in every if r["conv_id"] is None) == [1, 1, 1]
    got = {r["conv_id"]: r.asDict() for r in every if r["conv_id"] is not None}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert set(got) == {1, 2, 3}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(render_turn(*t)) for t in turns)
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def test_spans_cover_the_learned_bodies(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), QUOTING * rng.randint(0, 2)) for c in range(5) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_format.format_turns(df).collect()
    whole = {}
    for r in found:
        assert r["start"] == len(whole.setdefault(r["conv"], ""))
        whole[r["conv"]] += r["rendered"]
    for c, text in whole.items():
        assert parse(text) == [(r, t) for k, _, r, t in rows if k == c]
    for r in found:
        if r["loss_start"] is not None:
            body = whole[r["conv"]][r["loss_start"] : r["loss_start"] + r["loss_chars"]]
            assert body in (QUOTING, "") or chat_format.escape(QUOTING) in body


def test_long_runs_of_backslashes_take_linear_time():
    text = "\\" * 1_000_000
    began = time.perf_counter()
    assert parse(render_turn("user", text)) == [("user", text)]
    assert parse(render_turn("user", f"{text}</turn>{text}")) == [("user", f"{text}</turn>{text}")]
    assert time.perf_counter() - began < 10
