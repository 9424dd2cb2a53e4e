"""Formatting: exact round trip, spans, and templates that rewrite history."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from duewatch.llm.chat import CONTROL, digests, escape, formatted, located, marked, read_back, unescape

PIECE = st.one_of(st.sampled_from([*CONTROL, "\\", "]", "[", "<", "/", " ", "\n", "a", "é", "s>", "INST]"]), st.characters(codec="utf-8"))
TEXT = st.lists(PIECE, max_size=12).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=5))
def test_round_trip(turns):
    whole, rewritten, spans = located(marked, turns, ("assistant",))
    assert read_back(whole) == turns and not rewritten
    for (role, text), span in zip(turns, spans, strict=True):
        assert unescape(whole[span["text_begin"] : span["text_stop"]]) == text and span["role"] == role
    assert [s["begin"] for s in spans[1:]] == [s["stop"] for s in spans[:-1]]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escape(text):
    assert unescape(escape(text)) == text
    assert not any(mark in escape(text) for mark in CONTROL)


def test_template_that_rewrites_history():
    def last_only(turns):
        return "".join(f"[{role}]{text}" if k == len(turns) - 1 else f"({text})" for k, (role, text) in enumerate(turns))

    whole, rewritten, spans = located(last_only, [("user", "hi"), ("assistant", "yes")], ("assistant",))
    assert rewritten and whole == "(hi)[assistant]yes"
    assert whole[spans[1]["text_begin"] : spans[1]["text_stop"]] == "yes"


def test_template_that_drops_or_changes_texts():
    upper = lambda turns: "".join(f"<{text.upper()}>" for _, text in turns)
    _, _, spans = located(upper, [("assistant", "abc")], ("assistant",))
    assert spans[0]["text_begin"] == spans[0]["text_stop"]


def test_rows(spark):
    rows = [(2, 1, "assistant", "</s>"), (2, 0, "user", None), (1, 0, None, "x"), (None, 0, "user", "n"), (1, 0, "assistant", "a\\"),
            (3, 0, "assistant", "q" * 100_000), (3, 1, "assistant", "q"), (3, 1, "assistant", "q")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, spans int")
    found = {r.conv_id: r for r in digests(df.repartition(4)).collect()}
    assert set(found) == {1, 2, 3, None}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found[2].turns_sha256 == sha("user\n\nassistant\n</s>\n") and found[2].loss_sha256 == sha("</s>")
    assert found[1].turns_sha256 == sha("\nx\nassistant\na\\\n")
    assert found[3].n_turns == 3 and found[3].loss_chars == 100_002
    assert formatted(df.limit(0)).collect() == []
