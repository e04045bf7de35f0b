import hashlib

import pytest
from support import SF, same
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import chat_format as c

PIECES = st.lists(st.sampled_from([*c.CONTROLS, "\\", "<", "|", "[", "\n", "a", "é", "probe", ">"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_turns_survive_formatting(turns):
    text = c.tagged(turns)
    assert c.parse(text) == turns
    found = c.Spans(turns, c.tagged)
    assert found.text == text and not found.rewrites
    assert "".join(text[s:e] for s, e, _, _ in found.spans) == text
    for (_, said), (_, _, a, b) in zip(turns, found.spans, strict=True):
        assert c.unescape(text[a:b]) == said


def test_controls_do_not_survive_in_a_text():
    for control in c.CONTROLS:
        assert control not in c.escape(f"a{control}b{control}")


def test_a_template_that_rewrites_history_is_noticed():
    def last_only(turns):
        return "".join(f"({text})" if k == len(turns) - 1 else "(..)" for k, (_, text) in enumerate(turns))

    found = c.Spans([("u", "one"), ("a", "two"), ("u", "three")], last_only)
    assert found.rewrites == 2
    assert found.text == "(..)(..)(three)"
    assert c.Spans([("u", "x")], lambda t: "".join(text.upper() for _, text in t)).spans == [(0, 1, -1, -1)]  # the text can't be found


def test_query_gives_the_rows_of_its_sql(spark, duck):
    same(c.op1_chat_format(spark, SF), duck, c.OP1_SQL)


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", None, "z"), (1, 0, None, "hi", "z"), (None, None, "assistant", "x", "z"), (2, 0, "assistant", "same", "z"), (2, 0, "assistant", "same", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in c.digests(c.format_conversations(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"]) == (2, sha("\nhi\nassistant\n\n"), 0)
    assert (got[2]["n_turns"], got[2]["loss_sha256"]) == (2, sha("samesame"))
    assert got[None]["loss_chars"] == 1
    assert c.digests(c.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "no turn", c._START + "a"])
def test_what_no_template_wrote_is_an_error_or_empty(text):
    if not text:
        assert c.parse(text) == []
    else:
        with pytest.raises(ValueError):
            c.parse(text)
