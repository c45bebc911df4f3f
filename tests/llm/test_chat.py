from hypothesis import given, settings
from hypothesis import strategies as st

from splitfold.llm import chat

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"
PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/", "[", "\n", "s>", "é", "x", "n"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), PIECES), max_size=4))
def test_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_folding(spark):
    rows = [
        (1, 0, "message", 10, "user", "hi"), (1, 1, "message", 11, "assistant", ""), (1, 2, "delta", 11, None, "he"), (1, 3, "delta", 11, None, "llo"),
        (1, 4, "edit", 10, None, "hi!"), (1, 5, "regenerate", 11, None, None), (1, 7, "delta", 11, None, "y"), (1, 6, "delta", 11, None, "b"),
        (1, 8, "message", 12, "user", "gone"), (1, 9, "delete", 12, None, None), (None, 1, "message", 1, None, None), (2, None, "message", 1, "user", "a"), (2, None, "message", 2, "user", "a"),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(df).collect()}
    assert got == {1: [("user", "hi!"), ("assistant", "by")], None: [("", "")], 2: [("user", "a"), ("user", "a")]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_repeated_rows_of_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 1), (1, 0, "user", "a", 2), (1, 1, "assistant", None, 3)], "conv_id long, turn long, role string, text string, seq long")
    r = chat.read_back(chat.format_conversations(chat.as_events(rows))).first()
    assert (r.n_turns, r.loss_chars) == (3, 0)
