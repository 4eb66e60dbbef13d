import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fabula.llm import chat

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string, head string"


def test_fold_of_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi", ""), (1, 2, "delta", 1, "assistant", "Hel", ""), (1, 3, "delta", 1, None, "lo", ""), (1, 4, "edit", 0, "user", "hi there", ""),
        (1, 5, "message", 2, "user", "more", ""), (1, 6, "regenerate", 1, "assistant", "Again", ""), (1, 7, "delta", 1, None, "!", ""), (1, 8, "message", 2, "user", "ok", ""),
        (None, 1, "message", 0, None, None, ""),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {(1, 0): ("user", "hi there"), (1, 1): ("assistant", "Again!"), (1, 2): ("user", "ok"), (None, 0): (None, "")}


TEXT = st.lists(st.sampled_from(["<", "|", "\\", "im_start", "im_end", "|>", "\n", "n", "é", "😀", " "]), max_size=12).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "<n\\"]), TEXT), min_size=1, max_size=20))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = chat.render(df).select("formatted", chat.parse(chat.F.col("formatted")).alias("turns"), chat.masked_text(chat.F.col("formatted"), chat.F.col("loss_mask")).alias("loss")).first()
    assert [(t.role, t.text) for t in row.turns] == turns
    assert row.loss == "".join(t for r, t in turns if r == "assistant")
    assert row.formatted.count(chat.START) == row.formatted.count(chat.STOP) == len(turns)


def test_digest(spark):
    rows = [(5, 1, "assistant", None), (5, 0, None, "q"), (5, 1, "assistant", "a<|b"), (5, 1, "assistant", "a<|b"), (None, None, "user", "x")]
    got = {r.conv_id: r for r in chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {-1, 5, None}
    assert got[5].n_turns == 4 and got[5].loss_chars == 8
    assert got[5].turns_sha256 == hashlib.sha256(b"\nq\nassistant\n\nassistant\na<|b\nassistant\na<|b\n").hexdigest()
    empty = chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [r.conv_id for r in empty] == [-1]
