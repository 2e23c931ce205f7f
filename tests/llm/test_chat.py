import hashlib

import pytest

from bitloom.llm.chat import PROBE, Reader, Template, format_chat, read_back

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "a \\ b ### c"), (1, 2, "assistant", PROBE),
    (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 5, "user", ""), (3, 5, "user", ""), (3, 7, "a:b\nc\\", "</turn>\n### User: no"),
    (4, None, None, "x" * 100_000 + "<"), (None, 0, "user", "who"), (None, 1, "assistant", "\\"),
]
SHAPE = "conv_id long, turn long, role string, text string, valid int"


def test_round_trip(spark):
    rows = [(*r, 0) for r in ROWS]
    got = {r["conv_id"]: r for r in read_back(format_chat(spark.createDataFrame(rows, SHAPE))).collect()}
    for conv in {r[0] for r in ROWS}:
        turns = [(r[2] or "", r[3] or "") for r in ROWS if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True}


def test_empty_table(spark):
    assert read_back(format_chat(spark.createDataFrame([], SHAPE))).collect() == []


def test_reader_takes_pieces():
    t = Template()
    text = "".join(t.head(r) + t.escape(x) + t.end for r, x in [("user", "a<"), ("assistant", PROBE + "\\")])
    reader, got = Reader(t), []
    for c in text:
        got += reader.feed(c)
    assert got == [("user", "a<"), ("assistant", PROBE + "\\")]


def test_ids_of_other_types(spark):
    rows = [("b", 0, "user", "hi"), ("b", 1, "assistant", "ho"), ("a 1", 0, "user", "who")]
    got = {r["conv_id"]: r["n_turns"] for r in read_back(format_chat(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))).collect()}
    assert got == {"b": 2, "a 1": 1}


def test_segments_out_of_order_are_an_error(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho")]
    made = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    with pytest.raises(Exception, match="out of order"):
        read_back(made.coalesce(1).sortWithinPartitions("part", "turn")).collect()
