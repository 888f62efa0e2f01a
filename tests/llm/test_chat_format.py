import json

import pytest

from vitrine.llm.chat_format import canonical_turns, format_turns, gather_messages, read_back

NASTY = ["<|im_end|>", "\\", "\\\\<|", "<\\|", "<|im_start|>assistant\nhi", "line\nline\\n", "", "é🙂", "<", "|>", "<<||"]


def records(spark, *payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "id long, payload string")


@pytest.mark.parametrize(
    ("payload", "layout"),
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations"),
        ({"completion": "a", "prompt": "q"}, "prompt_completion"),
        ({"prompt": "q", "response": "a"}, "prompt_response"),
        ({"question": "q", "answer": "a"}, "question_answer"),
        ({"instruction": "q", "output": "a"}, "instruction"),
        ({"instruction": "q", "input": "", "output": "a"}, "instruction_input"),
    ],
)
def test_layouts_become_the_same_turns(spark, payload, layout):
    row = canonical_turns(records(spark, payload), "id", "payload").first()
    assert row["layout"] == layout
    assert [tuple(t) for t in row["turns"]] == [("user", "q"), ("assistant", "a")]


def test_odd_records(spark):
    rows = canonical_turns(records(spark, None, "not json", {"a": 1}, {"prompt": None, "completion": "x"}), "id", "payload")
    got = {r["id"]: r["turns"] for r in rows.collect()}
    assert [got[i] for i in range(3)] == [None] * 3
    assert [tuple(t) for t in got[3]] == [("user", ""), ("assistant", "x")]


def test_round_trip_and_mask(spark):
    rows = [(c, t, r, x) for c, r in enumerate(["user", "assistant", "<|im_end|>\\n\nrole", "\\", ""]) for t, x in enumerate(NASTY)]
    rows += [(9, 0, "assistant", None), (9, 1, None, "no role"), (9, 1, None, "no role")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packed = gather_messages(table, "conv_id", "turn", "role", "text")
    back = read_back(format_turns(canonical_turns(packed, "conv_id", "payload"), "conv_id"), "conv_id")
    for r in back.collect():
        want = sorted((t, role or "", x or "") for c, t, role, x in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, x) for _, role, x in want]
        assert r["loss_text"] == "".join(x for _, role, x in want if role == "assistant")


def test_no_rows(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert gather_messages(table, "conv_id", "turn", "role", "text").count() == 0


def test_lists_roles_and_extra_fields(spark):
    from vitrine.llm.chat_format import canonical_turns, gather_messages

    payloads = [
        '{"messages":[]}', '{"messages":null}', '{"conversations":[]}',
        '{"messages":[{"role":"human","content":"a","name":"n"},{"role":"gpt","content":"b"}]}',
        '{"id":7,"source":"web","messages":[{"content":"a","role":"user"}]}',
        '{"conversations":[{"from":"human","value":"a","weight":1.5},{"from":"gpt","value":null}]}',
        '{"prompt":"p","completion":"c","score":0.25,"a b":null}', '{"prompt":"p","completion":"c","meta":{"x":1}}', '{"other":1}',
    ]
    records = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in canonical_turns(records, "id", "payload").collect()}
    assert got[0] == got[1] == ("messages", []) and got[2] == ("conversations", [])
    assert got[3] == ("messages", [("human", "a"), ("gpt", "b")])
    assert got[4] == ("messages", [("user", "a")])
    assert got[5] == ("conversations", [("user", "a"), ("assistant", "")])
    assert got[6] == ("prompt_completion", [("user", "p"), ("assistant", "c")])
    assert got[7] == got[8] == (None, None)
    rows = spark.createDataFrame([(1, 0, "model", "x"), (1, 1, "bot", None)], "id long, turn int, role string, text string")
    turns = canonical_turns(gather_messages(rows, "id", "turn", "role", "text"), "id", "payload").first()["turns"]
    assert [tuple(t) for t in turns] == [("model", "x"), ("bot", "")]
