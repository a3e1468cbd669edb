"""Mixed layouts, optional fields, extras, rejects and long conversations."""

import hashlib
import json

import pytest

from tracewright.llm import chat

TURNS = [("user", "hi"), ("assistant", "yo")]
WITH_SYSTEM = [("system", "be kind"), *TURNS]
KNOWN = [
    ({"messages": [{"role": "user", "content": "hi", "name": "joe", "id": 4}, {"role": "assistant", "content": "yo"}], "id": "x", "metadata": {"a": [1, {"b": 2}]}}, TURNS),
    ([{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], TURNS),
    ({"system": "be kind", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, WITH_SYSTEM),
    ({"system": "be kind", "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, WITH_SYSTEM),
    ({"prompt": "hi", "response": "yo", "system": "be kind", "source": "web"}, WITH_SYSTEM), ({"prompt": "hi", "completion": "yo"}, TURNS), ({"question": "hi", "answer": "yo", "id": 1}, TURNS),
    ({"instruction": "hi", "input": "there", "output": "yo"}, [("user", "hi\nthere"), ("assistant", "yo")]), ({"instruction": "hi", "input": None, "output": "yo", "system": "be kind"}, WITH_SYSTEM),
    ({"messages": []}, []), ({"conversations": []}, []), ({"messages": [{"role": "user"}]}, [("user", "")]), ({"role": None, "text": None}, [("", "")]), ({"role": "user"}, [("user", "")]), ({"prompt": 5, "response": {"a": 1}}, None),
]
UNKNOWN = [json.dumps({"other": 1}), json.dumps({"other": 2, "id": 3}), json.dumps("text"), "{not json", "", None, json.dumps({}), json.dumps([])]


@pytest.mark.parametrize(("record", "turns"), [k for k in KNOWN if k[1] is not None])
def test_known_layouts(record, turns):
    assert chat.canonical(record) == turns


def test_records_mixed_as_they_come(spark):
    rows = [(i, json.dumps(r)) for i, (r, t) in enumerate(KNOWN)] + [(100 + i, r) for i, r in enumerate(UNKNOWN)]
    df = spark.createDataFrame(rows, "n long, record string").selectExpr("n", "record", "1 AS segment", "2 AS c0")
    got = {r["n"]: chat.read_turns(r["segment"]) for r in chat.format_records(df, "record", ["n"]).collect()}
    assert {n: [(r, t) for r, t, _ in turns] for n, turns in got.items()} == {i: t for i, (_, t) in enumerate(KNOWN) if t is not None}
    bad = {r["fields"]: (r["fingerprint"], r["n_records"]) for r in chat.rejects(df, "record").collect()}
    assert bad["other"] == (chat.schema_fingerprint({"other"}), 2) and bad["no JSON"] == ("", 3) and sum(n for _, n in bad.values()) == len(UNKNOWN) + 1


def test_variants_are_apart():
    assert len(chat.MAPPINGS) == sum(len(chat.variants(layout)) for layout in chat.LAYOUTS.values())


def test_very_long_conversation(spark):
    """Ties by role and by text as they were, not as escaped."""
    rows = [(1, i // 2, "assistant" if i % 2 else "user", f"turn {i} <|im_end|>") for i in range(30_000)] + [(2, 0, "user", t) for t in ("<|", "<}", "<~", "<a", "<")] + [(3, 0, "user", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for c, r in got.items():
        mine = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1], x[2], x[3]))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest() and r["n_turns"] == len(mine)
        assert r["loss_sha256"] == hashlib.sha256("".join(x[3] for x in mine if x[2] == "assistant").encode()).hexdigest()


def test_extras_are_passed_over_beside_turns_and_nowhere_else():
    turn = {"role": "user", "content": "hi"}
    for record in ({"messages": [turn | {"id": 7, "name": "x"}], "metadata": {"a": [1]}, "id": 1}, [turn | {"id": 1}], {"prompt": "a", "response": "b", "tags": ["x"], "score": 0.5}):
        assert chat.canonical(record)
    for record in (
        {"messages": [turn | {"tool_calls": [{"id": 1}]}]}, {"messages": [turn], "tool_calls": [{"id": 1}]}, {"messages": [turn | {"metadata": {"text": "said"}}]}, {"prompt": {"name": "a"}, "response": "b"},
        {"prompt": "a", "response": "b", "context": {"source": "s"}}, [turn | {"meta": ["x"]}], {"messages": [{"role": "user", "content": {"name": "n"}}]},
    ):
        with pytest.raises(chat.UnknownLayout):
            chat.canonical(record)
