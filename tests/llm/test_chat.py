import hashlib

from llm.chat import Template, digests, format_chats, read_chats

HARD = ["\\### Assistant: </turn> ok", "</turn>\n### User: x", "\\\\h \\l \\", "", None, "#### </turn></turn>", "é\n</turn", ": a", "\\\\</turn>\\"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, formatted int")


def test_round_trip_and_loss(spark):
    roles = ["system", "user", "assistant", "tool: x", None, "@", "System", "a\\c:\n### "]
    rows = [(c, t, roles[(c + t) % len(roles)], HARD[(3 * c + t) % len(HARD)], "x", 1) for c in range(20) for t in range(9)]
    done = {r.conv_id: r for r in read_chats(format_chats(turns(spark, rows))).collect()}
    out = {r.conv_id: r for r in digests(read_chats(format_chats(turns(spark, rows)))).collect()}
    for c in range(20):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [tuple(x) for x in done[c].turns_read] == own
        assert "".join(s.text for s in done[c].segments) == done[c].formatted
        loss = "".join(t for r, t in own if r == "assistant")
        assert done[c].loss_text == loss
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (out[c].n_turns, out[c].loss_chars, out[c].formatted_chars) == (9, len(loss), len(done[c].formatted))
        assert out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert done[c].formatted.count("</turn>") == 9


def test_machine(spark):
    def walk(roles):
        return format_chats(turns(spark, [(1, i, r, "t", "", 0) for i, r in enumerate(roles)])).first()

    for roles, bad in (
        (["system", "user", "assistant", "user"], None), (["user", "assistant"], None), (["assistant"], 0), (["user", "user"], 1),
        (["user", "system"], 1), (["system", "assistant"], 1), (["user", "assistant", "system"], 2), ([None], 0), (["user", "tool"], 1)):
        found = walk(roles)
        assert (found.bad_turn, found.valid) == (bad, bad is None), roles


def test_ties_nulls_and_empty(spark):
    rows = [(None, 1, "user", "b", "", 0), (None, None, "user", "a", "", 0), (2, 1, "user", "x", "", 0), (2, 1, "assistant", "y", "", 0), (2, 1, "user", "x", "", 0)]
    found = {r.conv_id: [tuple(x) for x in r.turns_read] for r in read_chats(format_chats(turns(spark, rows))).collect()}
    assert found == {None: [("user", "a"), ("user", "b")], 2: [("assistant", "y"), ("user", "x"), ("user", "x")]}
    assert format_chats(turns(spark, rows).limit(0)).collect() == []


def test_other_template(spark):
    other = Template(open="<|", after="|>", close="<|end|>", marks={"<|": "o"}, names={"user": "U", "assistant": "A"}, loss=frozenset({"user"}))
    rows = [(1, 0, "user", "a <|end|> \\o b", "", 0), (1, 1, "assistant", "<|A|>", "", 0)]
    found = read_chats(format_chats(turns(spark, rows), other), other).first()
    assert [tuple(x) for x in found.turns_read] == [(r[2], r[3]) for r in rows]
    assert found.loss_text == rows[0][3]
