import hashlib

from hypothesis import given
from hypothesis import strategies as st

from larkspur.llm import chat

bits = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "/s>", "[", "INST]", "\n", "%0A", "%", "é", "a", " "]), max_size=12).map("".join)


@given(st.lists(st.tuples(bits, bits), max_size=4))
def test_round_trip(turns):
    rendered = [chat.render(r, t) for r, t in turns]
    assert chat.parse("".join(x[0] for x in rendered)) == turns
    for (text, start, end), (_, source) in zip(rendered, turns, strict=True):
        assert chat.unescape(text[start:end]) == source
        assert not any(c in text[start:end] for c in chat.CONTROL)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(text), len(loss), sha(loss))
    return out


def test_conversations_match_brute_force(spark, sf):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, None, "x"), (2, 0, "system", "<\\/s> <|turn|>assistant\nhi"),
        (None, 3, "assistant", ""), (3, 0, "assistant", "é" * 200_000), (3, 0, "assistant", "é" * 200_000), (4, None, "user", "y"), (9_007_199_254_740_993, 0, "user", "z"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.selectExpr("*", "'clash' as rendered", "1 as body_start", "2 as conv")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversations(chat.format_turns(frame)).collect()}
    assert got == brute(rows)
    assert chat.conversations(chat.format_turns(frame.limit(0))).count() == 0
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversations(chat.format_turns(table)).collect()}
    assert got == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_ids_of_other_kinds(spark):
    rows = [("null", "b", "user", "x"), (None, "a", "user", "y"), ("null", "a", "assistant", "<s>"), ("é", None, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.conversations(chat.format_turns(frame)).collect()}
    assert got == {"null": (2, 3), None: (1, 0), "é": (1, 0)}


def test_joined_conversations_parse_to_their_source(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = chat.format_turns(table).orderBy("conv_id", "turn", "rendered").collect()
    by_conv = {}
    for r in turns:
        by_conv.setdefault(r.conv_id, []).append(r)
    for rows in by_conv.values():
        assert chat.parse("".join(r.rendered for r in rows)) == [(r.role, r.text) for r in rows]
