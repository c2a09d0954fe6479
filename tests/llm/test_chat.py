import hashlib
import random

from chronolane.llm.chat import DEFAULT, format_chats, read_back

SCHEMA = "conv_id long, turn long, role string, text string, extra string, seq long"


def digests(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_random_texts_with_control_strings(spark):
    rng = random.Random(1)
    bits = ["\\", "### ", "</turn>", " </turn>\n", "\n", ":", "User", "é", "\U0001f600", "#", " ", "\\\\", "### Assistant: "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool: x\\", "", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))]), "x", 9) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "a", "x", 1), (None, None, "assistant", "b", "x", 1), (41, 0, "user", "tie", "x", 1), (41, 0, "user", "tie", "x", 1)]
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out == digests(rows)


def test_machine_says_which_turn_is_out_of_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "user", "q")]
    out = {r.conv_id: (r.valid, r.first_wrong_turn) for r in read_back(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert out == {1: (True, None), 2: (False, 1), 3: (False, None)}


def test_segments_carry_loss_for_assistant_texts_alone(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a ### b")]
    segments = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seq").collect()
    assert [s.segment for s in segments if s.loss] == ["a \\### b"]
    assert "".join(s.segment for s in segments) == "### User: q </turn>\n### Assistant: a \\### b </turn>\n"
    assert DEFAULT.unescape("a \\### b") == "a ### b"


def test_empty_table(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
