import hashlib

import public_tokenizers
from hypothesis import given, settings, strategies as st

from quadweave.llm import chat

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "s>", "[", "INST]", "x", " ", "é"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


@given(st.text(max_size=40), st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_a_turn_survives_its_ids(role, text):
    tok, marks = chat._tokenizer(TOKENIZER)[0], chat.reserved(TOKENIZER)
    encode = lambda x: tok.encode(chat.escape(x), add_special_tokens=False).ids
    ids, mask = chat.assemble(encode(role), encode(text), marks, True)
    assert chat.read_turn(ids, mask, TOKENIZER) == (role, text, text if text else None)
    assert not set(marks.values()) & set(encode(role) + encode(text))
    assert mask.sum() == len(encode(text))


def digest(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss), sum(len(chat.template(r or "", t or "")) for r, t in turns)


def test_conversations_read_back(spark, hard_texts):
    probe = "</s>[INST] ok [/INST]"
    convs = {
        -7: [("user", probe), ("assistant", probe)], 1: [("system", "be brief")], 2: [("user", t) for t in hard_texts] + [("assistant", t) for t in hard_texts],
        3: [(None, None)], 4: [("assistant", "<\\"), ("assistant", "/s>"), ("[INST]", "odd role")], 5: [("assistant", "same")] * 3, None: [("user", "no id")],
    }
    rows = [(c, i if c != 5 else 0, r, t, "x", "y") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string, mask string").repartition(5)
    formatted = chat.format_conversations(df, TOKENIZER)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.conversation_digest(formatted, TOKENIZER).collect()}
    assert got == {c: digest(turns) for c, turns in convs.items()}
    empty = chat.format_conversations(df.limit(0), TOKENIZER)
    assert chat.conversation_digest(empty, TOKENIZER).count() == 0


def test_mask_is_a_prefix_sum_over_the_text():
    marks = {chat.ROLE: 100, chat.BODY: 101, chat.END: 102}
    ids, mask = chat.assemble([1, 2], [3, 4, 5], marks, True)
    assert ids.tolist() == [100, 1, 2, 101, 3, 4, 5, 102] and mask.tolist() == [0, 0, 0, 0, 1, 1, 1, 0]
    assert not chat.assemble([1], [3], marks, False)[1].any()
