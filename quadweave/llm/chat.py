"""Chat formatting at the level of tokens.

Each text is escaped and encoded on its own; reserved ids, which no text can yield, are spliced
around it: role, body, end. The loss mask is a prefix sum over the boundaries of the spans that
count (+1 where an assistant's text begins, -1 where it ends). Reading back cuts the ids at the
reserved ones, decodes the pieces and undoes the escapes, so texts survive to the letter.

A control string inside a text gets a backslash behind its first character, and one more if it has
some already; reading takes one away. The plain-text form of the template uses the same escapes.

Rows are turns; a conversation is its rows in order of turn, ties by role and text, null first. A
null text is empty; a null role is an empty role. Repeated rows are turns of their own; rows without
a conversation id form one conversation. A conversation may be of any length: turns are formatted
row by row, and read back as a stream of sorted rows of which one is held at a time. Empty tables
give empty results. A text of unpaired surrogates cannot occur in Spark.
"""

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadweave.llm.common import slices, written

ROLE, BODY, END = "[INST]", "[/INST]", "</s>"
#: Strings with a meaning in this template or in common ones.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|user|>", "<|assistant|>", "<|system|>")
LOSS_ROLES = ("assistant",)
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


@lru_cache(maxsize=2)
def _tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t, t.get_vocab_size()


def reserved(path: str) -> dict[str, int]:
    """Ids behind the vocabulary for the template's marks."""
    size = _tokenizer(path)[1]
    return {mark: size + i for i, mark in enumerate((ROLE, BODY, END))}


def template(role: str, text: str) -> str:
    """The plain-text form of a turn."""
    return f"{ROLE}{escape(role)}{BODY}{escape(text)}{END}"


def assemble(role_ids, text_ids, marks, counts: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one turn."""
    ids = np.concatenate(([marks[ROLE]], role_ids, [marks[BODY]], text_ids, [marks[END]])).astype("i4")
    edges = np.zeros(len(ids) + 1, "i4")
    if counts:
        start = len(role_ids) + 2
        edges[start] += 1
        edges[start + len(text_ids)] -= 1
    return ids, np.cumsum(edges)[:-1].astype("i1")


def format_turns(conversations: DataFrame, tokenizer: str, conv="conv_id", turn="turn", role="role", text="text", loss_roles=LOSS_ROLES) -> DataFrame:
    """(conv_id, turn, ids, mask, formatted): token ids, loss mask and plain-text form of every row."""
    kinds = ", ".join(f"`{c}` {conversations.schema[c].dataType.simpleString()}" for c in (conv, turn))

    def run(batches):
        tok, marks = _tokenizer(tokenizer)[0], reserved(tokenizer)
        for batch in slices(batches):
            roles, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
            encoded = tok.encode_batch_fast([escape(x) for x in (*roles, *texts)], add_special_tokens=False)
            pairs = [
                assemble(r.ids, t.ids, marks, role in loss_roles) for r, t, role in zip(encoded[: len(roles)], encoded[len(roles) :], roles)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
                 pa.array([p[1] for p in pairs], pa.list_(pa.int8())), pa.array([template(r, t) for r, t in zip(roles, texts)], pa.string())],
                names=[conv, turn, "ids", "mask", "formatted"],
            )

    return conversations.select(conv, turn, F.col(role).cast("string"), F.col(text)).mapInArrow(
        run, f"{kinds}, ids array<int>, mask array<tinyint>, formatted string"
    )


def read_turn(ids, mask, tokenizer: str) -> tuple[str, str, str | None]:
    """(role, text, text under the mask or None) from the ids of a turn."""
    tok, marks = _tokenizer(tokenizer)[0], reserved(tokenizer)
    ids, mask = np.asarray(ids), np.asarray(mask, bool)
    cuts = [int(np.flatnonzero(ids == marks[m])[0]) for m in (ROLE, BODY, END)]

    def text(part):
        return unescape(tok.decode(part.tolist(), skip_special_tokens=False))

    body = slice(cuts[1] + 1, cuts[2])
    under = text(ids[mask]) if mask.any() else None
    return text(ids[cuts[0] + 1 : cuts[1]]), text(ids[body]), under


def conversation_digest(turns: DataFrame, tokenizer: str, conv="conv_id", turn="turn") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted turns.

    A checksum runs over a conversation in order, so its turns pass through one task, sorted by
    Spark, one row at a time.
    """
    kind = turns.schema[conv].dataType.simpleString()

    def run(batches):
        current, state, out = None, None, []

        def row():
            n, whole, chars, loss, formatted = state
            return (current[0], n, whole.hexdigest(), chars, loss.hexdigest(), formatted)

        def table():
            done = list(zip(*out)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(done[0], id_type), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string()), pa.array(done[3], pa.int64()), pa.array(done[4], pa.string()), pa.array(done[5], pa.int64())],
                names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        id_type = None
        for batch in slices(batches):
            id_type = id_type or batch.schema.field(0).type
            for c, ids, mask, formatted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if current != (c,):
                    if current:
                        out.append(row())
                    current, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, under = read_turn(ids, mask, tokenizer)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if under is not None:
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += formatted
            if len(out) >= 1_000:
                yield table()
        if current:
            out.append(row())
        if out:
            yield table()

    return (
        turns.select(conv, "ids", "mask", F.length("formatted").cast("long").alias("chars"), turn, "formatted")
        .repartition(conv).sortWithinPartitions(conv, turn, "formatted").drop(turn, "formatted")
        .mapInArrow(run, f"{conv} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


def format_conversations(conversations: DataFrame, tokenizer: str, **columns) -> DataFrame:
    """``format_turns`` written to the shared folder."""
    return written(format_turns(conversations, tokenizer, **columns), "chat")
