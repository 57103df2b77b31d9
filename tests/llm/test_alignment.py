import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quadweave.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    """(ids, byte ends) of both tokenizers from the libraries on whole texts, or None."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(c): c for c in visible}
    letters |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)}

    def encode(text):
        if not text:
            return None
        raw = b" " + text.encode()
        e = a.encode(" " + text, add_special_tokens=False)
        bytes_a = [bytes(letters[c] for c in t) for t in e.tokens]
        ids_b = b.encode(text)
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        return (e.ids, ends(bytes_a)), (ids_b, ends(bytes_b))

    return encode


def brute_groups(encoded):
    (ids_a, ends_a), (ids_b, ends_b) = encoded
    cuts, groups = set(ends_a) & set(ends_b), []
    for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
        g = 0
        for i, e in zip(ids, ends):
            if len(groups) <= g:
                groups.append(([], []))
            groups[g][side].append(i)
            g += e in cuts
    return groups


def brute_report(texts, whole):
    found = [brute_groups(e) if (e := whole(t)) else [] for t in texts]
    links = [[(a, b) for x, y in groups for a in x for b in y] for groups in found]
    counts = Counter(p for ls in links for p in set(ls))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for groups, ls in zip(found, links):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(ls), sum(counts[p] == best[p[0]] for p in ls),
            sum(counts[p] for p in ls), hashlib.sha256(written.encode()).hexdigest() if groups else "",
        ))
    return rows


ODD = [
    "a  b   c", " lead and trail ", "\n\n two\r\nlines\x0b\x0c", "has ▁ inside", "<s>x</s> <unk> <0x0A> <|endoftext|>", "\x00\x01", "日本語のテキスト 中文", "👩‍👩‍👧🏽 ok",
    "été ﬁn", "   　 ", "Ünïcödé-Wörter; 3.14159 and 1e10!", "x" * 3000, "é" * 700, " " * 50, " \u0085", "🏴" * 300,
]


@pytest.mark.parametrize("pairs_per_chunk", [alignment.PAIRS_PER_CHUNK, 40])
def test_report_equals_brute_force(spark, docs_of, hard_texts, whole, pairs_per_chunk):
    rng = random.Random(3)
    words = "the of token alignment naïve über straße 2024 don't — … 中文 🙂 http://a.b/c foo_bar".split()
    texts = hard_texts + ODD + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "", ", "]) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    texts += texts[-5:]
    got = {r["doc_id"]: r for r in alignment.alignment_report(docs_of(list(enumerate(texts))), A, B, pairs_per_chunk=pairs_per_chunk).collect()}
    want = brute_report(texts, whole)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == w, texts[i][:60] if texts[i] else texts[i]
    assert [got[i]["n_a"] for i in (0, 1)] == [0, 0] and got[len(hard_texts) + 3]["groups_sha256"] == ""


def test_cuts_equal_all_common_ends():
    """Random ends, shared ones dense, sparse, on one side only, or none but the last."""
    rng = np.random.default_rng(5)
    for case in range(200):
        n = int(rng.integers(1, 400))
        a = np.flatnonzero(rng.random(n) < rng.choice([0.05, 0.4, 0.9]))
        b = np.flatnonzero(rng.random(n) < rng.choice([0.05, 0.4, 0.9]))
        if case % 3 == 0:
            b = np.setdiff1d(b, a[a > n // 4])
        a, b = np.union1d(a, [n]) + 1, np.union1d(b, [n]) + 1
        got_a, got_b = alignment.shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
        common = np.intersect1d(a, b)
        assert got_a.tolist() == [0, *(np.searchsorted(a, common) + 1).tolist()]
        assert got_b.tolist() == [0, *(np.searchsorted(b, common) + 1).tolist()]


def test_alignment_itself_and_empty_tables(spark, docs_of, whole):
    texts = ["Tokens of two sides.", None, "naïve café"]
    rows = {r["doc_id"]: r["groups"] for r in alignment.align_documents(docs_of(list(enumerate(texts))), A, B).collect()}
    for i, t in enumerate(texts):
        groups = brute_groups(whole(t)) if t else []
        assert rows[i] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    empty = docs_of([(1, "x")]).where("doc_id > 1")
    assert alignment.alignment_report(empty, A, B).count() == 0


def test_repeated_and_missing_ids_are_documents_of_their_own(spark, docs_of, whole):
    texts = ["same words here", "same words here", "same words"]
    docs = docs_of([(7, texts[0]), (7, texts[1]), (None, texts[2])]).withColumnRenamed("doc_id", "the.id")
    got = sorted(((r["the.id"], r["n_links"], r["count_sum"]) for r in alignment.alignment_report(docs, A, B, ident="the.id").collect()), key=str)
    want = brute_report(texts, whole)
    assert got == sorted(((i, w[3], w[5]) for i, w in zip((7, 7, None), want)), key=str)
