import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quadweave.llm import packing, token_file
from quadweave.llm.tokenizing import PLAIN, SPACED, WordEncoder

FILES = {"byte_bpe_50k.json": SPACED, "word_bpe_49k.json": PLAIN}


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_words_give_the_ids_of_whole_texts(name, hard_texts):
    ids, enc = whole(name), WordEncoder(public_tokenizers.path(name), FILES[name], kept_words=50)
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "İ", "ı", "ß", "Σ", "σ", "'", "'s", "’", "́", "̇", "1", "½", "²", ",", ".", "!", "_", " ", "  ", "\n", "\t", " ", " ", "　", "\x1c", "\x85", "日", "👩", "‍", "ʼ", "ﬁ", "<|endoftext|>", "don't", "I'LL"]
    texts = [t or "" for t in hard_texts] + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3_000)]
    for i in range(0, len(texts), 300):
        for t, got in zip(texts[i : i + 300], enc.encode(texts[i : i + 300])):
            assert np.frombuffer(got, "<u4").tolist() == ids(t), repr(t[:80])


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_any_text(text):
    for name, pattern in FILES.items():
        assert np.frombuffer(_encoders[name].encode([text])[0], "<u4").tolist() == _whole[name](text)


_encoders = {n: WordEncoder(public_tokenizers.path(n), p) for n, p in FILES.items()}
_whole = {n: whole(n) for n in FILES}


@given(st.lists(st.integers(0, 2**24), max_size=1_500))
@settings(max_examples=60, deadline=None)
def test_codes_give_every_id_and_every_range(ids):
    levels = token_file.encode(np.array(ids, "u8"))
    assert token_file.token_range(levels, 0, len(ids)).tolist() == ids
    rng = random.Random(len(ids))
    for _ in range(20):
        a, b = sorted((rng.randint(0, len(ids)), rng.randint(0, len(ids))))
        assert token_file.token_range(levels, a, b).tolist() == ids[a:b]
    for i in rng.sample(range(len(ids)), min(40, len(ids))):
        assert token_file.token(levels, i) == ids[i]


def test_file_round_trip(spark, docs_of, hard_texts, tmp_path):
    path, name = str(tmp_path / "tokens"), "byte_bpe_50k.json"
    rows = [(100 - i, t) for i, t in enumerate(hard_texts)] + [(3, "twin"), (3, "other twin"), (None, "no id")]
    token_file.write_tokens(docs_of(rows), path, public_tokenizers.path(name), segment_tokens=50)
    got = token_file.read_documents(spark, path, with_ids=True).collect()
    assert len(got) == len(rows)
    start, stream = 0, []
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
        stream += r["ids"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [None, *sorted(x for x in order if x is not None)]
    for r in got:
        if r["doc_id"] and r["doc_id"] > 3:
            assert r["ids"] == _whole[name](hard_texts[100 - r["doc_id"]]) + [0]
    for i in (0, 1, start // 2, start - 1):
        assert token_file.token_at(spark, path, i) == stream[i]
    assert token_file.token_at(spark, path, start) is None


def test_empty_token_file(spark, docs_of, tmp_path):
    path = str(tmp_path / "none")
    token_file.write_tokens(docs_of([(1, "a")]).limit(0), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_file.read_documents(spark, path).count() == 0


# --- packing ------------------------------------------------------------------------------------


def unpack(histogram, capacity):
    """Every piece of every run: {sequence: [(offset, length)]}, and each piece placed once."""
    placed, bins = {k: set() for k in histogram}, {}
    for length, first, count, sequence, offset in packing.pack(histogram, capacity):
        for i in range(count):
            assert first + i not in placed[length]
            placed[length].add(first + i)
            bins.setdefault(sequence + i, []).append((offset, length))
    assert all(placed[k] == set(range(n)) for k, n in histogram.items())
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
@settings(max_examples=200, deadline=None)
def test_runs_are_a_packing(histogram):
    bins = unpack(histogram, 40)
    total = sum(k * n for k, n in histogram.items())
    large = sum(n for k, n in histogram.items() if 2 * k > 40)
    # Best fit by falling length stays within 11/9 of the optimum, which these bounds do not exceed.
    assert len(bins) <= 11 / 9 * max(-(-total // 40), large) * 1.5 + 1


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, b in enumerate(bins) if b + n <= capacity]
        if fitting:
            bins[max(fitting, key=lambda i: bins[i])] += n
        else:
            bins.append(n)
    return len(bins)


def test_as_few_sequences_as_item_by_item_best_fit():
    rng = random.Random(9)
    for _ in range(20):
        lengths = [min(200, int(rng.lognormvariate(3.5, 1)) + 1) for _ in range(400)]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        assert len(unpack(histogram, 200)) <= best_fit_decreasing(lengths, 200) * 1.02 + 1


def test_pairs_are_a_largest_matching():
    """Pieces above a third: the number of pairs equals that of an exhaustive matching."""
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randint(34, 100) for _ in range(9)]

        def most(items):
            if len(items) < 2:
                return 0
            a, rest = items[0], items[1:]
            return max(most(rest), *(1 + most(rest[:i] + rest[i + 1 :]) for i, b in enumerate(rest) if a + b <= 100), 0)

        bins = unpack({n: lengths.count(n) for n in set(lengths)}, 100)
        assert len(bins) == len(lengths) - most(lengths)


def test_packed_documents(docs_of, hard_texts):
    name = "word_bpe_49k.json"
    texts = [*hard_texts, "long " * 9_000]
    docs = docs_of(list(enumerate(texts)) + [(7, "repeat"), (7, "repeat"), (None, "no id")])
    rows = packing.pack_documents(docs, public_tokenizers.path(name), capacity=512).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert 0 < r["length"] <= 512 and len(r["ids"]) == 4 * r["length"]
    for i, t in enumerate(texts):
        if i == 7:
            continue
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in parts) == np.array(_whole[name](t) + [1], "<u4").tobytes()
        assert [r["start"] for r in parts] == [512 * k for k in range(len(parts))]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.packing_digest(docs.limit(0), public_tokenizers.path(name)).count() == 0
