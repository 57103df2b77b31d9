import random
import re
import zlib

import pytest

from quadweave.llm import toxicity
from quadweave.llm.toxicity import EXCEPTIONS, Lexicon, fold, matched


def test_folding():
    assert fold("M0R0N, 1d10t!  $tupid p@thetic träsh") == " moron idiot stupid pathetic trash "
    assert fold("могон mоrоn") .endswith(" moron ")
    assert fold("trash$$$ idiot### 2020 call 911") == " trash idiot 2020 call 911 "
    assert fold(None) == fold("") == fold(" \n") == "  "


def brute_matched(weights, folded):
    """Every entry at every place, by plain search."""
    best = {}
    for entry, w in weights.items():
        for m in re.finditer(f"(?={re.escape(entry)})", folded):
            best[m.start()] = max(w, best.get(m.start(), 0.0))
    for phrase in EXCEPTIONS:
        for m in re.finditer(f"(?={re.escape(f' {phrase} ')})", folded):
            best = {s: w for s, w in best.items() if not m.start() <= s < m.start() + len(phrase) + 1}
    return sum(best.values())


def test_matches_equal_plain_search():
    rng = random.Random(5)
    weights = {" idiot ": 4.0, " idi": 1.0, " trash ": 3.0, " tra": 0.5, " clown ": 2.0, " stu": 1.5}
    automaton = Lexicon(weights).automaton()
    words = ["idiot", "idiom", "trash", "can", "clown", "fish", "stupid", "simple", "train", "x"]
    for _ in range(300):
        folded = fold(" ".join(rng.choices(words, k=rng.randint(0, 20))))
        assert matched(automaton, folded) == pytest.approx(brute_matched(weights, folded))
    assert matched(automaton, fold("a clown fish by the trash can")) == 0
    assert matched(Lexicon({}, exceptions=()).automaton(), fold("idiot")) == 0


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "m0ron", "ugglepap", "ugglefix", "STUPID"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, docs_of, hard_texts):
    rows, labels = corpus(900, 1)
    rows += [(10_000 + i, t) for i, t in enumerate(hard_texts)] + [(None, "idiot")]
    labels_df = spark.createDataFrame([(i, t, 1 - t, "z") for i, t in labels] + [(5, None, 0, "z"), (None, 1, 0, "z")], "doc_id long, toxic int, quality int, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs_of(rows), labels_df).collect()}
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 150
    for r in got.values():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)
    assert not got[10_000]["predicted"] and not got[10_001]["predicted"]


def test_labels_of_held_out_rows_change_nothing(spark, docs_of):
    rows, labels = corpus(300, 2)
    docs = docs_of(rows)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    one, two = (
        sorted(map(tuple, toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, flipped)
    )
    assert one == two


def test_without_labels_known_words_decide(spark, docs_of):
    docs = docs_of([(1, "you pathetic idiot"), (2, "a fine morning by the river"), (3, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, none).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_an_id_on_many_rows_is_learned_from_once(spark, docs_of):
    docs = docs_of([(1, f"text {i}") for i in range(500)] + [(2, None), (2, "b"), (3, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels).collect()
    assert sorted(map(tuple, got), key=str) == [("b", 0), ("text 0", 1), (None, 0)]


def test_the_lexicon_has_no_bound_of_its_own(spark):
    words = [f"{a}{b}{c}{d}zz" for a in "bcdfghjklm" for b in "aeiou" for c in "klmnpqrstv" for d in "abcdefghijkl"]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    rows = [(t, 1) for t in texts] * 40 + [("a quiet morning by the river " * 17, 0)] * (40 * len(texts))
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert len(words) == 6_000 and all(f" {w} " in lexicon.weights for w in words)
