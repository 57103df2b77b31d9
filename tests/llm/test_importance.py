import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quadweave.llm import importance


def brute(docs, target, share=(5, 100), min_words=20):
    def of(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    rows, goal = [(i, *of(t)) for i, t in docs], [of(t)[1] for t in target]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, f in rows:
        np.add.at(s, f, 1)
    for f in goal:
        np.add.at(t, f, 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fits = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fits[: share[0] * len(fits) // share[1]])}
    return [(r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in out]


def texts_of(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Straße", "ÉTÉ", "don't", "x-y", "中文", "A1b2"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_report_equals_brute_force(spark, docs_of, hard_texts):
    texts = hard_texts + texts_of(300, 1)
    target = texts_of(40, 2) + [None, "", hard_texts[9]]
    docs = docs_of(list(enumerate(texts)))
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted(tuple(r) for r in importance.resampling_report(docs, goal, share=(30, 100)).collect())
    assert got == sorted(brute(list(enumerate(texts)), target, (30, 100)))


def test_ties_repeated_and_missing_ids(spark, docs_of):
    text = " ".join(f"v{i}" for i in range(25))
    ids = [5] * 30 + [None] * 3 + [1, 2, 3]
    docs = docs_of([(i, text) for i in ids])
    goal = spark.createDataFrame([(1, "v1 v2 v3")], "item_id long, text string")
    got = importance.resampling_report(docs, goal, share=(1, 1)).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(ids) + 1))
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(order)
    chosen = importance.resample(docs, goal, share=(1, 1))
    assert chosen.columns == docs.columns and chosen.count() == len(ids)


def test_empty_tables(spark, docs_of):
    docs, goal = docs_of([(1, "a b c")]), spark.createDataFrame([(1, None)], "item_id long, text string")
    assert importance.resampling_report(docs.where("doc_id > 1"), goal).count() == 0
    (row,) = importance.resampling_report(docs, goal.where("item_id > 1")).collect()
    assert (row["n_features"], row["rank"]) == (6, None)


def test_clashing_and_dotted_columns(spark, docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(texts_of(20, 4))]).withColumnRenamed("doc_id", "doc.id").withColumnRenamed("text", "weight")
    docs = docs.selectExpr("*", "'x' as `_tag`", "'x' as `n.words`", "'y' as `_drawn`")
    goal = spark.createDataFrame([("w1 w2",)], "`the.text` string")
    out = importance.resample(docs, goal, "doc.id", "weight", "the.text", share=(1, 2), min_words=0)
    assert out.columns == docs.columns and out.count() == 10


@pytest.mark.parametrize("seed", range(5))
def test_sliced_sums_are_exact(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    gain = rng.integers(-40_000, 40_000, n) if seed else np.full(n, -1)
    counts = rng.integers(0, 2 ** int(rng.integers(1, 40)), n)
    assert importance.sliced_weight(counts, importance.planes(gain, signed=True)) == sum(int(a) * int(b) for a, b in zip(gain, counts))
