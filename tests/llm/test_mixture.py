import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadweave.llm import mixture


def test_share_stops_at_three_times_the_size():
    assert mixture.share(60, [20, 20, 20], [1, 2, 3]) == [10, 20, 30]
    targets = mixture.share(110, [100, 5, 5], [1, 2, 3])
    assert targets[1:] == [15, 15] and targets[0] == pytest.approx(80)
    assert mixture.share(0, [0, 0], [1, 2]) == [0, 0] and mixture.share(0, [], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1_000])
def test_permutations(n):
    image = mixture.permute(np.arange(n), n, 7)
    assert sorted(image) == list(range(n))
    assert mixture.permute(image, n, 7, inverse=True).tolist() == list(range(n))


def test_slot_plan_meets_its_target_by_counting():
    rng = random.Random(3)
    for _ in range(300):
        size, block, key = rng.randint(1, 2_000), rng.choice([1, 7, 64]), rng.randrange(100)
        target = rng.uniform(0, 3 * size)
        blocks, slots, last = mixture.slot_plan(size, target, block, key)
        lengths = [min(block, size - b * block) for b in range(blocks)]
        taken = 0
        for k in range(slots):
            b = int(mixture.permute(np.array([k % blocks]), blocks, mixture._key(key, k // blocks))[0])
            taken += last if k == slots - 1 else lengths[b]
            assert k < slots - 1 or 0 < last <= lengths[b]
        assert taken == min(round(target), 3 * size)


def test_shards_draw_all_slots_once():
    slots, size = np.array([1_000, 0, 37, 4_321]), 100
    shards = -(-int(slots.sum()) // size)
    drawn, first = Counter(), []
    for i in range(shards):
        source, number = mixture.deal(slots, i, size, 5)
        assert len(source) == min(size, slots.sum() - i * size)
        drawn.update(zip(source.tolist(), number.tolist()))
        first.append(int((source == 0).sum()))
    assert drawn == Counter((s, k) for s, n in enumerate(slots) for k in range(n))
    # Drawn without replacement: mean 18.7, standard deviation 3.9.
    assert 14 < np.mean(first) < 24 and 2 < np.std(first[:-1]) < 6


def test_draws_of_any_size():
    slots = np.array([3_000_000_000_000, 5, 2_000_000_000_000, 0])
    source, number = mixture.deal(slots, 1_000_000_000, 4_000, 1)
    assert len(set(zip(source.tolist(), number.tolist()))) == 4_000 and (number >= 0).all() and (number < slots[source]).all()
    assert abs((source == 0).mean() - 0.6) < 0.04


def size_of(text):
    return len((text or "").encode().split())


def corpus(hard_texts):
    rng = random.Random(8)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.randint(1, 400))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(1_000 + i, t, "hard") for i, t in enumerate(hard_texts)] + [(2_000, "one two three", "tiny"), (7, "twin row", "b"), (7, "twin row", "b"), (7, "twin row", "c"), (None, "no id", "c")]
    return rows


def test_report(docs_of, hard_texts):
    rows = corpus(hard_texts)
    docs = docs_of(rows)
    got = mixture.mix_report(docs, block_words=16, shard_slots=64).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size_of(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size_of(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(names, mixture.share(sum(sizes.values()), [sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    by_doc = {(i, size_of(t)): s for i, t, s in rows if i != 7}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if (r["doc_id"], r["size"]) in by_doc:
            s = by_doc[r["doc_id"], r["size"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        taken[round(r["target"], 3), r["source_size"]] += r["taken"]
    assert dict(taken) == {(round(targets[s], 3), sizes[s]): round(targets[s]) for s in sizes}
    again = mixture.mix_report(docs.repartition(7), block_words=16, shard_slots=64).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)), "reruns agree"


def test_slots_hold_the_mix(docs_of, hard_texts):
    docs = docs_of(corpus(hard_texts))
    got = mixture.mix_slots(docs, block_words=16, shard_slots=64).collect()
    streams, totals = mixture._streams(docs, "doc_id", "text", "source", 16, mixture.SEED)
    plan = mixture.source_plan(totals, None, 16, 3, mixture.SEED)
    by_slot, by_place = defaultdict(list), Counter()
    for r in got:
        by_slot[r["shard"], r["slot"]].append(r)
        by_place[r["source_index"], r["place"]] += r["end"] - r["first"]
    slots = np.array([p["slots"] for p in plan])
    numbers = Counter()
    for shard in range(-(-int(slots.sum()) // 64)):
        source, number = mixture.deal(slots, shard, 64, mixture.SEED)
        for slot, (i, k) in enumerate(zip(source.tolist(), number.tolist())):
            rows, p = sorted(by_slot.pop((shard, slot)), key=lambda r: r["place"]), plan[i]
            block = int(mixture.permute(np.array([k % p["blocks"]]), p["blocks"], mixture._key(mixture._key(mixture.SEED, i), k // p["blocks"]))[0])
            assert {(r["source_index"], r["block"], r["pass"]) for r in rows} == {(i, block, k // p["blocks"])}
            at = rows[0]["place"] + rows[0]["first"]
            assert at == 16 * block
            for r in rows:
                assert r["place"] + r["first"] == at, "words of a slot follow each other"
                at = r["place"] + r["end"]
            assert at - 16 * block == (p["last"] if k == p["slots"] - 1 else min(16, p["size"] - 16 * block))
            numbers[i] += at - 16 * block
    assert not by_slot
    assert [numbers[i] for i in range(len(plan))] == [round(p["target"]) for p in plan]
    taken = Counter(r["taken"] for r in mixture.mix_report(docs, block_words=16, shard_slots=64).collect() if r["taken"])
    assert taken == Counter(by_place.values())


def test_mixed_documents_hold_the_words_taken(docs_of, hard_texts):
    rows = [r for r in corpus(hard_texts) if r[0] is not None]
    docs = docs_of(rows)
    mixed = mixture.mix_documents(docs, block_words=16, shard_slots=64)
    assert mixed.columns == docs.columns
    taken, whole = Counter(), {}
    for i, t, _ in rows:
        whole.setdefault(i, []).append(t or "")
    for r in mixed.collect():
        taken[r["doc_id"]] += size_of(r["text"])
        assert r["n_chars"] == len(r["text"])
        assert any(part in t for t in whole[r["doc_id"]] for part in [r["text"].split("\n")[0]])
    report = Counter()
    for r in mixture.mix_report(docs, block_words=16, shard_slots=64).collect():
        report[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in report.items() if v} == dict(taken)


def test_empty(docs_of):
    docs = docs_of([(1, "a")]).limit(0)
    assert mixture.mix_report(docs).count() == 0 and mixture.mix_documents(docs).count() == 0
    assert mixture.mix_report(docs_of([(1, None), (2, "")])).select("taken").distinct().collect() == [(0,)]
