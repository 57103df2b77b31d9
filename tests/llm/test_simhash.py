import itertools
import random

import numpy as np
import pytest
import xxhash

from quadweave.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes) and hashes)


def brute_classes(prints):
    """Smallest position reachable over links of at most four bits."""
    low = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(prints)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low


def test_fingerprints_match_brute_force(docs_of, hard_texts):
    rows = simhash.fingerprints(docs_of(list(enumerate(hard_texts)))).collect()
    for r in rows:
        assert r["fp"] % 2**64 == brute_fingerprint(hard_texts[r["doc_id"]])


@pytest.mark.parametrize("block", [simhash.BLOCK, 7])
def test_links_connect_what_brute_force_connects(spark, block):
    """Planted neighbours at every distance up to six, small groups and dense ones, blocks of every size."""
    rng = random.Random(block)
    prints = {0, 2**64 - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for d in range(7):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            prints.add(y)
    core = rng.getrandbits(64)
    prints |= {core ^ (1 << a) ^ (1 << b) for a in range(0, 24) for b in range(24, 40)}
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.array([p], "u8").view("i8")[0]),) for p in prints], "fp long")
    edges = simhash.linked(df, block=block).collect()
    low = list(range(len(prints)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    at = {p: i for i, p in enumerate(prints)}
    for e in edges:
        u, v = e["u"] % 2**64, e["v"] % 2**64
        assert (u ^ v).bit_count() <= 4
        a, b = root(at[u]), root(at[v])
        low[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(prints))] == brute_classes(prints)


def test_groups_beyond_the_matrix_size_are_linked_alike():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    low, width = simhash.segment_bounds()[0]
    x = np.unique(np.array([base ^ (1 << rng.randrange(width, 64)) ^ (1 << rng.randrange(width, 64)) for _ in range(900)], "u8"))
    assert len(x) > simhash.SMALL
    links = simhash._forest(x, 0, simhash.segment_bounds(), 4)
    assert len(links) <= len(x) - 1
    assert all((a ^ b).bit_count() <= 4 for a, b in ((u % 2**64, v % 2**64) for u, v in links))
    assert len(links) == len(x) - 1  # all lie within two bits of the base


def test_classes_and_survivors(docs_of, hard_texts):
    text = " ".join(f"word{i}" for i in range(400))
    rows = list(enumerate(hard_texts)) + [(50, text), (40, text.upper()), (60, text + " end"), (70, "z y x w v u"), (70, "z y x w v u"), (70, text), (None, "only here, no id"), (None, "only here, no id"), (None, text)]
    docs = docs_of(rows)
    got = simhash.near_duplicate_classes(docs).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(t) for _, t in rows]
    low = brute_classes(prints)
    smallest = {}
    for c, (i, _) in zip(low, rows):
        if i is not None:
            smallest[c] = min(i, smallest.get(c, i))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    want = sorted(((i, f"{p:016x}", smallest.get(c)) for (i, _), p, c in zip(rows, prints, low)), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [(r["doc_id"], brute_fingerprint(r["text"])) for r in kept.select("doc_id", "text").collect()]
    classes = [low[prints.index(p)] for _, p in ids]
    assert sorted(classes) == sorted(set(low)), "one row of each class"
    assert all(i == smallest.get(c) for (i, _), c in zip(ids, classes))


def test_empty_table(docs_of):
    docs = docs_of([(1, "a")]).limit(0)
    assert simhash.near_duplicate_classes(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0


def test_an_id_with_texts_of_several_classes_keeps_one_row_of_each(docs_of):
    x, y, z = ("one two three four five six seven", "entirely other words stand in this line here", "and a third text that is like neither of them")
    docs = docs_of([(3, x), (7, x), (7, y), (9, y), (9, z), (9, z), (11, x)])
    kept = simhash.drop_near_duplicates(docs).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == sorted([(3, x), (7, y), (9, z)])
