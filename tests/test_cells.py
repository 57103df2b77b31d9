"""Pairs scored in cells of their keys, against the same pairs scored row by row and by brute force."""

import random

import pyarrow as pa
import pytest
import worlds as W
from pyspark.sql import functions as F

from quadweave.functions import cells
from quadweave.operators import blocking, closures
from quadweave.operators.profiles import full_values, numbered_values, slim_values
from quadweave.plans import matching as M
from quadweave.plans.config import load_config
from quadweave.runtime import cut_lineage

TEXT, CODE, DAY, SIZE = "urn:text", "urn:code", "urn:day", "urn:size"
FIELDS = ["source_a", "source_b", "rank", "group_order", "reason", "feasible", "score", "outcome", "class_a", "class_b", "compared_weight", "evidence"]


def config(**defaults):
    group = lambda t, weight: {
        "id": f"g{t}", "groupLabel": "G", "equivalentTypes": [f"urn:t:{t}", "urn:t:all"], "requiredConcepts": ["text"] if t else [], "properties": {
            "text": {"predicates": [TEXT, "urn:more"], "comparator": "text", "weight": weight},
            "code": {"predicates": [CODE], "comparator": "exact", "weight": 0.7, "blocking": True, "options": {"caseSensitive": t == 0}},
            "day": {"predicates": [DAY], "comparator": "date", "weight": 1.1, "blocking": True, "options": {"partialOverlapScore": 0.4}},
            "size": {"predicates": [SIZE], "comparator": "number", "weight": 0.3, "options": {"tolerance": 1.5}}}}
    return load_config({"defaults": {"threshold": 0.45, "minimumComparedWeight": 1.0, "maxProposalsPerEntity": 3} | defaults, "equivalentGroups": [group(0, 2), group(1, 3)]})


def world(seed, entities=24, sources=3):
    rnd, words = random.Random(seed), ["red", "Blue", "été", "the", "of", "ten", "東京", "sea", "Straße", "x"]
    some = lambda n, make: [make() for _ in range(rnd.choice(n))]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 6))) or rnd.choice(["", "the of", "?!"])
    day = lambda: rnd.choice(["1900", "1901", "1900/1902", "1901-02", "1901-02-03", "1901-02-04", "never"])
    for s in range(sources):
        for n in range(entities):
            iri = f"urn:all:{n}" if n < 2 else f"urn:{s}:{n}"
            for t in rnd.choice([["0"], ["1"], ["1"], ["0", "1"], ["all"], []]):
                yield W.typed(f"src{s}", iri, f"urn:t:{t}")
            for p, n_, make in ((TEXT, [0, 1, 1, 2, 3], text), ("urn:more", [0, 0, 1], text), (CODE, [0, 1, 1, 2], lambda: rnd.choice(["k1", "K1", "k 2", "-"])),
                                (DAY, [0, 1, 2], day), (SIZE, [0, 1, 2], lambda: rnd.choice(["1", "2.5", "7", "NaN", "many"]))):
                yield from (W.quad(f"src{s}", iri, p, v, dtype="string") for v in some(n_, make))


def ended(run):
    rows = run.examined.groupBy(*FIELDS).agg(F.sum("pairs").alias("pairs"))
    return sorted(map(str, rows.collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cells_end_pairs_as_rows_do(spark, seed, monkeypatch):
    """Several values, keys, groups, accents, days and clusters: counts, scores, evidence and proposals."""
    rows, cfg = list(world(seed)), config(compareUntypedEntities=seed == 2)
    links = [W.link(f"l{n}", (f"src{n % 2}", f"urn:{n % 2}:{n}"), ("src2", f"urn:2:{n}"), "ACCEPTED") for n in range(2, 16)]
    quads, links = W.quads(spark, rows).cache(), W.links(spark, links)
    whole, parts = blocking.cell_rows, []
    monkeypatch.setattr(blocking, "cell_rows", lambda *a: parts.append(whole(*a, size=4 if seed < 3 else 1024)) or parts[-1])
    run = M.run_all_pairs(quads, links, cfg)
    assert parts and (seed == 3 or parts[0].where("cell_i < cell_j").count() > 0)
    found, proposals, histogram = ended(run), sorted(map(str, run.proposals.collect())), M.preview_histogram(run).collect()
    summary = M.run_summary(run).collect()
    monkeypatch.setattr(M, "scored_in_cells", lambda cfg, rejected: False)
    plain = M.run_all_pairs(quads, links, cfg)
    assert found == ended(plain) and len(found) > 40 and len(proposals) > 10
    assert proposals == sorted(map(str, plain.proposals.collect()))
    assert histogram == M.preview_histogram(plain).collect() and sorted(summary) == sorted(M.run_summary(plain).collect())
    assert plain.scored.where("reason = 'INVARIANT'").count() > 0


def test_pairs_of_a_key_never_become_rows(spark, monkeypatch):
    """40 x 40 texts of one key: what is scored row by row is nothing; the counts are those of sets of words."""
    rnd = random.Random(5)
    words = {(s, i): {f"w{rnd.randrange(30)}" for _ in range(12)} for s in "ab" for i in range(40)}
    rows = [q for (s, i), w in words.items() for q in (W.typed(s, f"urn:{s}{i}", "urn:D"), W.quad(s, f"urn:{s}{i}", "urn:text", " ".join(w)), W.quad(s, f"urn:{s}{i}", "urn:k", "1"))]
    cfg = {"defaults": {"threshold": 0.5, "minimumComparedWeight": 1.0}, "equivalentGroups": [{"id": "d", "groupLabel": "D", "equivalentTypes": ["urn:D"], "properties": {
        "t": {"predicates": ["urn:text"], "comparator": "text", "weight": 1}, "k": {"predicates": ["urn:k"], "comparator": "exact", "weight": 1, "blocking": True}}}]}
    by_rows, given = M.score_classes, []
    monkeypatch.setattr(M, "score_classes", lambda pairs, cfg: given.append(pairs.count()) or by_rows(pairs, cfg))
    run = M.run_all_pairs(W.quads(spark, rows), W.links(spark, []), load_config(cfg))
    scores = [(len(words["a", i] & words["b", j]) / len(words["a", i] | words["b", j]) + 1) / 2 for i in range(40) for j in range(40)]
    want = [0] * 20
    for s in scores:
        want[min(int(int(s * 10000 + 0.5) / 10000 * 20), 19)] += 1
    assert given == [0] and [r.pairs for r in M.preview_histogram(run).orderBy("bin").collect()] == want


def test_hopeless_pairs_are_scored_where_they_meet(spark, monkeypatch):
    """Pairs without the required text have a place in the histogram and are not formed a second time for it."""
    rows = [q for s in "ab" for i in range(6) for q in (W.typed(s, f"urn:{s}{i}", "urn:D"), W.quad(s, f"urn:{s}{i}", "urn:l", "x" if i % 2 else s), W.quad(s, f"urn:{s}{i}", "urn:k", "1"))]
    cfg = {"defaults": {"minimumComparedWeight": 1.0}, "equivalentGroups": [{"id": "d", "groupLabel": "D", "equivalentTypes": ["urn:D"], "requiredConcepts": ["t"], "properties": {
        "t": {"predicates": ["urn:text"], "comparator": "text", "weight": 3}, "l": {"predicates": ["urn:l"], "comparator": "exact", "weight": 1},
        "k": {"predicates": ["urn:k"], "comparator": "exact", "weight": 1, "blocking": True}}}]}
    run = M.run_all_pairs(W.quads(spark, rows), W.links(spark, []), load_config(cfg))
    monkeypatch.setattr(M, "score_pairs", None)
    assert {r.bin: r.pairs for r in M.preview_histogram(run).collect() if r.pairs} == {10: 27, 19: 9}
    assert M.run_summary(run).first().insufficient_evidence == 36
    assert [r.score for r in run.examined.select("score").distinct().collect()] == [None]


def test_values_of_an_entity_move_once(spark):
    """Values are told apart, numbered and brought together after one exchange, which holds a literal's text once."""
    rows = [q for i in range(5) for q in (W.typed("a", f"urn:{i}", "urn:D"), W.quad("a", f"urn:{i}", "urn:k", f"no {i}"), W.quad("a", f"urn:{i}", "urn:text", "long"))]
    cfg = load_config({"equivalentGroups": [{"id": "d", "groupLabel": "D", "equivalentTypes": ["urn:D"], "properties": {"t": {"predicates": ["urn:text", "urn:k"], "comparator": "text"}}}]})
    expanded = cut_lineage(closures.expanded_groups(spark, cfg))
    values = numbered_values(slim_values(M.ranked_values(W.quads(spark, rows), cfg, expanded)))
    got = full_values(values).groupBy("source", "iri").agg(F.array_sort(F.collect_list(F.struct("pos", "cv.text", "cv.display"))).alias("v"))
    assert {r.iri: [tuple(v) for v in r.v] for r in got.collect()} == {f"urn:{i}": [(1, "long", "long"), (2, f"no {i}", f"no {i}")] for i in range(5)}
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(source") == 1
    assert values.where("cv.text is not null or cv.display is not null").count() == 0


def batch(rows):
    """Rows of one group: (key, cell, part, id, source, size, text)."""
    empty = dict(word=None, start=None, end=None, precise=None, number=None)
    at = lambda s: '{"source":"%s","groups":[1],"primary":[1],"untyped":false,"sources_in_cluster":["%s"]}' % (s, s)
    full = [dict(rank=1, key=k, cell_i=c[0], cell_j=c[1], part=p, class_id=i, source=s, situation=at(s), n=n, earlier=[],
                 values=[dict(empty, c=0, pos=1, words=t)]) for k, c, p, i, s, n, t in rows]
    value = pa.struct([("c", pa.int32()), ("pos", pa.int32()), ("word", pa.string()), ("words", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("precise", pa.bool_()), ("number", pa.float64())])
    schema = pa.schema([("rank", pa.int32()), ("key", pa.string()), ("cell_i", pa.int32()), ("cell_j", pa.int32()), ("part", pa.int32()), ("class_id", pa.string()),
                        ("source", pa.string()), ("situation", pa.string()), ("n", pa.int64()), ("earlier", pa.list_(pa.string())), ("values", pa.list_(value))])
    return pa.Table.from_pylist(full, schema)


def test_cells_go_on_over_batches_and_many_words(monkeypatch):
    """Batches cut anywhere, more words than one product holds, counts handed on in between: the same sums."""
    rnd = random.Random(8)
    rows = [(f"k{k:02}", (0, 0), 0, f"c{k}-{i}", rnd.choice("abc"), rnd.randrange(1, 4), " ".join(sorted({f"v{rnd.randrange(40)}" for _ in range(9)}))) for k in range(12) for i in range(rnd.choice([1, 2, 5, 90]))]
    rows += [("m", (i, j), p, f"m{p}{n}", "ab"[n % 2], 1, f"v1 x{n} v3") for i, j in ((0, 0), (0, 1), (1, 1)) for p in sorted({i, j}) for n in range(4)]
    rules = {1: cells.Rules(0, [("t", "text", 1.0, False, 0.85, 0.0)], [], 0.5, 0.8)}
    want = {}
    for n, x in enumerate(rows):
        for y in rows[n + 1:]:
            if x[:2] == y[:2] and x[4] != y[4] and (x[1][0] == x[1][1] or x[2] != y[2]):
                u, v = set(x[6].split()), set(y[6].split())
                score = int(len(u & v) / len(u | v) * 10000 + 0.5) / 10000
                key = (*sorted((x[4], y[4])), score, "PROPOSABLE" if score >= 0.8 else "BELOW_THRESHOLD")
                want[key] = want.get(key, 0) + x[5] * y[5]
    for size, words, most in ((10_000, 2048, 400_000), (7, 3, 50), (64, 16, 1)):
        monkeypatch.setattr(cells, "_WORDS", words)
        monkeypatch.setattr(cells, "_ENDED", most)
        got = {}
        for b in cells.scorer(rules)(batch(rows).to_batches(max_chunksize=size)):
            for r in b.to_pylist():
                key = (r["source_a"], r["source_b"], r["score"], r["outcome"])
                got[key] = got.get(key, 0) + r["pairs"]
        assert got == want and len(got) > 30
