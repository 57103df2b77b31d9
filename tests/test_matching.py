"""Matching runs over random worlds, against scores and rankings worked out from their definitions."""

from collections import Counter

import pytest
import worlds as W
from pyspark.sql import functions as F

from quadweave.operators import links as L
from quadweave.operators.clusters import build_clusters
from quadweave.operators.patterns import identical_iris, list_by_types
from quadweave.operators.search import resolve_names
from quadweave.plans import matching as M
from quadweave.plans.branch_queries import _by_kind
from quadweave.plans.config import config_hash, load_config
from quadweave.runtime import cut_lineage
from quadweave.sources.tables import record_import


@pytest.fixture(scope="module")
def run(spark):
    world = W.World(41, sources=2, entities=30)
    links = world.random_links(12, ["ACCEPTED", "REJECTED", "REJECTED", "PROPOSED"])
    return world, links, M.run_matching(world.quads(spark), W.links(spark, links), load_config(world.config()), "src1", "src0")


def test_proposals_equal_the_exhaustive_ranking(run):
    world, links, found = run
    assert {(r.iri_a, r.iri_b): r.score for r in found.proposals.collect()} == W.proposals(world, "src0", "src1", links)
    for r in found.proposals.collect():
        f, g = world.facts["src0", r.iri_a], world.facts["src1", r.iri_b]
        for e in r.evidence:
            key = {"label": W.LABEL, "year": W.YEAR, "code": W.CODE}[e.concept]
            shown = lambda facts: [v if isinstance(v, str) else v[0] for v in facts[key]]
            assert e.value_a in shown(f) and e.value_b in shown(g)
        assert abs(sum(e.weight * e.score for e in r.evidence) / sum(e.weight for e in r.evidence) - r.score) < 2e-4


def test_counters_add_up(run):
    world, links, found = run
    row = M.run_summary(found).first()
    typed = lambda s, t: [k for k, f in world.facts.items() if k[0] == s and f["type"] == t]
    possible = sum(len(typed("src0", t)) * len(typed("src1", t)) for t in ("urn:t:0", "urn:t:1"))
    matched = W.components(world.facts, [((x[1], x[2]), (x[5], x[6])) for x in links if x[9] == "ACCEPTED"] + [(("src0", i), ("src1", i)) for i in world.identical()])
    crossing = [n for n, g in matched.items() if len({s for s, _ in g}) > 1]
    assert row.identical_iris == len(world.identical())
    assert (row.excluded_matched_a, row.excluded_matched_b) == tuple(sum(n[0] == s for n in crossing) for s in ("src0", "src1"))
    assert row.compared_pairs <= possible and row.compared_pairs >= row.below_threshold + row.insufficient_evidence + row.proposals
    assert row.proposals == len(W.proposals(world, "src0", "src1", links))


def test_compare_pair_explains_every_proposal(spark, run):
    world, links, found = run
    pairs = cut_lineage(found.proposals.orderBy("iri_a", "iri_b").limit(4).select("source_a", "iri_a", "source_b", "iri_b"))
    out = cut_lineage(L.compare_pairs(pairs, world.quads(spark), W.links(spark, links), load_config(world.config())))
    scores = {(r.iri_a, r.iri_b): r.score for r in out.collect()}
    want = W.proposals(world, "src0", "src1", links)
    assert scores == {k: want[k] for k in sorted(want)[:4]} and {r.blocking for r in out.collect()} == {None}


def test_agreement_with_decisions(spark):
    """Decided links by the side of the threshold on which their present score lies."""
    world = W.World(43, sources=2, entities=25, types=1)
    links = world.random_links(30, ["ACCEPTED", "REJECTED"])
    quads = world.quads(spark)
    clusters = build_clusters(W.links(spark, links), identical_iris(quads))
    counts, rows = M.decision_agreement(W.links(spark, links), quads, load_config(world.config()), clusters)
    scored = {x[0]: W.score(world.facts[x[1], x[2]], world.facts[x[5], x[6]]) for x in links}
    above = {k for k, s in scored.items() if s and s[1] >= 2.0 and s[0] >= 0.6}
    surprising = {x[0] for x in links if (x[9] == "ACCEPTED") != (x[0] in above)}
    got = rows.collect()
    known = {r.id for r in got}
    assert {r.id for r in got if r.surprising} == surprising & known and known >= above
    assert sum(r.links for r in counts.collect()) == len(got)


def test_every_value_of_a_concept_is_compared(spark):
    """The 25th of 25 names decides, and so does a year deep inside a long interval."""
    entity = lambda source, iri, *facts: [W.typed(source, iri, "urn:T"), *(W.quad(source, iri, p, o, dtype=d) for p, o, d in facts)]
    rows = entity("a", "urn:a", *[("urn:n", f"name number {i}", "string") for i in range(24)], ("urn:n", "zz the very one", "string"), ("urn:d", "1950", "gYear"))
    rows += entity("b", "urn:b", ("urn:n", "zz the very one", "string"), ("urn:d", "1930/1980", "string"))
    rows += entity("b", "urn:c", ("urn:n", "ab cd", "string")) + entity("a", "urn:x", ("urn:n", "cd ab", "string"))
    cfg = {"defaults": {"minimumComparedWeight": 1.0}, "equivalentGroups": [{"id": "t", "groupLabel": "T", "equivalentTypes": ["urn:T"], "properties": {
        "n": {"predicates": ["urn:n"], "comparator": "name", "weight": 1, "blocking": True}}}]}
    run = M.run_matching(W.quads(spark, rows), W.links(spark, []), load_config(cfg), "a", "b")
    assert {f"{r.iri_a}|{r.iri_b}": r.score for r in run.proposals.collect()} == {"urn:a|urn:b": 1.0, "urn:x|urn:c": 1.0}


def test_run_records_tell_what_is_stale(spark, run):
    world, links, found = run
    cfg = load_config(world.config())
    runs = M.run_record(found, "2026-01-02 03:04:05", "2026-01-02 03:04:07.5")
    row = runs.first()
    assert (row.duration_ms, row.configuration_hash, row.proposals) == (2500, config_hash(cfg), len(W.proposals(world, "src0", "src1", links)))
    sources = spark.createDataFrame([("src0", None), ("src1", None)], "short_name string, last_change timestamp")
    pairs = runs.select("source_a", "source_b", "started_at", "configuration_hash")
    stale = lambda s, at=None: L.stale_reasons(pairs, s, config_hash(cfg), at).first().stale
    assert stale(sources) == [] and stale(record_import(sources, "src0", "2026-01-01 00:00:00")) == []
    assert stale(record_import(sources, "src0", "2026-02-01 00:00:00")) == ["dataChanged"]


def test_a_revoked_decision_makes_runs_stale(spark, run):
    """From the decision to the reason: the time of the last revocation is a row of the outcome."""
    world, links, found = run
    cfg, table = load_config(world.config()), W.links(spark, links)
    pairs = M.run_record(found, "2026-01-02 03:04:05", "2026-01-02 03:04:06").select("source_a", "source_b", "started_at", "configuration_hash")
    sources = spark.createDataFrame([("src0", None), ("src1", None)], "short_name string, last_change timestamp")
    stale = lambda when: L.stale_reasons(pairs, sources, config_hash(cfg), when).first().stale
    identical = identical_iris(world.quads(spark))
    undone = L.undo(table, table.where("status = 'ACCEPTED'").select("id"), identical, now="2026-01-03 00:00:00")
    assert stale(L.last_revocation(undone.revocations)) == ["decisionsRevoked"]
    kept = L.undo(table, table.where("status = 'REJECTED'").select("id"), identical, now="2026-01-03 00:00:00")
    assert stale(L.last_revocation(kept.revocations)) == []


def test_types_with_their_subclasses(spark):
    edges = spark.createDataFrame([("urn:Author", "urn:Human"), ("urn:Poet", "urn:Author")], "sub string, super string")
    rows = [W.typed("x", "urn:1", "urn:Poet"), W.quad("x", "urn:1", W.LABEL, "Ada Verse"), W.typed("x", "urn:2", "urn:Town"), W.quad("x", "urn:2", W.LABEL, "Ada Verse")]
    quads = W.quads(spark, rows)
    assert list_by_types(quads, ["urn:Human"]).count() == 0
    assert [r.s for r in list_by_types(quads, ["urn:Human"], edges=edges).collect()] == ["urn:1"]
    q = spark.createDataFrame([("q", "ada verse")], "query_id string, text string")
    found = resolve_names(quads, q, ["urn:Human"], edges).first()
    assert (found.status, found.iri) == ("resolved", "urn:1")


def test_pairs_that_end_alike_are_one_row(spark):
    """40 x 40 different texts of one key: 1,600 scored pairs, and no row or moved list of words for each."""
    doc = lambda s, i, text: [W.typed(s, f"urn:{s}{i}", "urn:D"), W.quad(s, f"urn:{s}{i}", "urn:text", text), W.quad(s, f"urn:{s}{i}", "urn:k", "1")]
    rows = [q for s in "ab" for i in range(40) for q in doc(s, i, f"common words {s}{i if i else ''}")]
    cfg = {"defaults": {"threshold": 0.9, "minimumComparedWeight": 1.0}, "equivalentGroups": [{"id": "d", "groupLabel": "D", "equivalentTypes": ["urn:D"], "properties": {
        "t": {"predicates": ["urn:text"], "comparator": "text", "weight": 1}, "k": {"predicates": ["urn:k"], "comparator": "exact", "weight": 1, "blocking": True}}}]}
    run = M.run_all_pairs(W.quads(spark, rows), W.links(spark, []), load_config(cfg))
    ended = run.examined.collect()
    assert sum(r.pairs for r in ended) == M.run_summary(run).first().below_threshold == 1600 and len(ended) < 10
    assert sum(r.pairs for r in M.preview_histogram(run).collect()) == 1600


def test_a_pair_under_several_keys_counts_once(spark):
    """Typed and untyped entities with two words in common: one pair each, however many keys they share."""
    rows = [W.typed("a", "urn:a", "urn:T"), W.quad("a", "urn:a", "urn:n", "red blue"), W.typed("b", "urn:b", "urn:T"), W.quad("b", "urn:b", "urn:n", "blue red")]
    rows += [W.quad("b", "urn:u", "urn:n", "blue red one")]
    cfg = {"compareUntypedEntities": True, "defaults": {"minimumComparedWeight": 1.0}, "equivalentGroups": [{"id": "t", "groupLabel": "T", "equivalentTypes": ["urn:T"], "properties": {
        "n": {"predicates": ["urn:n"], "comparator": "name", "weight": 1, "blocking": True}}}]}
    loaded = load_config(cfg)
    assert M.run_summary(M.run_all_pairs(W.quads(spark, rows), W.links(spark, []), loaded)).first().compared_pairs == (2 if loaded.compare_untyped else 1)


def test_proposals_are_dealt_out_by_their_number(spark):
    """A few classes of many entities: no task makes more than its share of proposals, and none is made twice."""
    names = ["alma", "alma b", "alma", "alba"]
    rows = [q for n, s in enumerate("abc") for i in range(60) for q in (W.typed(s, f"urn:{s}{i:02}", "urn:T"), W.quad(s, f"urn:{s}{i:02}", "urn:n", names[(i + n) % 4]))]
    cfg = {"defaults": {"threshold": 0.6, "minimumComparedWeight": 1.0, "maxProposalsPerEntity": 2}, "equivalentGroups": [{"id": "t", "groupLabel": "T", "equivalentTypes": ["urn:T"], "candidates": "all", "properties": {
        "n": {"predicates": ["urn:n"], "comparator": "name", "weight": 1, "blocking": True}}}]}
    run = M.run_all_pairs(W.quads(spark, rows), W.links(spark, []), load_config(cfg))
    made = M.keep_best_proposals(run.examined.where("outcome = 'PROPOSABLE'"), run.members, 2, target=20)
    got = made.withColumn("task", F.spark_partition_id()).collect()
    name = {f"urn:{s}{i:02}": names[(i + n) % 4] for n, s in enumerate("abc") for i in range(60)}
    want = set()
    for s, t in ("ab", "ac", "bc"):
        pairs = [(x, y, W.name_score(name[x], name[y])) for x in name if x[4] == s for y in name if y[4] == t]
        pairs = [p for p in pairs if p[2] >= 0.6]
        for side in (0, 1):
            for e in {p[side] for p in pairs}:
                want |= {(s, x, t, y) for x, y, _ in sorted((p for p in pairs if p[side] == e), key=lambda p: (-p[2], p[1 - side]))[:2]}
    assert len(got) == len(want) and {(r.source_a, r.iri_a, r.source_b, r.iri_b) for r in got} == want
    assert max(Counter(r.task for r in got).values()) <= len(want) / 4


def test_kinds_are_not_broadcast(spark):
    """A table with a row per part is small as a file only."""
    rows = [W.quad("catalog", f"urn:part:{i}", p, o) for i in range(3) for p, o in (("urn:p:kind", f"K{i % 2}"), ("urn:n", "x"))]
    got = _by_kind(W.quads(spark, rows))
    assert {(r.s, r.p, r.source) for r in got.collect()} == {(f"urn:part:{i}", p, f"K{i % 2}") for i in range(3) for p in ("urn:p:kind", "urn:n")}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
