"""Decisions in bulk against the plainest replay: clusters are worked out anew before every decision."""

import random

import pytest
import worlds as W
from pyspark.sql import functions as F

from quadweave.operators import links as L
from quadweave.operators.clusters import build_clusters, conflicts, inference_chain, same_as
from quadweave.operators.patterns import identical_iris
from quadweave.vocab import CONFIRMED

ACTIONS = ["ACCEPT"] * 5 + ["REJECT"] * 2 + ["UNDO"] * 2 + ["LINK"] * 2


def chains(identical):
    return [((s, iri), (t, iri)) for iri, sources in identical.items() for s, t in zip(sources, sources[1:])]


def one_by_one(rows, identical, decisions):
    """(state, results): {id: {status, origin, note}} of what is left, and (result, reason) of every decision."""
    state = {r[0]: {"a": (r[1], r[2]), "b": (r[5], r[6]), "status": r[9], "origin": r[10], "note": r[-1]} for r in rows}
    results = []

    def group(without=None):
        confirmed = [(x["a"], x["b"]) for k, x in state.items() if x["status"] in CONFIRMED and k != without]
        nodes = [n for x in state.values() for n in (x["a"], x["b"])]
        return W.components(nodes, chains(identical) + confirmed)

    def forbidden(lid, x):
        g = group()
        a, b = g[x["a"]], g[x["b"]]
        if a == b:
            return None
        if {s for s, _ in a} & {s for s, _ in b}:
            return "TWO_IN_SOURCE"
        apart = [(g[y["a"]], g[y["b"]]) for k, y in state.items() if y["status"] == "REJECTED" and k != lid]
        return "REJECTED" if (a, b) in apart or (b, a) in apart else None

    for lid, action, note in decisions:
        x = state.get(lid)
        if x is None:
            results.append(("refused", "NOT_FOUND"))
            continue
        status, mine = x["status"], x["origin"] == "USER"
        reason, to = None, None
        if status == "INFERRED":
            reason = "INFERRED"
        elif action == "ACCEPT":
            if status not in CONFIRMED:
                reason, to = forbidden(lid, x), "MANUAL" if mine else "ACCEPTED"
        elif action == "LINK":
            if status in CONFIRMED:
                reason = "ALREADY_LINKED"
            else:
                reason, to = forbidden(lid, x), "MANUAL" if mine or status != "PROPOSED" else "ACCEPTED"
        elif action == "REJECT":
            if status != "REJECTED":
                g = group(without=lid)
                reason, to = "STILL_LINKED" if status in CONFIRMED and g[x["a"]] == g[x["b"]] else None, "REJECTED"
        elif status == "PROPOSED":
            reason = "NOT_REVIEWED"
        else:
            to = "GONE" if mine else "PROPOSED"
        results.append(("refused", reason) if reason else ("applied", None) if to else ("unchanged", None))
        if note is not None:
            x["note"] = note.strip() or None
        if to and not reason:
            if action == "LINK" and status != "PROPOSED":
                x["origin"] = "USER"
            if action == "UNDO":
                x["origin"] = "ALGORITHM"
            x["status"] = to
            if to == "GONE":
                del state[lid]
    return state, results


def decide(spark, decisions):
    return spark.createDataFrame([(n, *d) for n, d in enumerate(decisions)], "ord int, id string, action string, note string")


def random_decisions(seed, ids, n, actions=ACTIONS):
    rnd = random.Random(seed)
    return [(rnd.choice(ids), rnd.choice(actions), rnd.choice([None, None, None, " why ", "  "])) for _ in range(n)]


@pytest.mark.parametrize("seed,entities,n_links,n,limit", [(1, 40, 160, 1000, 200_000), (2, 12, 40, 40, 60), (3, 4, 12, 6, 4)])
def test_any_sequence_equals_one_by_one(spark, seed, entities, n_links, n, limit):
    """All actions and statuses; regions replayed whole, by their first decisions, and by joins."""
    world = W.World(seed, sources=5, entities=entities)
    rows = world.random_links(n_links, ["PROPOSED"] * 5 + ["REJECTED", "INFERRED"], ["ALGORITHM", "ALGORITHM", "USER"])
    decisions = random_decisions(seed, [r[0] for r in rows] + ["nowhere"], n)
    identical = identical_iris(world.quads(spark))
    assert {r.iri: sorted(r.sources) for r in identical.collect()} == world.identical()
    out = L.apply_decisions(W.links(spark, rows), decide(spark, decisions), identical, now="2026-01-01 00:00:00", limit=limit)
    state, results = one_by_one(rows, world.identical(), decisions)
    got = {r.id: (r.status, r.origin, r.note) for r in out.links.collect()}
    assert got == {k: (x["status"], x["origin"], x["note"]) for k, x in state.items()}
    assert [(r.result, r.reason) for r in out.report.orderBy("ord").collect()] == results
    dated = {r.id for r in out.links.where("decided_at is not null").collect()}
    assert dated >= {k for k, x in state.items() if x["status"] in CONFIRMED}
    # The clusters that are kept are those of the new links.
    fresh = build_clusters(out.links, identical)
    assert sorted(map(tuple, out.clusters.collect())) == sorted(map(tuple, fresh.collect()))
    # Starting from consistent links no sequence makes them inconsistent.
    assert conflicts(out.clusters, out.links).where("kind = 'SAME_SOURCE_IN_CLUSTER'").count() == 0
    assert out.revoked == (out.revocations.count() > 0)


def test_a_second_batch_goes_on_from_kept_clusters(spark):
    world = W.World(7, sources=4, entities=15)
    rows = world.random_links(60)
    ids, identical = [r[0] for r in rows], identical_iris(world.quads(spark))
    one, two = random_decisions(1, ids, 80), random_decisions(2, ids, 80)
    first = L.apply_decisions(W.links(spark, rows), decide(spark, one), identical)
    second = L.apply_decisions(first.links, decide(spark, two), identical, clusters=first.clusters)
    state, _ = one_by_one(rows, world.identical(), one + two)
    assert {r.id: r.status for r in second.links.collect()} == {k: x["status"] for k, x in state.items()}


def test_undoing_everything_restores_the_table(spark):
    world = W.World(5, sources=4, entities=10)
    rows = world.random_links(40)
    identical = identical_iris(world.quads(spark))
    links = W.links(spark, rows)
    done = L.apply_decisions(links, decide(spark, [(r[0], a, None) for r, a in zip(rows, ["ACCEPT", "REJECT"] * 20)]), identical)
    back = L.undo(done.links, links.select("id"), identical)
    columns = ["id", "status", "origin", "decided_at", "note"]
    assert back.links.select(columns).exceptAll(links.select(columns)).count() == 0
    assert {r.id for r in back.revocations.collect()} == {r.id for r in done.links.where("status = 'ACCEPTED'").collect()}


def test_a_hub_is_settled_in_one_pass(spark):
    """A long queue on one cluster: passes do not grow with it."""
    rows = [W.link(f"h{i:03d}", ("a", "urn:hub"), (f"s{i % 150:03d}", f"urn:e{i}"), "PROPOSED") for i in range(300)]
    none = spark.createDataFrame([], "iri string, sources array<string>")
    out = L.apply_decisions(W.links(spark, rows), decide(spark, [(r[0], "ACCEPT", None) for r in rows]), none)
    assert {r.id for r in out.links.where("status = 'ACCEPTED'").collect()} == {r[0] for r in rows[:150]}
    assert {r.reason for r in out.report.where("result = 'refused'").collect()} == {"TWO_IN_SOURCE"}


def test_inferred_links_and_same_as_follow_the_clusters(spark):
    """After a dry run every two entities of different sources in a cluster have exactly one link."""
    world = W.World(9, sources=5, entities=14)
    rows = world.random_links(60)
    quads, links = world.quads(spark), W.links(spark, rows)
    identical = identical_iris(quads)
    decisions = decide(spark, random_decisions(4, [r[0] for r in rows], 70, ["ACCEPT"] * 4 + ["REJECT"]))
    out = L.dry_run(links, lambda x: L.apply_decisions(x, decisions, identical), identical)
    state, _ = one_by_one(rows, world.identical(), [(d.id, d.action, None) for d in decisions.orderBy("ord").collect()])
    groups = set(W.components([], chains(world.identical()) + [(x["a"], x["b"]) for x in state.values() if x["status"] in CONFIRMED]).values())
    want = {tuple(sorted((a, b))) for g in groups for a in g for b in g if a[0] != b[0] and a[1] != b[1]}
    linked = [((r.source_a, r.iri_a), (r.source_b, r.iri_b)) for r in out["links"].where("status in ('ACCEPTED', 'MANUAL', 'INFERRED')").collect()]
    assert sorted(linked) == sorted(want)
    clusters = build_clusters(out["links"], identical)
    pairs = {(a[1], b[1]) for g in groups for a in g for b in g if a[1] != b[1]}
    assert {(r.s, r.o) for r in same_as(clusters).collect()} == pairs
    # Each inferred link is explained by confirmed links and identical IRIs only.
    known = {k for k, x in state.items() if x["status"] in CONFIRMED}
    for r in inference_chain(out["links"], clusters, identical).collect():
        assert r.kind != "link" or r.link_id in known


def test_manual_links(spark):
    """Requests in any direction, to entities that are missing, of one source, or linked already."""
    world = W.World(12, sources=4, entities=8)
    rows, rnd = world.random_links(20, ["PROPOSED", "PROPOSED", "REJECTED"]), random.Random(3)
    quads, identical = world.quads(spark), identical_iris(world.quads(spark))
    nodes = sorted(world.facts) + [("src0", "urn:nobody")]
    wanted = {}
    while len(wanted) < 30:
        wanted[tuple(sorted(rnd.sample(nodes, 2)))] = None
    wanted = [p if rnd.random() < 0.5 else p[::-1] for p in wanted]
    asked = spark.createDataFrame([(n, *a, *b) for n, (a, b) in enumerate(wanted)], "ord int, source_a string, iri_a string, source_b string, iri_b string")
    out = L.add_manual_links(W.links(spark, rows), asked, quads, identical)
    by_ends = {((r[1], r[2]), (r[5], r[6])): r for r in rows}
    all_rows, todo, expected = list(rows), [], {}
    for n, ends in enumerate(wanted):
        a, b = sorted(ends)
        if a[0] == b[0] or a not in world.facts or b not in world.facts:
            expected[n] = ("refused", "SAME_SOURCE" if a[0] == b[0] else "NO_STATEMENT")
            continue
        if (a, b) not in by_ends:
            by_ends[a, b] = W.link(f"new{n}", a, b, "NEW", "USER")
            all_rows.append(by_ends[a, b])
        todo.append((n, by_ends[a, b][0]))
    state, results = one_by_one(all_rows, world.identical(), [(lid, "LINK", None) for _, lid in todo])
    expected |= {n: r for (n, _), r in zip(todo, results)}
    assert {r.ord: (r.result, r.reason) for r in out.report.collect()} == expected
    want = sorted((x["a"], x["b"], x["status"]) for x in state.values() if x["status"] != "NEW")
    assert sorted(((r.source_a, r.iri_a), (r.source_b, r.iri_b), r.status) for r in out.links.collect()) == want


def test_orphans(spark):
    world = W.World(15)
    rows = world.random_links(30, ["PROPOSED", "ACCEPTED", "INFERRED"])
    lost = sorted(world.facts)[::4]
    gone = spark.createDataFrame(lost, "source string, s string")
    quads = world.quads(spark).join(gone, ["source", "s"], "left_anti")
    hit = {r[0] for r in rows if (r[1], r[2]) in lost or (r[5], r[6]) in lost}
    assert {r.id for r in L.orphans(W.links(spark, rows), quads).where("orphan_a or orphan_b").collect()} == hit
    left, removed, revoked = L.remove_orphans(W.links(spark, rows), quads)
    out = {r[0] for r in rows if r[0] in hit and r[9] != "INFERRED"}
    assert {r.id for r in removed.collect()} == out and left.count() == len(rows) - len(out)
    assert revoked == any(r[0] in out and r[9] == "ACCEPTED" for r in rows)


def test_superseded_proposals(spark):
    """A proposal is superseded if it cannot be confirmed any more and an end is linked."""
    world = W.World(21, sources=4, entities=6)
    rows = world.random_links(30)
    identical = identical_iris(world.quads(spark))
    decisions = random_decisions(8, [r[0] for r in rows], 14, ["ACCEPT", "ACCEPT", "REJECT"])
    out = L.apply_decisions(W.links(spark, rows), decide(spark, decisions), identical)
    state, _ = one_by_one(rows, world.identical(), decisions)
    left = [(k, *x["a"], None, None, *x["b"], None, None, x["status"], x["origin"], *[None] * 8) for k, x in state.items()]
    want = set()
    nodes = [n for x in state.values() for n in (x["a"], x["b"])]
    g = W.components(nodes, chains(world.identical()) + [(x["a"], x["b"]) for x in state.values() if x["status"] in CONFIRMED])
    for k, x in state.items():
        if x["status"] == "PROPOSED":
            _, [(result, _)] = one_by_one(left, world.identical(), [(k, "ACCEPT", None)])
            if result == "refused" and (len(g[x["a"]]) > 1 or len(g[x["b"]]) > 1):
                want.add(k)
    flags = L.link_flags(out.links, out.clusters, world.quads(spark))
    assert {r.id for r in flags.where("superseded").collect()} == want


def test_accepting_in_bulk_takes_the_best_first(spark):
    world = W.World(31, sources=3, entities=6)
    rows = world.random_links(40)
    identical = identical_iris(world.quads(spark))
    out = L.accept_above(W.links(spark, rows), identical, 0.5)
    order = sorted((r for r in rows if r[12] >= 0.5), key=lambda r: (-r[12], r[0]))
    state, _ = one_by_one(rows, world.identical(), [(r[0], "ACCEPT", None) for r in order])
    assert {r.id: r.status for r in out.links.collect()} == {k: x["status"] for k, x in state.items()}
    noted = L.annotate(out.links, spark.createDataFrame([(rows[0][0], " seen "), (rows[1][0], " ")], "id string, note string"))
    assert {r.id: r.note for r in noted.where("note is not null").collect()} == {rows[0][0]: "seen"}
    assert out.links.where(F.col("status").isin(*CONFIRMED)).count() > 0
