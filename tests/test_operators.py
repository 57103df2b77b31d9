import worlds as W
from pyspark.sql import functions as F

from quadweave.operators import clusters as C, links as L, patterns as P, search as Q, stats as A, tabular, updates as U
from quadweave.plans import matching as M
from quadweave.plans.config import load_config


def test_refresh_fills_labels_and_removes_what_is_unsupported(spark):
    world = W.World(51, sources=3, entities=8)
    rows = world.random_links(25, ["PROPOSED", "ACCEPTED", "INFERRED"])
    quads, links = world.quads(spark), W.links(spark, rows)
    held = {}
    for (_, iri), f in world.facts.items():
        held.setdefault(iri, []).extend(f[W.LABEL])
    for r in L.fill_snapshots(links, quads).collect():
        for source, iri, label, types in ((r.source_a, r.iri_a, r.label_a, r.types_a), (r.source_b, r.iri_b, r.label_b, r.types_b)):
            assert types == [world.facts[source, iri]["type"]]
            assert label in held[iri] if held[iri] else label is None
    after, same = C.refresh_links(links, quads)
    chains = [((s, iri), (t, iri)) for iri, sources in world.identical().items() for s, t in zip(sources, sources[1:])]
    groups = set(W.components([], chains + [((r[1], r[2]), (r[5], r[6])) for r in rows if r[9] == "ACCEPTED"]).values())
    assert {(r.s, r.o) for r in same.collect()} == {(a[1], b[1]) for g in groups for a in g for b in g if a[1] != b[1]}
    linked = [((r.source_a, r.iri_a), (r.source_b, r.iri_b)) for r in after.where("status in ('ACCEPTED', 'INFERRED')").collect()]
    assert sorted(linked) == sorted({tuple(sorted((a, b))) for g in groups for a in g for b in g if a[0] != b[0] and a[1] != b[1]})


def test_picker_and_texts(spark):
    world = W.World(53, sources=2, entities=20)
    quads = world.quads(spark)
    rows = world.random_links(6, ["ACCEPTED"])
    clusters = C.build_clusters(W.links(spark, rows), P.identical_iris(quads))
    found = L.search_matchable(M.profiles(quads, load_config(world.config())), "src0", clusters, q="", unmatched_with="src1").collect()
    chains = [((s, iri), (t, iri)) for iri, held in world.identical().items() for s, t in zip(held, held[1:])]
    group = W.components(world.facts, chains + [((r[1], r[2]), (r[5], r[6])) for r in rows])
    assert {r.iri for r in found} == {n[1] for n, g in group.items() if n[0] == "src0" and all(s == "src0" for s, _ in g)}
    labels = [r.label for r in found]
    assert labels == sorted(labels, key=lambda x: x is None or x == "") or None in labels
    (source, iri), f = next((k, f) for k, f in world.facts.items() if len(f[W.LABEL]) == 1 and not k[1].startswith("urn:all"))
    t = spark.createDataFrame([("t", f"select <{iri}> a <urn:p:Other>")], "text_id string, text string")
    assert [(r.iri, r.label) for r in Q.entities_in_text(t, quads, ["urn:p:"]).collect()] == [(iri, f[W.LABEL][0])]
    hits = spark.createDataFrame([(W.CODE, 1)], "p string, hit_rank int")
    assert {r.p for r in A.find_usage(quads, "year", term_hits=hits).collect()} == {W.YEAR, W.CODE}


def test_updates(spark):
    world = W.World(55)
    quads = world.quads(spark)
    chosen = [k for k, f in sorted(world.facts.items()) if k[0] == "src1"][:5]
    ch = spark.createDataFrame([(iri, W.LABEL, f"new {iri}") for _, iri in chosen], "s string, p string, o string")
    for change, old in ((U.add_values(quads, ch, "src1", "2026-01-01T00:00:00Z"), True), (U.rename(quads, ch.select("s", "o"), "src1", "2026-01-01T00:00:00Z", W.LABEL), False)):
        got = {}
        for r in change.where(F.col("p") == W.LABEL).collect():
            got.setdefault((r.source, r.s), set()).add(r.o)
        for k, f in world.facts.items():
            want = {f"new {k[1]}"} | (set(f[W.LABEL]) if old else set()) if k in chosen else set(f[W.LABEL])
            assert got.get(k, set()) == want


def test_long_tables(spark):
    cols = "entity string, property string, value string, typevalue string"
    a = spark.createDataFrame([("a1", "rdf:type", "T", "iri"), ("a1", "name", "Marie Lefebvre", "string"), ("a1", "born", "1948", "date"),
                               ("a2", "rdf:type", "T", "iri"), ("a2", "name", "Jean", "string")], cols)
    b = spark.createDataFrame([("b1", "rdf:type", "T", "iri"), ("b1", "name", "marie lefevre", "string"), ("b1", "born", "1948-11-02", "date"),
                               ("b2", "rdf:type", "U", "iri"), ("b2", "name", "Jean", "string")], cols)
    rows = tabular.match_tables(a, b, [["T"], ["U"]]).collect()
    assert [(r.source_entity, r.target_entity, r.score) for r in rows] == [("a1", "b1", (96 + 85) / 2)]
