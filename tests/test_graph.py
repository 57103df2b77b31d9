import random

import worlds as W
from pyspark.sql import functions as F

from quadweave.operators import closures, clusters as C
from quadweave.operators.patterns import identical_iris
from quadweave.plans import matching as M
from quadweave.plans.config import config_hash, load_config, validate_config
from quadweave.runtime import skew_safe_join


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(80)}") for _ in range(60)] + [("hub", f"h{i}") for i in range(50)]
    edges += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for n in parent:
        groups.setdefault(find(n), set()).add(n)
    want = {n: min(g) for g in groups.values() if len(g) > 1 for n in g}
    got = C.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_type_groups(spark):
    cfg = load_config({"equivalentGroups": [
        {"id": "agent", "groupLabel": "Agent", "equivalentTypes": ["urn:Agent"], "properties": {"n": ["urn:n"]}},
        {"id": "person", "groupLabel": "Person", "equivalentTypes": ["urn:Person"], "properties": {"n": ["urn:n"]}},
        {"id": "org", "groupLabel": "Org", "equivalentTypes": ["urn:Org"], "properties": {"n": ["urn:n"]}}]})
    edges = spark.createDataFrame([("urn:Person", "urn:Agent"), ("urn:Org", "urn:Agent"), ("urn:Club", "urn:Org")], "sub string, super string")
    ex = closures.expanded_groups(spark, cfg, edges)
    names = {r["rank"]: r.group_id for r in ex.select("rank", "group_id").distinct().collect()}
    typed = spark.createDataFrame([("s", t, "urn:" + t) for t in ("Agent", "Person", "Org", "Club")], "source string, iri string, type string")
    g = closures.groups_of(typed, ex)
    pairs = g.select(*[F.col(c).alias(c + "_a") for c in g.columns]).crossJoin(g.select(*[F.col(c).alias(c + "_b") for c in g.columns]))
    shared = closures.shared_group(F.col("groups_a"), F.col("primary_a"), F.col("groups_b"), F.col("primary_b"))
    got = {(r.iri_a, r.iri_b): names.get(r.g) for r in pairs.select("iri_a", "iri_b", shared.alias("g")).collect()}
    assert got[("Person", "Person")] == "person" and got[("Person", "Agent")] == "agent" and got[("Person", "Org")] is None
    assert got[("Club", "Org")] == "org" and all(got[a, b] == got[b, a] for a, b in got)


def test_classes_and_blocking_against_brute_force(spark):
    """Many copies, keyless entities and hot keys: proposals equal an exhaustive ranking."""
    rnd = random.Random(5)
    rows, ent = [], {}
    for src in ("a", "b"):
        for n in range(45):
            s = f"urn:{src}{n:02d}"
            code = rnd.choice(["hot", "hot", "hot", "k1", "k2", None])
            num = rnd.choice(["1", "1", "2", None])
            rows.append(W.typed(src, s, "urn:T"))
            if code:
                rows.append(W.quad(src, s, "urn:code", code))
            if num:
                rows.append(W.quad(src, s, "urn:num", num))
            ent[src, s] = (code, num)
    doc = {"defaults": {"threshold": 0.5, "minimumComparedWeight": 1.0, "maxProposalsPerEntity": 2},
           "equivalentGroups": [{"id": "t", "groupLabel": "T", "equivalentTypes": ["urn:T"], "properties": {
               "code": {"predicates": ["urn:code"], "comparator": "exact", "weight": 2, "blocking": True},
               "num": {"predicates": ["urn:num"], "comparator": "number", "weight": 1}}}]}
    rejected = W.link("r", ("a", "urn:a00"), ("b", "urn:b00"), "REJECTED")
    scored = []
    for (sa, ia), (ca, na) in ent.items():
        for (sb, ib), (cb, nb) in ent.items():
            if sa != "a" or sb != "b" or (ia, ib) == ("urn:a00", "urn:b00") or (ca and cb and ca != cb):
                continue
            parts = [(2, float(ca == cb))] * bool(ca and cb) + [(1, float(na == nb))] * bool(na and nb)
            w = sum(p[0] for p in parts)
            if w and sum(p[0] * p[1] for p in parts) / w >= 0.5:
                scored.append((-round(sum(p[0] * p[1] for p in parts) / w, 4), ia, ib))
    want, ra, rb = set(), {}, {}
    for s, ia, ib in sorted(scored):
        ra[ia], rb[ib] = ra.get(ia, 0) + 1, rb.get(ib, 0) + 1
        if ra[ia] <= 2 or rb[ib] <= 2:
            want.add((ia, ib, -s))
    run = M.run_matching(W.quads(spark, rows), W.links(spark, [rejected]), load_config(doc), "a", "b")
    assert {(r.iri_a, r.iri_b, r.score) for r in run.proposals.collect()} == want
    assert run.classes.count() < 40


def test_grid_join_equals_plain_join(spark):
    a = spark.createDataFrame([("h" if i % 3 else f"k{i % 5}", i) for i in range(90)], "k string, x int")
    b = spark.createDataFrame([("h" if i % 2 else f"k{i % 5}", i) for i in range(80)], "k string, y int")
    want = a.join(b, "k")
    got = skew_safe_join(a, b, ["k"], ["x"], ["y"], target=50)
    assert got.select("k", "x", "y").exceptAll(want).count() == 0 and got.count() == want.count()


def test_configuration():
    cfg = load_config({"equivalentGroups": [{"groupLabel": "Été", "equivalentTypes": ["foaf:Person"], "properties": {"n": ["foaf:name"]}},
                                            {"groupLabel": "Été", "equivalentTypes": ["foaf:Agent"], "properties": {"n": "foaf:name"}}]})
    assert [g.id for g in cfg.groups] == ["ete", "ete-2"]
    assert cfg.groups[0].types == ["http://xmlns.com/foaf/0.1/Person"] and cfg.groups[0].concepts[0].comparator == "auto"
    assert config_hash(cfg) == config_hash(load_config({"equivalentGroups": [
        {"id": "ete", "groupLabel": "Été", "equivalentTypes": ["foaf:Person"], "properties": {"n": ["foaf:name"]}},
        {"id": "ete-2", "groupLabel": "Été", "equivalentTypes": ["foaf:Agent"], "properties": {"n": "foaf:name"}}]}))
    bad = load_config({"defaults": {"threshold": 2}, "equivalentGroups": [{"id": "X", "equivalentTypes": [], "properties": {"1": {"comparator": "no", "weight": 0}}}]})
    codes = {c for _, _, c in validate_config(bad)}
    assert {"OUT_OF_RANGE", "INVALID_ID", "REQUIRED", "INVALID_KEY", "UNKNOWN_COMPARATOR"} <= codes


def test_identical_iris(spark):
    world = W.World(2, sources=4, shared=5)
    assert {r.iri: sorted(r.sources) for r in identical_iris(world.quads(spark)).collect()} == world.identical()


def test_lists_that_share_cells_and_lists_that_run_into_themselves(spark, monkeypatch):
    """Every cell of 40 as the head of a list: what a round finds is written once. Then the last cell leads back to cell 30."""
    from quadweave.operators import ontology

    written, inner = [], ontology.cut_lineage
    monkeypatch.setattr(ontology, "cut_lineage", lambda df, replaces=None: written.append(out := inner(df, replaces)) or out)
    heads = spark.range(40).selectExpr("concat('n', id) AS node", "concat('c', id) AS cell")
    rest = spark.range(39).selectExpr("concat('c', id) AS cell", "concat('c', id + 1) AS next")
    got = {tuple(r) for r in ontology._list_cells(heads, rest).select("node", "cell", "at").collect()}
    assert got == {(f"n{i}", f"c{j}", j - i) for i in range(40) for j in range(i, 40)}
    assert sum(w.count() for w in written) < 1.5 * len(got)
    back = rest.unionByName(spark.sql("SELECT 'c39' AS cell, 'c30' AS next"))
    got = {tuple(r) for r in ontology._list_cells(heads.where("node in ('n0', 'n35')"), back).select("node", "cell", "at").collect()}
    assert got == {("n0", f"c{j}", j) for j in range(40)} | {("n35", f"c{j}", (j - 35) % 10) for j in range(30, 40)}


def test_paths_through_one_node_are_dealt_out(spark, monkeypatch):
    written, inner = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df, replaces=None: written.append(max(map(len, df.rdd.glom().collect()))) or inner(df, replaces))
    edges = spark.range(30).selectExpr("concat('x', id) AS edge_id", "'a' AS source_a", "'hub' AS iri_a", "'b' AS source_b", "concat('i', id) AS iri_b")
    ends = spark.range(30).selectExpr("'b' AS source_a", "concat('i', id) AS iri_a", "id AS k")
    pairs = ends.join(ends.selectExpr("'b' AS source_b", "iri_a AS iri_b", "k AS l"), F.expr("k < l")).drop("k", "l")
    got = {(r.iri_a, r.iri_b): r.path for r in C.shortest_paths(edges, pairs, target=50).collect()}
    assert got == {(f"i{i}", f"i{j}"): [f"x{i}", f"x{j}"] for i in range(30) for j in range(i + 1, 30)}
    assert max(written[3:]) < 250
