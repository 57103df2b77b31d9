"""Clusters of equivalent entities: components, paths, invariants, sameAs, inferred links.

The tables link decisions, not data: a consistent cluster has at most one entity per source, so
pairs within clusters are bounded by (number of sources)^2 per cluster.
"""

from pyspark.sql import DataFrame, functions as F

from quadweave.functions.iri import link_id, node_key
from quadweave.runtime import cut_lineage, dealt_join, skew_safe_join, tasks_for
from quadweave.vocab import CONFIRMED, MATCHING_GRAPH, SAME_AS

IDENTICAL = "identical:"
# Paths that one task makes or chooses from: their rows carry the ids of all their links and nodes.
PATHS_PER_TASK = 200_000


def cluster_edges(links, identical) -> DataFrame:
    """(edge_id, source_a, iri_a, source_b, iri_b): confirmed links and identical-IRI chains."""
    confirmed = links.where(F.col("status").isin(*CONFIRMED)).select(
        F.col("id").alias("edge_id"), "source_a", "iri_a", "source_b", "iri_b"
    )
    chain = identical.select(
        "iri",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("sources") - 1),
                lambda i: F.struct(F.element_at("sources", i).alias("x"), F.element_at("sources", i + 1).alias("y")),
            )
        ).alias("step"),
    ).select(
        F.concat_ws(":", F.lit(IDENTICAL[:-1]), "iri", "step.x", "step.y").alias("edge_id"),
        F.col("step.x").alias("source_a"), F.col("iri").alias("iri_a"),
        F.col("step.y").alias("source_b"), F.col("iri").alias("iri_b"),
    )
    return confirmed.unionByName(chain)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge list (u, v); the component is its smallest node.

    Alternating large-star and small-star rounds. Each star is a minimum per node (combined on the
    map side) joined back to the edges, so no neighbourhood is ever gathered in one place.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e)
    if e.limit(1).count() == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def fingerprint(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = fingerprint(e)
    while True:
        # Large star: every neighbour larger than u points to the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        e = cut_lineage(small, replaces=e)
        now = fingerprint(e)
        if now == seen:
            members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return members.unionByName(roots)
        seen = now


def build_clusters(links, identical) -> DataFrame:
    """(source, iri, cluster_id): nodes joined by confirmed links and identical IRIs.

    A node in no such link is not listed: it is a cluster of its own.
    """
    edges = cut_lineage(cluster_edges(links, identical))
    ends = edges.select(node_key("source_a", "iri_a").alias("u"), node_key("source_b", "iri_b").alias("v"))
    parts = connected_components(ends)
    cut = F.split("node", "\u0001", 2)
    return cut_lineage(
        parts.select(cut[0].alias("source"), cut[1].alias("iri"), F.col("component").alias("cluster_id"))
    )


# --- lookups --------------------------------------------------------------------------------


def with_clusters(pairs, clusters) -> DataFrame:
    """Add ``cluster_a`` and ``cluster_b``; a node in no cluster gets its own key."""
    for s in "ab":
        own = clusters.select(F.col("source").alias(f"source_{s}"), F.col("iri").alias(f"iri_{s}"),
                              F.col("cluster_id").alias(f"cluster_{s}"))
        pairs = pairs.join(own, [f"source_{s}", f"iri_{s}"], "left").withColumn(
            f"cluster_{s}", F.coalesce(f"cluster_{s}", node_key(f"source_{s}", f"iri_{s}"))
        )
    return pairs


def cluster_of(nodes, clusters) -> DataFrame:
    """Members of the cluster of each node: (source, iri, member_source, member_iri)."""
    own = nodes.join(clusters, ["source", "iri"], "left")
    m = clusters.select("cluster_id", F.col("source").alias("member_source"), F.col("iri").alias("member_iri"))
    return own.join(m, "cluster_id", "left").select(
        "source", "iri",
        F.coalesce("member_source", "source").alias("member_source"),
        F.coalesce("member_iri", "iri").alias("member_iri"),
    )


def same_cluster(pairs, clusters) -> DataFrame:
    """Add ``same_cluster`` to node pairs."""
    return with_clusters(pairs, clusters).withColumn("same_cluster", F.col("cluster_a") == F.col("cluster_b"))


def member_in(nodes, clusters) -> DataFrame:
    """(source, iri, other) -> ``member_iri``: the node's counterpart in another source, if any."""
    m = cluster_of(nodes.select("source", "iri").distinct(), clusters)
    best = m.groupBy("source", "iri", F.col("member_source").alias("other")).agg(F.min("member_iri").alias("member_iri"))
    return nodes.join(best, ["source", "iri", "other"], "left")


def same_entity(pairs, clusters) -> DataFrame:
    """Add ``same_entity`` to IRI pairs (iri1, iri2): equal, or in one cluster through any node."""
    ids = clusters.select("iri", "cluster_id").distinct()
    one = ids.select(F.col("iri").alias("iri1"), F.col("cluster_id").alias("c"))
    two = ids.select(F.col("iri").alias("iri2"), F.col("cluster_id").alias("c"))
    known = pairs.select("iri1", "iri2").distinct().join(one, "iri1").join(two, ["iri2", "c"]).select("iri1", "iri2", F.lit(True).alias("k")).distinct()
    return pairs.join(known, ["iri1", "iri2"], "left").withColumn(
        "same_entity", (F.col("iri1") == F.col("iri2")) | F.coalesce("k", F.lit(False))
    ).drop("k")


# --- invariants -----------------------------------------------------------------------------


def merge_violations(pairs, clusters, links, ignore_own=True) -> DataFrame:
    """Add ``violation`` to node pairs: why confirming the pair is not allowed, else null.

    SAME_SOURCE: both entities come from one source. TWO_IN_SOURCE: two entities of one source
    would be the same. REJECTED: two entities rejected as different would be joined; with
    ``ignore_own`` the pair's own rejected link does not count. Clusters are disjoint, so two of
    them hold different entities of every source they share: comparing source sets is enough.
    """
    p = with_clusters(pairs, clusters)
    around = clusters.groupBy("cluster_id").agg(F.collect_set("source").alias("srcs"))
    for s in "ab":
        p = p.join(around.select(F.col("cluster_id").alias(f"cluster_{s}"), F.col("srcs").alias(f"srcs_{s}")), f"cluster_{s}", "left")
        p = p.withColumn(f"srcs_{s}", F.coalesce(f"srcs_{s}", F.array(f"source_{s}")))
    refused = with_clusters(
        links.where("status = 'REJECTED'").select("id", "source_a", "iri_a", "source_b", "iri_b"), clusters
    ).select(F.col("id").alias("rid"), "cluster_a", "cluster_b")
    refused = refused.unionByName(
        refused.select("rid", F.col("cluster_b").alias("cluster_a"), F.col("cluster_a").alias("cluster_b"))
    ).groupBy("cluster_a", "cluster_b").agg(F.collect_set("rid").alias("rids"))
    p = p.join(refused, ["cluster_a", "cluster_b"], "left")
    rids = F.coalesce("rids", F.array().cast("array<string>"))
    if ignore_own:
        rids = F.array_remove(rids, F.coalesce(F.col("id"), F.lit(""))) if "id" in pairs.columns else F.array_remove(
            rids, link_id("source_a", "iri_a", "source_b", "iri_b"))
    violation = (
        F.when(F.col("source_a") == F.col("source_b"), F.lit("SAME_SOURCE"))
        .when(F.col("cluster_a") == F.col("cluster_b"), F.lit(None).cast("string"))
        .when(F.arrays_overlap("srcs_a", "srcs_b"), F.lit("TWO_IN_SOURCE"))
        .when(F.size(rids) > 0, F.lit("REJECTED"))
    )
    return p.withColumn("violation", violation).select(*pairs.columns, "cluster_a", "cluster_b", "violation")


def conflicts(clusters, links) -> DataFrame:
    """(kind, cluster_id, source, nodes, link_ids): inconsistencies of the present links."""
    crowded = (
        clusters.groupBy("cluster_id", "source").agg(F.array_sort(F.collect_set("iri")).alias("nodes")).where(F.size("nodes") > 1)
    )
    placed = with_clusters(links, clusters)
    ids = (
        placed.where(F.col("status").isin(*CONFIRMED))
        .select("id", F.explode(F.array_distinct(F.array("cluster_a", "cluster_b"))).alias("cluster_id"))
        .join(crowded.select("cluster_id").distinct(), "cluster_id", "left_semi")
        .groupBy("cluster_id").agg(F.array_sort(F.collect_set("id")).alias("link_ids"))
    )
    one = crowded.join(ids, "cluster_id", "left").select(
        F.lit("SAME_SOURCE_IN_CLUSTER").alias("kind"), "cluster_id", "source", "nodes",
        F.coalesce("link_ids", F.array().cast("array<string>")).alias("link_ids"),
    )
    two = placed.where("status = 'REJECTED' and cluster_a = cluster_b").select(
        F.lit("REJECTED_INSIDE_CLUSTER").alias("kind"), F.col("cluster_a").alias("cluster_id"),
        F.lit(None).cast("string").alias("source"), F.array("iri_a", "iri_b").alias("nodes"), F.array("id").alias("link_ids"),
    )
    return one.unionByName(two)


# --- pairs within clusters ------------------------------------------------------------------


def cluster_pairs(clusters) -> DataFrame:
    """(cluster_id, source_a, iri_a, source_b, iri_b): cross-source pairs of different IRIs."""
    a = clusters.select("cluster_id", F.col("source").alias("source_a"), F.col("iri").alias("iri_a"))
    b = clusters.select("cluster_id", F.col("source").alias("source_b"), F.col("iri").alias("iri_b"))
    met = skew_safe_join(a, b, ["cluster_id"], ["source_a", "iri_a"], ["source_b", "iri_b"])
    return met.where("source_a < source_b and iri_a <> iri_b")


def same_as(clusters) -> DataFrame:
    """(s, o): both directions for every two different IRIs of a cluster."""
    iris = clusters.select("cluster_id", "iri").distinct()
    return (
        iris.select("cluster_id", F.col("iri").alias("s"))
        .join(iris.select("cluster_id", F.col("iri").alias("o")), "cluster_id")
        .where("s <> o").select("s", "o").distinct()
    )


def same_as_quads(clusters, graph=MATCHING_GRAPH) -> DataFrame:
    """The sameAs graph as quads."""
    none = F.lit(None).cast("string")
    return same_as(clusters).select(
        F.lit("").alias("source"), F.lit(graph).alias("graph"), F.lit("matching").alias("graph_kind"),
        "s", F.lit("iri").alias("s_kind"), F.lit(SAME_AS).alias("p"), "o", F.lit("iri").alias("o_kind"),
        none.alias("o_datatype"), none.alias("o_lang"),
    )


def shortest_paths(edges, pairs, target=PATHS_PER_TASK) -> DataFrame:
    """(source_a, iri_a, source_b, iri_b, path, nodes): shortest path of each pair.

    ``edges`` as from :func:`cluster_edges`; among equally short paths the smallest edge-id array
    wins. Frontiers start at the asked nodes only and keep one path per (start, reached node). The
    steps of a round are dealt out to tasks of about ``target`` paths, those through one node as well.
    """
    u, v = node_key("source_a", "iri_a"), node_key("source_b", "iri_b")
    asked = cut_lineage(pairs.select("source_a", "iri_a", "source_b", "iri_b", u.alias("start"), v.alias("goal")).distinct())
    step = edges.select(u.alias("x"), v.alias("y"), "edge_id")
    step = cut_lineage(step.unionByName(step.select(F.col("y").alias("x"), F.col("x").alias("y"), "edge_id")))
    none = F.array().cast("array<string>")
    known = cut_lineage(
        asked.select("start").distinct().select("start", F.col("start").alias("at"), none.alias("path"), F.array("start").alias("nodes"))
    )
    front = known
    while True:
        met, n = dealt_join(front.withColumnRenamed("at", "x"), step, ["x"], ["start"], ["y", "edge_id"], target)
        hop = (
            met.select("start", F.col("y").alias("at"),
                       F.concat("path", F.array("edge_id")).alias("path"), F.concat("nodes", F.array("y")).alias("nodes"))
            .repartition(tasks_for(n, target), "start", "at")
            .groupBy("start", "at").agg(F.min(F.struct("path", "nodes")).alias("m"))
            .select("start", "at", "m.path", "m.nodes")
            .join(known.select("start", "at"), ["start", "at"], "left_anti")
        )
        front = cut_lineage(hop)
        if front.limit(1).count() == 0:
            return asked.join(known, (asked["goal"] == known["at"]) & (asked["start"] == known["start"])).select(
                "source_a", "iri_a", "source_b", "iri_b", "path", "nodes"
            )
        known = cut_lineage(known.unionByName(front), replaces=known)


def reconcile(links, clusters, identical, now=None) -> DataFrame:
    """Links such that every cross-source pair of a cluster carries exactly one link.

    Returns the new link table with a ``change`` column: ``added`` (new inferred, or a proposal that
    became inferred), ``path`` (an inferred link explained differently), ``removed`` (inferred and
    no longer supported; drop these rows to get the table), null otherwise.
    """
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    keys = ["source_a", "iri_a", "source_b", "iri_b"]
    wanted = cut_lineage(cluster_pairs(clusters).select(*keys))
    settled = links.where(F.col("status").isin(*CONFIRMED, "REJECTED")).select(*keys)
    open_pairs = wanted.join(settled, keys, "left_anti")
    paths = shortest_paths(cluster_edges(links, identical), open_pairs).select(*keys, F.col("path").alias("new_path"))
    # Labels and types already known for the nodes of other links.
    snaps = links.select(
        F.explode(F.array(*[
            F.struct(F.col(f"source_{s}").alias("source"), F.col(f"iri_{s}").alias("iri"),
                     F.struct(F.col(f"label_{s}").isNull().alias("n"), F.col("id"), F.col(f"label_{s}").alias("label"), F.col(f"types_{s}").alias("types")).alias("v"))
            for s in "ab"])).alias("e")
    ).groupBy("e.source", "e.iri").agg(F.min("e.v").alias("v"))
    fresh = paths.join(links.select(*keys), keys, "left_anti")
    for s in "ab":
        fresh = fresh.join(
            snaps.select(F.col("source").alias(f"source_{s}"), F.col("iri").alias(f"iri_{s}"),
                         F.col("v.label").alias(f"label_{s}"), F.col("v.types").alias(f"types_{s}")),
            [f"source_{s}", f"iri_{s}"], "left")
    made = {
        "id": link_id(*keys), "status": F.lit("INFERRED"), "origin": F.lit("INFERENCE"),
        "inferred_from": F.col("new_path"), "decided_at": at,
    }
    present = keys + ["label_a", "types_a", "label_b", "types_b"]
    types = dict(links.dtypes)
    fresh = fresh.select(
        *[(made[c] if c in made else F.col(c) if c in present else F.lit(None)).cast(types[c]).alias(c) for c in links.columns],
        F.lit("added").alias("change"),
    )
    old = same_cluster(links.join(paths, keys, "left"), clusters)
    proposed = (F.col("status") == "PROPOSED") & F.col("new_path").isNotNull()
    inferred = F.col("status") == "INFERRED"
    change = (
        F.when(proposed, "added")
        .when(inferred & ~F.col("same_cluster"), "removed")
        .when(inferred & F.col("new_path").isNotNull() & ~F.col("new_path").eqNullSafe(F.col("inferred_from")), "path")
    )
    old = old.withColumn("change", change)
    turned = F.col("change") == "added"
    old = old.select(
        *[
            {
                "status": F.when(turned, "INFERRED").otherwise(F.col("status")),
                "origin": F.when(turned, "INFERENCE").otherwise(F.col("origin")),
                "decided_at": F.when(turned, at).otherwise(F.col("decided_at")),
                "inferred_from": F.when(F.col("change").isin("added", "path"), F.col("new_path")).otherwise(F.col("inferred_from")),
            }.get(c, F.col(c)).alias(c)
            for c in links.columns
        ],
        "change",
    )
    return old.unionByName(fresh)


def reconciled(links, clusters, identical, now=None) -> DataFrame:
    """The link table after :func:`reconcile`."""
    return reconcile(links, clusters, identical, now).where("change is null or change <> 'removed'").drop("change")


def refresh_links(links, quads):
    """(links, sameAs quads) brought up to date with the data, as when a project is opened."""
    from quadweave.operators.patterns import identical_iris

    identical = identical_iris(quads)
    clusters = build_clusters(links, identical)
    return reconciled(links, clusters, identical), same_as_quads(clusters)


def inference_chain(links, clusters, identical) -> DataFrame:
    """(id, step, kind, link_id, status, from_node, to_node): inferred links explained."""
    keys = ["source_a", "iri_a", "source_b", "iri_b"]
    inferred = links.where("status = 'INFERRED'").select("id", *keys)
    paths = shortest_paths(cluster_edges(links, identical), inferred).join(inferred, keys)
    steps = paths.select("id", F.posexplode("path").alias("step", "edge_id"), "nodes").select(
        "id", (F.col("step") + 1).alias("step"), "edge_id",
        F.element_at("nodes", F.col("step") + 1).alias("from_node"), F.element_at("nodes", F.col("step") + 2).alias("to_node"),
    )
    via = links.select(F.col("id").alias("edge_id"), F.col("status").alias("status"))
    same = F.col("edge_id").startswith(IDENTICAL)
    return steps.join(via, "edge_id", "left").select(
        "id", "step", F.when(same, "identical").otherwise("link").alias("kind"),
        F.when(~same, F.col("edge_id")).alias("link_id"), "status", "from_node", "to_node",
    )


def cluster_table(clusters, links, min_size=2) -> DataFrame:
    """(cluster_id, nodes, size, link_ids, conflict): conflicts first, then larger clusters."""
    nodes = clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_set(F.struct("source", "iri"))).alias("nodes"))
    bad = conflicts(clusters, links).select(F.explode("link_ids").alias("id")).distinct().withColumn("bad", F.lit(True))
    inner = (
        with_clusters(links, clusters).where("cluster_a = cluster_b")
        .join(bad, "id", "left")
        .groupBy(F.col("cluster_a").alias("cluster_id"))
        .agg(F.array_sort(F.collect_set("id")).alias("link_ids"), F.max(F.coalesce("bad", F.lit(False))).alias("conflict"))
    )
    return (
        nodes.withColumn("size", F.size("nodes")).where(F.col("size") >= max(2, min_size))
        .join(inner, "cluster_id", "left")
        .select("cluster_id", "nodes", "size",
                F.coalesce("link_ids", F.array().cast("array<string>")).alias("link_ids"),
                F.coalesce("conflict", F.lit(False)).alias("conflict"))
        .orderBy(F.desc("conflict"), F.desc("size"), "cluster_id")
    )
