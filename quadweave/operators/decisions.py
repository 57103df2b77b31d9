"""Decisions about links in bulk, with the result of applying them one by one.

Decisions interact only through clusters. Clusters joined by the links of pending decisions form
regions; regions are independent of each other. A region's nodes, edges, rejected links and decisions
are brought together once and its queue is replayed in order: an acceptance unites two cluster ids,
a rejection or undo of a confirmed link rebuilds the one cluster it was part of. All regions are
replayed at once, so the number of passes does not depend on the length of a queue.

A region of more than ``limit`` rows is not brought together. Its first decisions are taken alone, as
many as one task may hold; they mostly fall into smaller regions of their own. Where a region stays
large because its clusters are, the decisions that come first in both clusters of their link are
applied by joins, without bringing a cluster together.
"""

from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quadweave.functions.iri import node_key
from quadweave.operators.clusters import (
    build_clusters, cluster_edges, connected_components, merge_violations, with_clusters,
)
from quadweave.runtime import cut_lineage, release, with_positions
from quadweave.vocab import CONFIRMED

#: Rows (nodes, edges, rejected links, decisions) of a region that one task replays.
REGION_ROWS = 200_000
NODE_SEPARATOR = "\u0001"


@dataclass
class Decided:
    """Links after a batch of decisions, what became of each, and what was revoked.

    ``clusters`` are those of the new links, kept up to date for the next batch. ``revocations`` has a
    row (id, revoked_at) for every confirmed link that was rejected or taken back.
    """

    links: DataFrame
    report: DataFrame
    revoked: bool
    clusters: DataFrame | None = None
    revocations: DataFrame | None = None


def apply_decisions(links, decisions, identical, now=None, clusters=None, limit=REGION_ROWS) -> Decided:
    """Apply decisions (ord, id, action[, note]) with the result of applying them one by one.

    Actions: ACCEPT, REJECT, UNDO, LINK. Refused decisions are reported with their reason and change
    nothing but the note. ``clusters`` of the present links are worked out when they are not given.
    """
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    note = F.col("note") if "note" in decisions.columns else F.lit(None).cast("string")
    given = links
    links = links if hasattr(links, "_written_at") else cut_lineage(links)
    queue = with_positions(decisions.select("ord", "id", "action", note.alias("new_note")), ["ord", "id"], "pos")
    queue = cut_lineage(queue.join(links.select("id", F.lit(True).alias("known")), "id", "left"))
    outcomes = [queue.where("known is null").select("pos", F.lit("refused").alias("result"), F.lit("NOT_FOUND").alias("reason"), F.lit(None).cast("boolean").alias("revokes"))]
    pending = queue.where("known").select("pos", "id", "action", "new_note")
    left = pending.limit(1).count() > 0
    clusters = build_clusters(links, identical) if clusters is None else clusters
    while left:
        window, rows = pending, _regions(pending, links, clusters, identical)
        wide, crowded = None, _crowded(rows, limit)
        left = crowded is not None
        if left:
            window = cut_lineage(_first_of_crowded(rows, crowded, pending, max(1, limit // 8)))
            release(rows)
            rows = _regions(window, links, clusters, identical)
            crowded = _crowded(rows, limit)
            if crowded is not None:
                wide = rows.where("kind = 3").join(crowded, "region", "left_semi").select("pos", "id", "action", F.col("new_note").alias("note"))
                wide = cut_lineage(wide)
                rows = cut_lineage(rows.join(crowded, "region", "left_anti"), replaces=rows)
        done = cut_lineage(_replayed(rows), replaces=rows)
        outcomes.append(done.where("kind = 3").select("pos", "result", "reason", "revokes"))
        nodes = done.where("kind = 0").select(F.col("source_a").alias("source"), F.col("iri_a").alias("iri"), F.col("id").alias("cluster_id"))
        links = cut_lineage(_changed(links, done.where("kind = 1"), at), replaces=None if links is given else links)
        clusters = cut_lineage(clusters.join(nodes.select("source", "iri"), ["source", "iri"], "left_anti").unionByName(nodes.where("cluster_id is not null")))
        if not left:
            break
        finished = done.where("kind = 3").select("pos")
        if wide is not None:
            applied, links = _apply_first(wide, links, clusters, identical, at)
            clusters = build_clusters(links, identical)
            outcomes.append(applied)
            finished = finished.unionByName(applied.select("pos"))
        pending = cut_lineage(pending.join(finished, "pos", "left_anti"), replaces=pending)
        left = pending.limit(1).count() > 0
    told = outcomes[0]
    for o in outcomes[1:]:
        told = told.unionByName(o)
    told = cut_lineage(queue.join(told, "pos"))
    gone = told.where("revokes")
    revocations = gone.select("id").distinct().withColumn("revoked_at", at)
    return Decided(links, told.select("ord", "id", "action", "result", "reason"), gone.limit(1).count() > 0, clusters, revocations)


# Rows of a region by kind, in the order in which the replay needs them:
# 0 a node and its cluster, 1 a confirmed or identical edge, 2 a rejected link, 3 a decision.


def _regions(pending, links, clusters, identical) -> DataFrame:
    """All that the replay of pending decisions needs, with the region of each row."""
    ends = ["source_a", "iri_a", "source_b", "iri_b"]
    decided = cut_lineage(with_clusters(pending.join(links.select("id", "status", "origin", *ends), "id", "left"), clusters))
    there = decided.where("status is not null")
    parts = connected_components(there.select(F.col("cluster_a").alias("u"), F.col("cluster_b").alias("v")))
    # A cluster whose decisions stay inside it is a region of its own.
    touched = there.select(F.explode(F.array("cluster_a", "cluster_b")).alias("node")).distinct()
    region = cut_lineage(
        touched.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("region"))
    )
    of = lambda name: region.select(F.col("node").alias(name), "region")
    void = lambda kind, names: [F.lit(None).cast(kind).alias(n) for n in names.split()]
    nodes = clusters.join(of("cluster_id"), "cluster_id").select(
        "region", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.col("cluster_id").alias("id"), *void("string", "action new_note status origin"),
        F.col("source").alias("source_a"), F.col("iri").alias("iri_a"), *void("string", "source_b iri_b"),
    )
    # Both ends of an edge lie in one cluster.
    placed = clusters.join(of("cluster_id"), "cluster_id").select("region", F.col("source").alias("source_a"), F.col("iri").alias("iri_a"))
    edges = cluster_edges(links, identical).join(placed, ["source_a", "iri_a"]).select(
        "region", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pos"), F.col("edge_id").alias("id"), *void("string", "action new_note status origin"), *ends
    )
    # A rejected link counts where both its ends are in one region.
    refused = with_clusters(links.where("status = 'REJECTED'").select("id", *ends), clusters)
    refused = refused.join(of("cluster_a"), "cluster_a").join(region.select(F.col("node").alias("cluster_b"), F.col("region").alias("_other")), "cluster_b")
    refused = refused.where("region = _other").select(
        "region", F.lit(2).alias("kind"), F.lit(None).cast("long").alias("pos"), "id", *void("string", "action new_note status origin"), *ends
    )
    queue = decided.join(of("cluster_a"), "cluster_a", "left").select(
        # A decision on a link that is gone by now is settled anywhere.
        F.coalesce("region", "id").alias("region"), F.lit(3).alias("kind"), "pos", "id", "action", "new_note", "status", "origin", *ends
    )
    out = cut_lineage(nodes.unionByName(edges).unionByName(refused).unionByName(queue))
    release(decided)
    return out


def _crowded(rows, limit):
    """The regions of more than ``limit`` rows, or None."""
    many = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("region")
    return cut_lineage(many) if many.limit(1).count() else None


def _first_of_crowded(rows, crowded, pending, most):
    """Pending decisions: all of regions that fit, the first ``most`` of each that does not."""
    queue = rows.where("kind = 3").select("region", "pos").join(crowded.withColumn("crowded", F.lit(True)), "region", "left")
    first = queue.where("crowded").withColumn("n", F.row_number().over(Window.partitionBy("region").orderBy("pos"))).where(F.col("n") <= most)
    chosen = queue.where("crowded is null").select("pos").unionByName(first.select("pos"))
    return pending.join(chosen, "pos", "left_semi")


class _Region:
    """Clusters of one region while its queue is replayed."""

    def __init__(self):
        self.cluster, self.members, self.sources = {}, {}, {}
        self.edges, self.around = {}, defaultdict(set)
        self.status, self.origin = {}, {}
        self.rejected, self.refused = {}, defaultdict(set)

    def add_node(self, node, cluster):
        self.cluster[node] = cluster
        self.members.setdefault(cluster, []).append(node)
        self.sources.setdefault(cluster, set()).add(node.split(NODE_SEPARATOR, 1)[0])

    def place(self, node):
        """The cluster of a node; one of its own if none is known."""
        if node not in self.cluster:
            self.add_node(node, node)
        return self.cluster[node]

    def add_edge(self, link, u, v):
        self.edges[link] = (u, v)
        self.around[u].add(link)
        self.around[v].add(link)

    def add_rejected(self, link, u, v):
        self.rejected[link] = (u, v)
        self.refused[self.place(u)].add(link)
        self.refused[self.place(v)].add(link)

    def drop_rejected(self, link):
        for node in self.rejected.pop(link, ()):
            self.refused[self.cluster[node]].discard(link)

    def unite(self, u, v):
        a, b = self.place(u), self.place(v)
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        for node in self.members[b]:
            self.cluster[node] = a
        self.members[a] += self.members.pop(b)
        self.sources[a] |= self.sources.pop(b)
        self.refused[a] |= self.refused.pop(b, set())

    def reach(self, start, without=None):
        seen, front = {start}, [start]
        while front:
            node = front.pop()
            for link in self.around[node]:
                if link != without:
                    u, v = self.edges[link]
                    other = v if u == node else u
                    if other not in seen:
                        seen.add(other)
                        front.append(other)
        return seen

    def remove_edge(self, link):
        """Take an edge out; only the cluster it was part of is rebuilt."""
        u, v = self.edges.pop(link)
        self.around[u].discard(link)
        self.around[v].discard(link)
        old = self.cluster[u]
        side = self.reach(u)
        if v in side:
            return
        rest = [n for n in self.members.pop(old) if n not in side]
        self.sources.pop(old)
        links = self.refused.pop(old, set())
        for nodes in (side, rest):
            # Any member names a cluster while the replay runs.
            name = min(nodes)
            for node in nodes:
                self.add_node(node, name)
        for link in links:
            for node in self.rejected[link]:
                self.refused[self.cluster[node]].add(link)

    def violation(self, link, u, v):
        """Why u and v cannot be one entity, else None; the link's own rejection does not count."""
        if u.split(NODE_SEPARATOR, 1)[0] == v.split(NODE_SEPARATOR, 1)[0]:
            return "SAME_SOURCE"
        a, b = self.place(u), self.place(v)
        if a == b:
            return None
        if not self.sources[a].isdisjoint(self.sources[b]):
            return "TWO_IN_SOURCE"
        fewer, other = (a, b) if len(self.refused[a]) <= len(self.refused[b]) else (b, a)
        for r in self.refused[fewer]:
            if r != link and other in (self.cluster[self.rejected[r][0]], self.cluster[self.rejected[r][1]]):
                return "REJECTED"
        return None

    def decide(self, link, action, u, v):
        """(result, reason, revokes, by hand) of one decision, applied if it can be."""
        status = self.status[link]
        confirmed, by_user, reason, by_hand = status in CONFIRMED, self.origin[link] == "USER", None, False
        if status is None or status == "DELETED":
            reason = "NOT_FOUND"
        elif status == "INFERRED":
            reason = "INFERRED"
        elif action == "ACCEPT":
            if confirmed:
                return "unchanged", None, False, False
            reason = self.violation(link, u, v)
        elif action == "LINK":
            reason = "ALREADY_LINKED" if confirmed else self.violation(link, u, v)
        elif action == "REJECT":
            if status == "REJECTED":
                return "unchanged", None, False, False
            if confirmed and v in self.reach(u, without=link):
                reason = "STILL_LINKED"
        elif action == "UNDO" and status == "PROPOSED":
            reason = "NOT_REVIEWED"
        if reason:
            return "refused", reason, False, False
        if action in ("ACCEPT", "LINK"):
            by_hand = action == "LINK" and status != "PROPOSED"
            self.status[link] = "MANUAL" if by_hand or by_user else "ACCEPTED"
            self.drop_rejected(link)
            self.add_edge(link, u, v)
            self.unite(u, v)
            if by_hand:
                self.origin[link] = "USER"
            return "applied", None, False, by_hand
        if confirmed:
            self.remove_edge(link)
        if action == "REJECT":
            self.status[link] = "REJECTED"
            self.add_rejected(link, u, v)
        else:
            self.drop_rejected(link)
            self.status[link] = "DELETED" if by_user else "PROPOSED"
            self.origin[link] = "ALGORITHM"
        return "applied", None, confirmed, False


_OUT = pa.schema([
    ("kind", pa.int32()), ("pos", pa.int64()), ("id", pa.string()), ("source_a", pa.string()), ("iri_a", pa.string()), ("result", pa.string()),
    ("reason", pa.string()), ("revokes", pa.bool_()), ("new_status", pa.string()), ("new_origin", pa.string()), ("noted", pa.bool_()), ("new_note", pa.string()),
])
_OUT_SQL = "kind int, pos long, id string, source_a string, iri_a string, result string, reason string, revokes boolean, new_status string, new_origin string, noted boolean, new_note string"


def _replay(rows):
    """Rows of one region, by kind and position, to (0) nodes with clusters, (1) changed links, (3) results."""
    region, changed, notes = _Region(), {}, {}
    for kind, pos, link, action, note, status, origin, sa, ia, sb, ib in rows:
        u = v = None
        if sa is not None:
            u = sa + NODE_SEPARATOR + ia
        if sb is not None:
            v = sb + NODE_SEPARATOR + ib
        if kind == 0:
            region.add_node(u, link)
        elif kind == 1:
            region.add_edge(link, u, v)
        elif kind == 2:
            region.add_rejected(link, u, v)
        else:
            if link not in region.status:
                region.status[link], region.origin[link] = status, origin
            result, reason, revokes, _ = region.decide(link, action, u, v)
            if result == "applied":
                changed[link] = True
            if note is not None:
                notes[link] = note
            yield (3, pos, link, None, None, result, reason, revokes, None, None, None, None)
    for link in changed.keys() | notes.keys():
        new = (region.status[link], region.origin[link]) if link in changed else (None, None)
        yield (1, None, link, None, None, None, None, None, *new, link in notes, notes.get(link))
    for nodes in region.members.values():
        # As everywhere, a cluster is called by its smallest node; one node alone is no cluster.
        name = min(nodes)
        for node in nodes:
            source, iri = node.split(NODE_SEPARATOR, 1)
            yield (0, None, name if len(nodes) > 1 else None, source, iri, None, None, None, None, None, None, None)


def _replayed(rows) -> DataFrame:
    columns = ["kind", "pos", "id", "action", "new_note", "status", "origin", "source_a", "iri_a", "source_b", "iri_b"]

    def each(batches):
        now, held, out = None, [], []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, row in zip(names, zip(*(batch.column(i + 1).to_pylist() for i in range(len(columns))))):
                if name != now:
                    out.extend(_replay(held))
                    now, held = name, []
                held.append(row)
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
                    out = []
        out.extend(_replay(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    dealt = rows.select("region", *columns).repartition("region").sortWithinPartitions("region", "kind", "pos")
    return dealt.mapInArrow(each, _OUT_SQL)


def _changed(links, change, at) -> DataFrame:
    """Links with new states; ``change`` is (id, new_status, new_origin, noted, new_note), links that are gone left out."""
    cols = links.columns
    change = change.select("id", F.col("new_status").alias("_status"), F.col("new_origin").alias("_origin"), F.col("noted").alias("_noted"), F.col("new_note").alias("_note"))
    moved = F.col("_status").isNotNull()
    new = {
        "status": F.coalesce("_status", "status"),
        "origin": F.when(moved, F.col("_origin")).otherwise(F.col("origin")),
        # A link that is open again has no date of decision.
        "decided_at": F.when(moved & (F.col("_status") == "PROPOSED"), F.lit(None).cast("timestamp")).when(moved, at).otherwise(F.col("decided_at")),
        "note": F.when(F.col("_noted"), F.nullif(F.trim("_note"), F.lit(""))).otherwise(F.col("note")),
    }
    out = links.join(change, "id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in cols])
    return out.where("status <> 'DELETED'")


def _apply_first(queue, links, clusters, identical, at):
    """(outcomes, links): decisions that come first in both clusters of their link, applied by joins."""
    d = cut_lineage(with_clusters(queue.join(links.drop("note"), "id", "left"), clusters))
    first = d.select("pos", F.explode(F.array("cluster_a", "cluster_b")).alias("c")).groupBy("c").agg(F.min("pos").alias("m"))
    for s in "ab":
        d = d.join(first.select(F.col("c").alias(f"cluster_{s}"), F.col("m").alias(f"m_{s}")), f"cluster_{s}", "left")
    ready = cut_lineage(d.where("status is null or (pos = m_a and pos = m_b)").drop("m_a", "m_b"))
    pair = ["source_a", "iri_a", "source_b", "iri_b"]
    checked = merge_violations(ready.where("status is not null and action in ('ACCEPT', 'LINK')").select("pos", "id", *pair), clusters, links)
    confirmed, act, status = F.col("status").isin(*CONFIRMED), F.col("action"), F.col("status")
    # Is there another way between the ends of a confirmed link that is to be rejected?
    cut = cut_lineage(ready.where((act == "REJECT") & confirmed))
    still = None
    if cut.limit(1).count():
        left = cluster_edges(links, identical).join(cut.select(F.col("id").alias("edge_id")), "edge_id", "left_anti")
        touched = cut.select(F.col("cluster_a").alias("cluster_id")).join(clusters, "cluster_id").select(F.col("source").alias("source_a"), F.col("iri").alias("iri_a"))
        left = left.join(touched, ["source_a", "iri_a"], "left_semi")
        parts = connected_components(left.select(node_key("source_a", "iri_a").alias("u"), node_key("source_b", "iri_b").alias("v")))
        ends = cut.select("pos", node_key("source_a", "iri_a").alias("x"), node_key("source_b", "iri_b").alias("y"))
        still = (
            ends.join(parts.select(F.col("node").alias("x"), F.col("component").alias("cx")), "x")
            .join(parts.select(F.col("node").alias("y"), F.col("component").alias("cy")), "y")
            .where("cx = cy").select("pos", F.lit(True).alias("still"))
        )
    d = ready.join(checked.select("pos", "violation"), "pos", "left")
    d = d.join(still, "pos", "left") if still is not None else d.withColumn("still", F.lit(None).cast("boolean"))
    reason = (
        F.when(status.isNull(), "NOT_FOUND")
        .when(status == "INFERRED", "INFERRED")
        .when((act == "ACCEPT") & ~confirmed, F.col("violation"))
        .when((act == "LINK") & confirmed, "ALREADY_LINKED")
        .when(act == "LINK", F.col("violation"))
        .when((act == "REJECT") & confirmed & F.coalesce("still", F.lit(False)), "STILL_LINKED")
        .when((act == "UNDO") & (status == "PROPOSED"), "NOT_REVIEWED")
    )
    noop = ((act == "ACCEPT") & confirmed) | ((act == "REJECT") & (status == "REJECTED"))
    by_user, by_hand = F.col("origin") == "USER", (act == "LINK") & (status != "PROPOSED")
    new_status = (
        F.when(by_hand, "MANUAL").when(act.isin("ACCEPT", "LINK"), F.when(by_user, "MANUAL").otherwise("ACCEPTED"))
        .when(act == "REJECT", "REJECTED").otherwise(F.when(by_user, "DELETED").otherwise("PROPOSED"))
    )
    new_origin = F.when(act == "UNDO", "ALGORITHM").when(by_hand, "USER").otherwise(F.col("origin"))
    d = d.withColumn("reason", reason).withColumn("result", F.when(F.col("reason").isNotNull(), "refused").when(noop, "unchanged").otherwise("applied"))
    applied = F.col("result") == "applied"
    done = cut_lineage(d.select(
        "pos", "id", "result", "reason", (applied & confirmed & act.isin("REJECT", "UNDO")).alias("revokes"),
        F.when(applied, new_status).alias("new_status"), F.when(applied, new_origin).alias("new_origin"),
        F.col("note").isNotNull().alias("noted"), F.col("note").alias("new_note"),
    ))
    links = cut_lineage(_changed(links, done.where("result = 'applied' or noted"), at), replaces=links)
    return done.select("pos", "result", "reason", "revokes"), links
