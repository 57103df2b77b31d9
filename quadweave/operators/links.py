"""The life of links: decisions in bulk, manual links, orphans, flags, lists, overviews."""

from pyspark.sql import DataFrame, functions as F

from quadweave.functions.iri import link_id, node_pair_key, source_pair_key
from quadweave.functions.text import fold
from quadweave.operators import closures
from quadweave.operators.clusters import build_clusters, conflicts, merge_violations, reconcile
from quadweave.operators.decisions import Decided, apply_decisions
from quadweave.operators.patterns import data_quads
from quadweave.runtime import cut_lineage
from quadweave.vocab import CONFIRMED, RDF_TYPE, STATUSES

PAIR = ["source_a", "iri_a", "source_b", "iri_b"]


def _same_action(ids, action):
    """One action for all ids; without ``ord`` they are taken in the order of their id."""
    if "ord" not in ids.columns:
        ids = ids.select("id").distinct().orderBy("id").withColumn("ord", F.monotonically_increasing_id())
    return ids.select("ord", "id", F.lit(action).alias("action"))


def accept(links, ids, identical, now=None) -> Decided:
    """Accept links given as (ord, id); MANUAL for links made by the user, else ACCEPTED."""
    return apply_decisions(links, _same_action(ids, "ACCEPT"), identical, now)


def reject(links, ids, identical, now=None) -> Decided:
    return apply_decisions(links, _same_action(ids, "REJECT"), identical, now)


def undo(links, ids, identical, now=None) -> Decided:
    return apply_decisions(links, _same_action(ids, "UNDO"), identical, now)


def accept_above(links, identical, threshold=0.95, flags=None, now=None) -> Decided:
    """Accept every proposal to review scored at least ``threshold``, best first."""
    good = links.where((F.col("status") == "PROPOSED") & (F.col("score") >= threshold))
    if flags is not None:
        stale = flags.where("superseded or orphan_a or orphan_b").select("id")
        good = good.join(stale, "id", "left_anti")
    # The order is part of the meaning, so ordinals come from one total order over the decisions
    # taken in a review, computed by Spark's distributed sort.
    ordered = good.select("id", "score").orderBy(F.desc("score"), "id").withColumn("ord", F.monotonically_increasing_id())
    return apply_decisions(links, ordered.select("ord", "id", F.lit("ACCEPT").alias("action")), identical, now)


def add_manual_links(links, requests, quads, identical, cfg=None, edges=None, now=None) -> Decided:
    """Link pairs by hand: requests (ord, source_a, iri_a, source_b, iri_b[, note]).

    Both ends must exist in two different sources. An existing proposal is accepted, a rejected
    pair becomes MANUAL unless that breaks an invariant, other existing links are refused. New
    links are scored when a configuration is given and the pair shares a group.
    """
    if "note" not in requests.columns:
        requests = requests.withColumn("note", F.lit(None).cast("string"))
    swap = F.col("source_a") > F.col("source_b")
    r = requests.select(
        "ord", "note",
        F.when(swap, F.col("source_b")).otherwise(F.col("source_a")).alias("source_a"),
        F.when(swap, F.col("iri_b")).otherwise(F.col("iri_a")).alias("iri_a"),
        F.when(swap, F.col("source_a")).otherwise(F.col("source_b")).alias("source_b"),
        F.when(swap, F.col("iri_a")).otherwise(F.col("iri_b")).alias("iri_b"),
    )
    there = data_quads(quads).select(F.col("source").alias("source"), F.col("s").alias("iri")).distinct()
    for s in "ab":
        have = there.select(F.col("source").alias(f"source_{s}"), F.col("iri").alias(f"iri_{s}"), F.lit(True).alias(f"has_{s}"))
        r = r.join(have, [f"source_{s}", f"iri_{s}"], "left")
    bad = F.when(F.col("source_a") == F.col("source_b"), "SAME_SOURCE").when(
        F.col("has_a").isNull() | F.col("has_b").isNull(), "NO_STATEMENT")
    r = cut_lineage(r.withColumn("bad", bad).drop("has_a", "has_b"))
    key = node_pair_key(*PAIR)
    ok = r.where("bad is null").withColumn("k", key)
    old = links.select(key.alias("k"), F.col("id").alias("old_id"))
    ok = cut_lineage(ok.join(old, "k", "left").withColumn("id", F.coalesce("old_id", link_id(*PAIR))).drop("k"))
    fresh = ok.where("old_id is null").select("id", *PAIR).dropDuplicates(["id"])
    if cfg is not None:
        from quadweave.plans.matching import score_given_pairs

        clusters = build_clusters(links, identical)
        scored = score_given_pairs(fresh.select(*PAIR), quads, cfg, clusters, edges).drop("outcome")
        fresh = fresh.join(scored, PAIR, "left")
    types = dict(links.dtypes)
    given = {"status": F.lit("NEW"), "origin": F.lit("USER")}
    fresh = fresh.select(*[
        (given[c] if c in given else F.col(c) if c in fresh.columns else F.lit(None)).cast(types[c]).alias(c) for c in links.columns
    ])
    decided = apply_decisions(
        links.unionByName(fresh), ok.select("ord", "id", F.lit("LINK").alias("action"), "note"), identical, now
    )
    refused = r.where("bad is not null").select(
        "ord", link_id(*PAIR).alias("id"), F.lit("LINK").alias("action"), F.lit("refused").alias("result"), F.col("bad").alias("reason"))
    return Decided(decided.links.where("status <> 'NEW'"), decided.report.unionByName(refused), decided.revoked, decided.clusters, decided.revocations)


def annotate(links, notes) -> DataFrame:
    """Set notes (id, note); a blank note clears."""
    n = notes.select("id", F.lit(True).alias("_n"), F.col("note").alias("_note"))
    value = F.when(F.col("_n"), F.nullif(F.trim("_note"), F.lit(""))).otherwise(F.col("note"))
    return links.join(n, "id", "left").select(*[value.alias(c) if c == "note" else F.col(c) for c in links.columns])


# --- orphans --------------------------------------------------------------------------------


def orphans(links, quads) -> DataFrame:
    """(id, orphan_a, orphan_b): ends without any statement in their source."""
    there = data_quads(quads).select("source", F.col("s").alias("iri")).distinct()
    out = links.select("id", *PAIR)
    for s in "ab":
        have = there.select(F.col("source").alias(f"source_{s}"), F.col("iri").alias(f"iri_{s}"), F.lit(True).alias(f"has_{s}"))
        out = out.join(have, [f"source_{s}", f"iri_{s}"], "left")
    return out.select("id", F.col("has_a").isNull().alias("orphan_a"), F.col("has_b").isNull().alias("orphan_b"))


def remove_orphans(links, quads, pair=None, source=None):
    """(links, removed, revoked): drop links with an orphan end, except inferred ones.

    ``pair`` (two sources) or ``source`` restricts the removal.
    """
    scope = F.col("status") != "INFERRED"
    if pair:
        a, b = sorted(pair)
        scope = scope & (F.col("source_a") == a) & (F.col("source_b") == b)
    if source:
        scope = scope & ((F.col("source_a") == source) | (F.col("source_b") == source))
    lost = orphans(links.where(scope), quads).where("orphan_a or orphan_b").select("id")
    removed = links.join(lost, "id", "left_semi")
    revoked = removed.where(F.col("status").isin(*CONFIRMED)).limit(1).count() > 0
    return links.join(lost, "id", "left_anti"), removed, revoked


# --- flags and lists ------------------------------------------------------------------------


def _groups_of_link_types(links, expanded):
    typed = links.select("id", F.explode(F.array(
        F.struct(F.lit("a").alias("source"), F.col("types_a").alias("t")),
        F.struct(F.lit("b").alias("source"), F.col("types_b").alias("t")))).alias("e")).select(
        F.col("e.source").alias("source"), F.col("id").alias("iri"), F.explode("e.t").alias("type"))
    return closures.groups_of(typed, expanded)


def link_flags(links, clusters, quads, expanded=None) -> DataFrame:
    """(id, superseded, orphan_a, orphan_b, type_mismatch, conflict).

    ``superseded``: a proposal one of whose entities already has another counterpart, or that can
    no longer be confirmed. ``type_mismatch``: a confirmed link whose ends share no type group.
    """
    proposed = links.where("status = 'PROPOSED'").select("id", *PAIR)
    crowd = clusters.groupBy("cluster_id", "source").agg(F.count(F.lit(1)).alias("n"))
    known = clusters.select("cluster_id").distinct().withColumn("multi", F.lit(True))
    v = merge_violations(proposed, clusters, links, ignore_own=False)
    for s in "ab":
        v = v.join(known.select(F.col("cluster_id").alias(f"cluster_{s}"), F.col("multi").alias(f"multi_{s}")), f"cluster_{s}", "left")
        v = v.join(crowd.select(F.col("cluster_id").alias(f"cluster_{s}"), F.col("source").alias(f"source_{s}"), F.col("n").alias(f"n_{s}")),
                   [f"cluster_{s}", f"source_{s}"], "left")
    multi = F.coalesce("multi_a", F.lit(False)) | F.coalesce("multi_b", F.lit(False))
    together = (F.col("cluster_a") == F.col("cluster_b")) & (F.coalesce(F.greatest("n_a", "n_b"), F.lit(1)) > 1)
    superseded = v.select("id", (together | (multi & F.col("violation").isNotNull())).alias("superseded"))
    bad = conflicts(clusters, links).select(F.explode("link_ids").alias("id")).distinct().withColumn("conflict", F.lit(True))
    out = links.select("id", "status").join(superseded, "id", "left").join(orphans(links, quads), "id", "left").join(bad, "id", "left")
    if expanded is None:
        mismatch = F.lit(False)
    else:
        confirmed = links.where(F.col("status").isin(*CONFIRMED) & (F.size("types_a") > 0) & (F.size("types_b") > 0)).select("id", "types_a", "types_b")
        g = _groups_of_link_types(confirmed, expanded)
        none = F.array().cast("array<int>")
        both = confirmed.select("id")
        for s in "ab":
            both = both.join(g.where(F.col("source") == s).select(F.col("iri").alias("id"), F.col("groups").alias(f"g_{s}"), F.col("primary").alias(f"p_{s}")), "id", "left")
        both = both.select("id", closures.shared_group(*[F.coalesce(c, none) for c in ("g_a", "p_a", "g_b", "p_b")]).isNull().alias("mm"))
        out = out.join(both, "id", "left")
        mismatch = F.coalesce("mm", F.lit(False))
    no = F.lit(False)
    return out.select("id", F.coalesce("superseded", no).alias("superseded"), "orphan_a", "orphan_b",
                      mismatch.alias("type_mismatch"), F.coalesce("conflict", no).alias("conflict"))


def filter_links(links, flags=None, pair=None, statuses=None, group=None, min_score=None, q=None,
                 include_superseded=False, include_orphaned=False) -> DataFrame:
    """Links passing every given filter; ``min_score`` concerns proposals only."""
    if pair:
        a, b = sorted(pair)
        links = links.where((F.col("source_a") == a) & (F.col("source_b") == b))
    if statuses:
        links = links.where(F.col("status").isin(*statuses))
    if group:
        links = links.where(F.col("group_id") == group)
    if min_score is not None:
        links = links.where((F.col("status") != "PROPOSED") | (F.coalesce("score", F.lit(-1.0)) >= min_score))
    if q and q.strip():
        want = fold(F.lit(q.strip()))
        cond = F.lit(False)
        for c in ("label_a", "label_b", "iri_a", "iri_b"):
            cond = cond | fold(c).contains(want)
        links = links.where(cond)
    if flags is not None:
        f = flags
        hide = F.lit(False)
        if not include_superseded:
            hide = hide | F.col("superseded")
        if not include_orphaned:
            hide = hide | F.col("orphan_a") | F.col("orphan_b")
        links = links.join(f.where(hide).select("id"), "id", "left_anti")
    return links


def page_links(links, offset=0, limit=50):
    """(page, total): score descending with unscored links last, then label and IRI."""
    ordered = links.orderBy(
        F.coalesce("score", F.lit(-1.0)).desc(), F.coalesce("label_a", "iri_a"), "iri_b", "id"
    )
    return ordered.offset(max(0, offset)).limit(max(1, limit)), links.agg(F.count(F.lit(1)).alias("total"))


def fill_snapshots(links, quads) -> DataFrame:
    """Fill missing labels (linked text in any source) and types (own source) of links."""
    from quadweave.operators.profiles import linked_text

    nodes = links.select(F.explode(F.array(*[
        F.struct(F.col(f"source_{s}").alias("source"), F.col(f"iri_{s}").alias("s")) for s in "ab"])).alias("e")).select("e.*").distinct()
    text = linked_text(quads.join(nodes.select("s").distinct(), "s", "left_semi"))
    types = (
        data_quads(quads).where(F.col("p") == RDF_TYPE).join(nodes, ["source", "s"], "left_semi")
        .groupBy("source", F.col("s").alias("iri")).agg(F.array_sort(F.collect_set("o")).alias("t"))
    )
    out = links
    for s in "ab":
        out = out.join(text.select(F.col("iri").alias(f"iri_{s}"), F.col("text").alias("_x")), f"iri_{s}", "left")
        out = out.join(types.select(F.col("source").alias(f"source_{s}"), F.col("iri").alias(f"iri_{s}"), F.col("t").alias("_t")),
                       [f"source_{s}", f"iri_{s}"], "left")
        empty = F.coalesce(F.size(f"types_{s}") <= 0, F.lit(True))
        out = (out.withColumn(f"label_{s}", F.coalesce(f"label_{s}", "_x"))
               .withColumn(f"types_{s}", F.when(empty, F.coalesce("_t", F.array().cast("array<string>"))).otherwise(F.col(f"types_{s}"))).drop("_x", "_t"))
    return out.select(*links.columns)


def dry_run(links, change, identical, now=None) -> dict:
    """Outcome of ``change(links) -> Decided`` without writing anything.

    Frames: ``report``, ``links`` (after reconciliation), ``changed``, ``inferred_added``,
    ``inferred_removed``, ``conflicts``.
    """
    decided = change(links)
    after = build_clusters(decided.links, identical) if decided.clusters is None else decided.clusters
    r = cut_lineage(reconcile(decided.links, after, identical, now))
    result = r.where("change is null or change <> 'removed'").drop("change")
    applied = decided.report.where("result = 'applied'").select("id")
    return {
        "report": decided.report,
        "revoked": decided.revoked,
        "links": result,
        "changed": result.join(applied, "id", "left_semi"),
        "inferred_added": r.where("change = 'added'").drop("change"),
        "inferred_removed": r.where("change = 'removed'").drop("change"),
        "conflicts": conflicts(after, decided.links),
    }


# --- overview -------------------------------------------------------------------------------


def last_revocation(*revocations):
    """The latest time in tables of revocations (see :class:`Decided`), for :func:`stale_reasons`; None without any."""
    times = [r.agg(F.max("revoked_at")).first()[0] for r in revocations]
    return max((t for t in times if t is not None), default=None)


def stale_reasons(pairs, sources, configuration_hash, revoked_at) -> DataFrame:
    """Add ``stale`` to (source_a, source_b, started_at, configuration_hash) rows.

    ``sources`` is (short_name, last_change). No reason is given when a source is gone.
    """
    out = pairs
    for s in "ab":
        out = out.join(sources.select(F.col("short_name").alias(f"source_{s}"), F.col("last_change").alias(f"_c{s}"), F.lit(True).alias(f"_h{s}")), f"source_{s}", "left")
    ran = F.col("started_at")
    newer = F.coalesce(F.greatest("_ca", "_cb") > ran, F.lit(False))
    revoked = F.lit(revoked_at).cast("timestamp")
    never = F.col("configuration_hash").isNull() & ran.isNull()
    reasons = F.array_compact(F.array(
        F.when(never, "neverRun"),
        F.when(~never & newer, "dataChanged"),
        F.when(~never & ~F.col("configuration_hash").eqNullSafe(F.lit(configuration_hash)) & F.lit(configuration_hash is not None), "configurationChanged"),
        F.when(~never & F.coalesce(revoked > ran, F.lit(False)), "decisionsRevoked"),
    ))
    there = F.col("_ha").isNotNull() & F.col("_hb").isNotNull()
    return out.withColumn("stale", F.when(there, reasons).otherwise(F.array().cast("array<string>"))).drop("_ca", "_cb", "_ha", "_hb")


def overview(links, flags, sources, runs, configuration_hash=None, revoked_at=None) -> DataFrame:
    """One row per pair of sources: counts per status, to review, superseded, orphaned, staleness.

    ``sources`` is the catalogue (its square is the size of the result); pairs of deleted sources
    still holding links are kept.
    """
    a = sources.select(F.col("short_name").alias("source_a"))
    b = sources.select(F.col("short_name").alias("source_b"))
    known = a.join(b, F.col("source_a") < F.col("source_b"))
    f = links.select("id", "source_a", "source_b", "status").join(flags, "id", "left")
    proposed = F.col("status") == "PROPOSED"
    counts = f.groupBy("source_a", "source_b").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES],
        F.count_if(proposed & ~F.coalesce("superseded", F.lit(False))).alias("to_review"),
        F.count_if(proposed & F.coalesce("superseded", F.lit(False))).alias("superseded"),
        F.count_if(F.col("orphan_a") | F.col("orphan_b")).alias("orphaned"),
    )
    names = [s.lower() for s in STATUSES] + ["to_review", "superseded", "orphaned"]
    out = known.join(counts, ["source_a", "source_b"], "full_outer").join(runs, ["source_a", "source_b"], "left")
    out = stale_reasons(out, sources, configuration_hash, revoked_at)
    return out.select(source_pair_key("source_a", "source_b").alias("pair"), "source_a", "source_b",
                      *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names], "started_at", "stale")


def search_matchable(profiles, source, clusters, q=None, group_members=None, unmatched_with=None, limit=50) -> DataFrame:
    """Entities of a source for a picker, with their cluster mates.

    ``group_members`` (source, iri) restricts to a group; ``unmatched_with`` leaves out entities
    that already have a counterpart in that source.
    """
    p = profiles.where(F.col("source") == source)
    if group_members is not None:
        p = p.join(group_members.select("source", "iri").distinct(), ["source", "iri"], "left_semi")
    if q and q.strip():
        want = fold(F.lit(q.strip()))
        p = p.where(fold(F.coalesce("label", "iri")).contains(want) | fold("iri").contains(want))
    p = p.join(clusters, ["source", "iri"], "left")
    if unmatched_with:
        held = clusters.where(F.col("source") == unmatched_with).select("cluster_id").distinct()
        p = p.join(held, "cluster_id", "left_anti")
    page = p.orderBy(F.when(F.col("label").isNull(), 1).otherwise(0), fold("label"), "iri").limit(limit)
    mates = clusters.join(F.broadcast(page.select("cluster_id", F.col("iri").alias("own")).where("cluster_id is not null")), "cluster_id").where(
        ~((F.col("source") == source) & (F.col("iri") == F.col("own"))))
    mates = mates.groupBy(F.col("own").alias("iri")).agg(F.array_sort(F.collect_set(F.struct("source", "iri"))).alias("matched_with"))
    return page.join(mates, "iri", "left").select("source", "iri", "types", "label", "matched_with").orderBy(
        F.when(F.col("label").isNull(), 1).otherwise(0), fold("label"), "iri")


def eligible_entities(entities, clusters, other, compare_untyped=False):
    """(eligible, counts): entities a run against ``other`` considers, and why others are left out.

    ``entities`` as from the matching plan (groups, untyped).
    """
    held = clusters.where(F.col("source") == other).select("cluster_id").distinct()
    matched = clusters.join(held, "cluster_id", "left_semi").select("source", "iri", F.lit(True).alias("m"))
    e = entities.join(matched, ["source", "iri"], "left")
    why = (
        F.when(F.col("untyped") & F.lit(not compare_untyped), "untyped")
        .when(~F.col("untyped") & (F.size("groups") == 0), "not_in_any_group")
        .when(F.col("m"), "already_matched")
        .otherwise("eligible")
    )
    e = e.withColumn("reason", why).drop("m")
    return e.where("reason = 'eligible'").drop("reason"), e.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("entities"))


def compare_pairs(pairs, quads, links, cfg, edges=None) -> DataFrame:
    """Side-by-side comparison of entity pairs: score, evidence in request order, what blocks a link.

    Adds group_id, score, compared_weight, evidence, outcome, link_id, link_status,
    ``blocking`` and the predicates of each concept present on each side.
    """
    from quadweave.operators.patterns import identical_iris
    from quadweave.plans.config import concept_predicates
    from quadweave.plans.matching import score_given_pairs

    swap = F.col("source_a") > F.col("source_b")
    req = pairs.select(*PAIR).distinct()
    canon = req.select(
        *[F.col(c).alias("q_" + c) for c in PAIR], swap.alias("swapped"),
        F.when(swap, F.col("source_b")).otherwise(F.col("source_a")).alias("source_a"),
        F.when(swap, F.col("iri_b")).otherwise(F.col("iri_a")).alias("iri_a"),
        F.when(swap, F.col("source_a")).otherwise(F.col("source_b")).alias("source_b"),
        F.when(swap, F.col("iri_a")).otherwise(F.col("iri_b")).alias("iri_b"),
    )
    clusters = build_clusters(links, identical_iris(quads))
    scored = score_given_pairs(canon, quads, cfg, clusters, edges)
    old = links.select(*PAIR, F.col("id").alias("link_id"), F.col("status").alias("link_status"))
    out = merge_violations(scored.join(old, PAIR, "left").withColumn("id", F.col("link_id")), clusters, links)
    blocking = F.when(F.col("link_status").isin(*CONFIRMED, "INFERRED"), F.lit("ALREADY_LINKED")).otherwise(F.col("violation"))
    flipped = F.transform("evidence", lambda e: F.struct(
        e["concept"].alias("concept"), e["comparator"].alias("comparator"), e["weight"].alias("weight"),
        e["score"].alias("score"), e["value_b"].alias("value_a"), e["value_a"].alias("value_b")))
    out = out.withColumn("blocking", blocking).withColumn("evidence", F.when(F.col("swapped"), flipped).otherwise(F.col("evidence")))
    preds = F.broadcast(concept_predicates(quads.sparkSession, cfg).select("group_id", "concept", "p"))
    for s in "ab":
        seen = (
            out.select("q_source_a", "q_iri_a", "q_source_b", "q_iri_b", "group_id", F.col(f"q_source_{s}").alias("source"), F.col(f"q_iri_{s}").alias("s"))
            .join(data_quads(quads).select("source", "s", "p").distinct(), ["source", "s"])
            .join(preds, ["group_id", "p"])
            .groupBy("q_source_a", "q_iri_a", "q_source_b", "q_iri_b")
            .agg(F.array_sort(F.collect_set(F.struct("concept", "p"))).alias(f"predicates_{s}"))
        )
        out = out.join(seen, ["q_source_a", "q_iri_a", "q_source_b", "q_iri_b"], "left")
    return out.select(*[F.col("q_" + c).alias(c) for c in PAIR], "group_id", "score", "compared_weight", "evidence", "outcome",
                      "link_id", "link_status", "blocking", "predicates_a", "predicates_b")
