"""Matching runs: eligible entities -> candidate pairs -> exclusions -> scores -> proposals.

Stages are written out where they are used several times (entity classes, scored pairs), which also
keeps a run restartable when executors are lost.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quadweave.functions import cells
from quadweave.functions.iri import link_id, node_key, node_pair_key
from quadweave.operators import blocking, closures
from quadweave.operators.clusters import build_clusters
from quadweave.operators.compare import score_pairs, with_features
from quadweave.operators.patterns import identical_iris
from quadweave.operators.profiles import (
    concept_values, full_values, has_linked_values, numbered_values, profiles, resolve_values, slim_values,
)
from quadweave.plans.config import config_hash, is_keyed_group, per_group
from quadweave.runtime import ROWS_PER_TASK, broadcast_if_small, cut_lineage, dealt_join, release
from quadweave.vocab import CONFIRMED, EVIDENCE_TYPE


@dataclass
class MatchingRun:
    """Frames of a run; each is computed when used."""

    # Per pair of sources, reason, outcome and score: how many pairs of entities (see score_classes). What
    # cells scored of pairs whose evidence cannot suffice is told, ``examined`` is without it.
    scored: DataFrame
    # Pairs of classes with their features that were counted without a score.
    hopeless: DataFrame
    entities: DataFrame
    modes: DataFrame
    identical: DataFrame
    classes: DataFrame
    members: DataFrame
    values: DataFrame
    cfg: object

    @cached_property
    def examined(self) -> DataFrame:
        return self.scored.withColumn("score", F.when(F.col("reason").isNull() & F.col("feasible"), F.col("score")))

    @cached_property
    def proposals(self) -> DataFrame:
        """Pairs with score and evidence; the best partners of each class are written when they are first asked for."""
        best = keep_best_proposals(self.examined.where("outcome = 'PROPOSABLE'"), self.members, self.cfg.max_proposals)
        return with_displays(best, self.values).withColumn("group_id", per_group(self.cfg, lambda g: g.id)).drop("group_order", "rank")


def rejected_clusters(links, clusters) -> DataFrame:
    """(cluster_a, cluster_b, pair): clusters holding the ends of a rejected link, both ways."""
    r = links.where("status = 'REJECTED'").select("source_a", "iri_a", "source_b", "iri_b")
    ends = r.select(F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("iri_a").alias("iri")),
                                      F.struct(F.col("source_b").alias("source"), F.col("iri_b").alias("iri")))).alias("e"))
    known = clusters.join(ends.select("e.source", "e.iri").distinct(), ["source", "iri"], "left_semi")
    for side in "ab":
        ids = known.select(F.col("source").alias(f"source_{side}"), F.col("iri").alias(f"iri_{side}"),
                           F.col("cluster_id").alias(f"c_{side}"))
        r = r.join(ids, [f"source_{side}", f"iri_{side}"], "left").withColumn(
            f"cluster_{side}", F.coalesce(f"c_{side}", node_key(f"source_{side}", f"iri_{side}"))
        ).drop(f"c_{side}")
    pair = F.struct("source_a", "iri_a", "source_b", "iri_b").alias("pair")
    one = r.select("cluster_a", "cluster_b", pair)
    return one.unionByName(one.select(F.col("cluster_b").alias("cluster_a"), F.col("cluster_a").alias("cluster_b"), "pair")).distinct()


def entity_frame(quads, cfg, expanded, sources=None) -> DataFrame:
    """Profiles with their groups: (source, iri, types, label, groups, primary, untyped)."""
    prof = profiles(quads if sources is None else quads.where(F.col("source").isin(sources)), cfg)
    typed = prof.select("source", "iri", F.explode("types").alias("type"))
    groups = closures.groups_of(typed, expanded)
    none = F.array().cast("array<int>")
    return prof.join(groups, ["source", "iri"], "left").select(
        "source", "iri", "types", "label",
        F.coalesce("groups", none).alias("groups"),
        F.coalesce("primary", none).alias("primary"),
        (F.size("types") == 0).alias("untyped"),
    )


def ranked_values(quads, cfg, expanded, sources=None) -> DataFrame:
    """Resolved concept values with the rank of their group, dealt out by entity.

    An entity's values are then numbered and brought together where they are, and move once.
    """
    own = quads if sources is None else quads.where(F.col("source").isin(sources))
    ranks = expanded.select("group_order", "rank").distinct()
    linked = has_linked_values(own, cfg)
    values = slim_values(resolve_values(concept_values(own, cfg, dealt=not linked), quads, linked))
    if linked:
        values = values.repartition("source", "iri")
    # One row per configured group.
    return full_values(values.join(F.broadcast(ranks), "group_order"))


def entity_classes(entities, values, clusters, rejected, cfg):
    """Fold interchangeable entities: (classes, members); a class carries its blocking keys.

    Everything that decides candidates and scores is part of the class digest: groups, the compared
    values in order, the sources of the entity's cluster, and the entity itself when it takes part
    in a rejected link.
    """
    grouped = F.size("groups") > 0
    eligible = entities.where(grouped | F.col("untyped") if cfg.compare_untyped else grouped)
    own = clusters.select("source", "iri", "cluster_id")
    around = own.groupBy("cluster_id").agg(F.array_sort(F.collect_set("source")).alias("around"))
    own = own.join(around, "cluster_id")
    e = eligible.join(own, ["source", "iri"], "left").select(
        *[c for c in eligible.columns if c not in ("types", "label")],
        F.coalesce("around", F.array("source")).alias("sources_in_cluster"),
        F.coalesce("cluster_id", node_key("source", "iri")).alias("cluster"),
    )
    if rejected is not None:
        hot = broadcast_if_small(rejected.select(F.col("cluster_a").alias("cluster")).distinct().withColumn("special", F.lit(True)))
        e = e.join(hot, "cluster", "left")
    else:
        e = e.withColumn("special", F.lit(None).cast("boolean"))

    linked = any(c.comparator in ("linkedEntity", "auto") for g in cfg.groups for c in g.concepts)
    by_iri = clusters.groupBy("iri").agg(F.min("cluster_id").alias("cluster_id")) if linked else None
    # A literal decides its resolved value; what a linked entity stands for is added.
    linked_cv = F.when(F.col("o_kind") == "iri", F.col("cv")).alias("cv")
    numbered = full_values(numbered_values(slim_values(values)))
    feats = (
        with_features(numbered, by_iri, cfg.long_text)
        .withColumn("digest", F.sha2(F.to_json(F.struct("o", "o_kind", "o_datatype", "o_lang", linked_cv, "feature.cluster")), 256))
        .withColumn("keys", F.when(F.col("keyed"), blocking.value_keys(F.col("comparator"), F.col("cv"), cfg.prefix_key)))
        .groupBy("source", "iri")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "concept_no", "pos", "digest", "feature"))).alias("vals"),
             F.collect_set(F.when(F.size("keys") > 0, F.struct("rank", "keys"))).alias("keys"))
    )
    e = e.join(feats, ["source", "iri"], "left")
    usable = F.filter(F.coalesce("vals", F.array()), lambda v: F.col("untyped") | F.array_contains("groups", v["rank"]))
    e = e.withColumn("vals", usable)
    alone = F.coalesce("special", F.lit(False))
    digest = F.sha2(
        F.to_json(
            F.struct(
                "source", "groups", "primary", "untyped", "sources_in_cluster",
                F.transform("vals", lambda v: F.struct(v["rank"].alias("r"), v["concept_no"].alias("c"), v["digest"].alias("d"))).alias("v"),
                F.when(alone, F.col("iri")).alias("iri"),
            )
        ),
        256,
    )
    e = cut_lineage(
        e.select(
            "source", "iri", "groups", "primary", "untyped", "sources_in_cluster",
            F.when(F.col("special"), F.col("cluster")).alias("cluster"),
            digest.alias("class_id"),
            F.transform("vals", lambda v: v["feature"]).alias("features"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(
                F.coalesce("keys", F.array().cast("array<struct<rank:int,keys:array<string>>>")),
                lambda v: F.transform(v["keys"], lambda k: F.struct(v["rank"].alias("rank"), k.alias("key"))))))).alias("keys"),
        )
    )
    members = cut_lineage(e.select("class_id", "source", "iri"))
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.min("iri").alias("rep"))
    # The representative's row stands for the class: a join, so that features are never aggregated.
    classes = cut_lineage(
        e.join(sizes, "class_id").where("iri = rep").select(
            "class_id", "source", "groups", "primary", "untyped", "sources_in_cluster", "cluster", "n", "rep",
            F.array_distinct(F.transform("features", lambda f: F.struct(f["g"].alias("g"), f["c"].alias("c")))).alias("concepts"),
            F.size("features").alias("n_values"), "features", "keys",
        )
    )
    release(e)
    return classes, members


def score_classes(pairs, cfg) -> DataFrame:
    """What became of examined pairs: (source_a, source_b, rank, group_order, reason, feasible, score, outcome, pairs, ...).

    Each pair is scored where it was formed, unless it is excluded or its evidence cannot suffice. One
    row stands for all pairs of two sources that ended alike, ``pairs`` of entities; proposable pairs
    of classes have a row each, with ``class_a``, ``class_b``, ``compared_weight`` and ``evidence``.
    """
    todo = F.col("reason").isNull() & F.col("feasible")
    none = F.array().cast(dict(pairs.dtypes)["features_a"])
    p = pairs.select("*", *[F.when(todo, F.col(f"features_{s}")).otherwise(none).alias(f"f_{s}") for s in "ab"]).drop("features_a", "features_b")
    p = score_pairs(p, cfg)
    good = todo & (F.col("outcome") == "PROPOSABLE")
    own = [F.when(good, F.col(c)).alias(c) for c in ("class_a", "class_b", "compared_weight", "evidence")]
    ended = p.select(
        "source_a", "source_b", "rank", "group_order", "reason", "feasible",
        *[F.when(todo, F.col(c)).alias(c) for c in ("score", "outcome")], *own, (F.col("n_a") * F.col("n_b")).alias("pairs"))
    return added_up(ended)


def added_up(ended) -> DataFrame:
    return ended.groupBy(*[c for c in ended.columns if c != "pairs"]).agg(F.sum("pairs").alias("pairs"))


def scored_in_cells(cfg, rejected) -> bool:
    """Whether pairs under keys can be scored without a row for each: no letters to compare, no rejected link to look up."""
    return rejected is None and all(c.comparator in cells.COMPARATORS for g in cfg.groups for c in g.concepts)


def score_cells(classes, modes, cfg, order_of_rank) -> DataFrame:
    """The result of :func:`score_classes` for pairs that share a key; hopeless pairs keep their score."""
    # One row per configured group.
    rank_of = {r["group_order"]: r["rank"] for r in order_of_rank.collect()}
    rules = {}
    for i, g in enumerate(cfg.groups):
        if i in rank_of:
            of = [(c.key, c.comparator, c.weight, bool(c.options.get("caseSensitive", False)), float(c.options.get("partialOverlapScore", 0.85)),
                   float(c.options.get("tolerance", 0))) for c in g.concepts]
            rules[rank_of[i]] = cells.Rules(i, of, list(g.required), g.minimum_weight, g.threshold)
    rows = blocking.cell_rows(classes, modes, cfg, rank_of)
    found = rows.mapInArrow(cells.scorer(rules), from_arrow_schema(cells.SCHEMA))
    return added_up(found)


def keep_best_proposals(scored, members, k, target=ROWS_PER_TASK) -> DataFrame:
    """Pairs among the ``k`` best of either entity, from class scores.

    Order: score descending, IRI of a, IRI of b. All members of a class share one ranking of
    partners, and of a partner class only its ``k`` smallest IRIs can be among the best, so ranking
    is done per class and the result is expanded to members afterwards, by tasks of about
    ``target`` proposals.
    """
    w = Window.partitionBy("class_id").orderBy("iri")
    heads = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("class_id", "iri")

    def best_of(own, other):
        return cut_lineage(
            scored.join(heads.select(F.col("class_id").alias(f"class_{other}"), F.col("iri").alias(f"iri_{other}")), f"class_{other}")
            .withColumn(
                "r",
                F.row_number().over(
                    Window.partitionBy(f"class_{own}", f"source_{other}").orderBy(F.desc("score"), f"iri_{other}")
                ),
            )
            .where(F.col("r") <= k)
            .drop("r")
        )

    def expanded(best, own, other):
        mine = members.select(F.col("class_id").alias(f"class_{own}"), F.col("iri").alias(f"iri_{own}"))
        return dealt_join(best, mine, [f"class_{own}"], [f"class_{other}", f"iri_{other}"], [f"iri_{own}"], target)[0]

    cols = ["source_a", "iri_a", "source_b", "iri_b", "rank", "group_order", "score", "compared_weight", "evidence"]
    best_a, best_b = best_of("a", "b"), best_of("b", "a")
    # A pair is found from both sides where each entity is among the other's best: the first side knows
    # at most ``k`` entities of a class, so the second leaves them out before proposals are made.
    found = best_a.groupBy("class_a", "class_b").agg(F.collect_list(F.struct("iri_b")).alias("found"))
    again = F.exists("found", lambda x: x["iri_b"].eqNullSafe(F.col("iri_b")))
    from_a = expanded(best_a, "a", "b")
    from_b = expanded(best_b.join(found, ["class_a", "class_b"], "left"), "b", "a").where(~F.coalesce(again, F.lit(False)))
    return from_a.select(*cols).unionByName(from_b.select(*cols))


def with_displays(proposals, values) -> DataFrame:
    """Replace value positions in the evidence by the values shown to a reader."""
    shown = (
        full_values(numbered_values(slim_values(values)))
        .select("source", "iri", "rank", "concept_no", "pos", F.col("cv")["display"].alias("display"))
        .groupBy("source", "iri")
        .agg(F.collect_list(F.struct("rank", "concept_no", "pos", "display")).alias("shown"))
    )
    out = proposals
    for side in "ab":
        out = out.join(
            shown.select(F.col("source").alias(f"source_{side}"), F.col("iri").alias(f"iri_{side}"), F.col("shown").alias(f"shown_{side}")),
            [f"source_{side}", f"iri_{side}"],
            "left",
        )

    def text(side, e):
        return F.filter(
            f"shown_{side}",
            lambda v: (v["rank"] == F.col("rank")) & (v["concept_no"] == e["no"]) & (v["pos"] == e[f"pos_{side}"]),
        )[0]["display"]

    evidence = F.transform(
        "evidence",
        lambda e: F.struct(
            e["concept"].alias("concept"), e["comparator"].alias("comparator"), e["weight"].alias("weight"),
            e["score"].alias("score"), text("a", e).alias("value_a"), text("b", e).alias("value_b"),
        ),
    ).cast(EVIDENCE_TYPE)
    return out.withColumn("evidence", evidence).drop("shown_a", "shown_b")


def run_all_pairs(quads, links, cfg, edges=None, sources=None) -> MatchingRun:
    """Match every pair of data sources (or of the listed ones) in one job."""
    spark = quads.sparkSession
    data = quads.where("graph_kind = 'data'")
    identical = identical_iris(data)
    clusters = build_clusters(links, identical)
    any_rejected = links.where("status = 'REJECTED'").limit(1).count() > 0
    rejected = cut_lineage(rejected_clusters(links, clusters)) if any_rejected else None
    expanded = cut_lineage(closures.expanded_groups(spark, cfg, edges))
    order_of_rank = expanded.select("rank", "group_order").distinct()
    entities = entity_frame(data, cfg, expanded, sources)
    # Not written: read here once, and again only where evidence is shown.
    values = ranked_values(data, cfg, expanded, sources)
    classes, members = entity_classes(entities, values, clusters, rejected, cfg)
    modes = blocking.group_sizes(classes, cfg).join(F.broadcast(order_of_rank), "rank").withColumn(
        "blocked",
        per_group(cfg, is_keyed_group),
    )
    modes = cut_lineage(modes)
    in_cells = scored_in_cells(cfg, rejected)
    met = blocking.examine_pairs(blocking.class_pairs(classes, modes, cfg, in_cells), rejected, cfg, order_of_rank)
    scored = score_classes(met, cfg)
    if in_cells and modes.where("blocked").limit(1).count() > 0:
        scored = scored.unionByName(score_cells(classes, modes, cfg, order_of_rank))
    scored = cut_lineage(scored)
    hopeless = met.where("reason is null and not feasible")
    return MatchingRun(scored, hopeless, entities, modes, identical, classes, members, values, cfg)


def run_matching(quads, links, cfg, source_a, source_b, edges=None) -> MatchingRun:
    """Match two data sources."""
    return run_all_pairs(quads, links, cfg, edges, sorted([source_a, source_b]))


def run_summary(run: MatchingRun) -> DataFrame:
    """Counters per pair of sources; see the README for the two that are derived."""
    cfg = run.cfg
    per = blocking.eligibility(run.entities)
    a = per.select(*[F.col(c).alias(f"{c}_a") for c in per.columns])
    b = per.select(*[F.col(c).alias(f"{c}_b") for c in per.columns])
    pairs = a.join(b, F.col("source_a") < F.col("source_b"))
    keys = ["source_a", "source_b"]
    matched = (
        run.classes.select("source", "n", F.explode("sources_in_cluster").alias("other"))
        .where("source <> other").groupBy("source", "other").agg(F.sum("n").alias("m"))
    )
    for x, y in (("a", "b"), ("b", "a")):
        pairs = pairs.join(
            matched.select(F.col("source").alias(f"source_{x}"), F.col("other").alias(f"source_{y}"), F.col("m").alias(f"excluded_matched_{x}")),
            keys, "left")
    same = (
        run.identical.select(F.explode("sources").alias("source_a"), "sources")
        .select("source_a", F.explode("sources").alias("source_b")).where("source_a < source_b")
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("identical_iris"))
    )
    possible = run.modes.groupBy(*keys).agg(F.sum("pairs").alias("possible_pairs"))
    if cfg.compare_untyped:
        side = run.classes.groupBy("source").agg(
            F.sum(F.when(F.col("untyped"), F.col("n")).otherwise(0)).alias("u"),
            F.sum(F.when(~F.col("untyped"), F.col("n")).otherwise(0)).alias("t"))
        gone = run.classes.select("source", "n", "untyped", F.explode("sources_in_cluster").alias("other")).where("source <> other").groupBy("source", "other").agg(
            F.sum(F.when(F.col("untyped"), F.col("n")).otherwise(0)).alias("gu"),
            F.sum(F.when(~F.col("untyped"), F.col("n")).otherwise(0)).alias("gt"))
        sa, sb = (side.select(F.col("source").alias(f"source_{s}"), F.col("u").alias(f"u_{s}"), F.col("t").alias(f"t_{s}")) for s in "ab")
        m = pairs.select(*keys).join(sa, "source_a").join(sb, "source_b")
        for x, y in (("a", "b"), ("b", "a")):
            m = m.join(gone.select(F.col("source").alias(f"source_{x}"), F.col("other").alias(f"source_{y}"), F.col("gu").alias(f"gu_{x}"), F.col("gt").alias(f"gt_{x}")), keys, "left")
        v = lambda c, s: F.col(f"{c}_{s}") - F.coalesce(F.col(f"g{c}_{s}"), F.lit(0))
        extra = m.select(*keys, (v("u", "a") * v("t", "b") + v("u", "b") * v("t", "a")).alias("extra"))
        possible = extra.join(possible, keys, "left").select(*keys, (F.coalesce("possible_pairs", F.lit(0)) + F.col("extra")).alias("possible_pairs"))
    of = lambda cond: F.sum(F.when(cond, F.col("pairs")))
    ex = run.examined.groupBy(*keys).agg(
        of(F.col("reason") == "REJECTED").alias("excluded_rejected"),
        of(F.col("reason") == "INVARIANT").alias("excluded_invariant"),
        of(F.col("reason").isNull()).alias("compared_pairs"),
        of(F.col("reason").isNull() & ~F.col("feasible")).alias("infeasible"),
        of(F.col("outcome") == "BELOW_THRESHOLD").alias("below_threshold"),
        of(F.col("outcome") == "INSUFFICIENT_EVIDENCE").alias("weak"),
    )
    kept = run.proposals.groupBy(*keys).agg(F.count(F.lit(1)).alias("proposals"))
    for f in (same, possible, ex, kept):
        pairs = pairs.join(f, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return pairs.select(
        "source_a", "source_b",
        *[F.col(f"{c}_{s}") for c in ("entities", "untyped", "not_in_any_group") for s in "ab"],
        *[zero(c).alias(c) for c in ("excluded_matched_a", "excluded_matched_b", "identical_iris", "possible_pairs",
                                     "compared_pairs", "excluded_rejected", "excluded_invariant", "below_threshold")],
        (zero("infeasible") + zero("weak")).alias("insufficient_evidence"),
        zero("proposals").alias("proposals"),
    )


def run_record(run: MatchingRun, started_at, finished_at) -> DataFrame:
    """The summary of a run with its start, its duration in milliseconds and its configuration's hash.

    These are the ``runs`` rows that :func:`quadweave.operators.links.overview` and ``stale_reasons`` read.
    """
    start, end = F.lit(started_at).cast("timestamp"), F.lit(finished_at).cast("timestamp")
    return run_summary(run).select(
        "*", start.alias("started_at"), (F.unix_millis(end) - F.unix_millis(start)).alias("duration_ms"), F.lit(config_hash(run.cfg)).alias("configuration_hash")
    )


def proposals_by_group(run: MatchingRun) -> DataFrame:
    return run.proposals.groupBy("source_a", "source_b", "group_id").agg(F.count(F.lit(1)).alias("proposals"))


def as_links(proposals, entities, proposed_at=None) -> DataFrame:
    """Proposals as PROPOSED links with labels and types."""
    at = F.current_timestamp() if proposed_at is None else F.lit(proposed_at).cast("timestamp")
    out = proposals
    for s in "ab":
        out = out.join(
            entities.select(F.col("source").alias(f"source_{s}"), F.col("iri").alias(f"iri_{s}"),
                            F.col("label").alias(f"label_{s}"), F.col("types").alias(f"types_{s}")),
            [f"source_{s}", f"iri_{s}"], "left")
    return out.select(
        link_id("source_a", "iri_a", "source_b", "iri_b").alias("id"),
        "source_a", "iri_a", "label_a", "types_a", "source_b", "iri_b", "label_b", "types_b",
        F.lit("PROPOSED").alias("status"), F.lit("ALGORITHM").alias("origin"), "group_id", "score",
        "compared_weight", "evidence", F.lit(None).cast("array<string>").alias("inferred_from"),
        at.alias("proposed_at"), F.lit(None).cast("timestamp").alias("decided_at"), F.lit(None).cast("string").alias("note"),
    )


def merge_proposals(links, proposals, source_pairs, entities=None) -> DataFrame:
    """Links after a run: the run's pairs lose their old proposals and gain the new ones.

    Decided links stay; a proposal whose pair already has a link is skipped. ``source_pairs``
    (source_a, source_b) are the pairs that were run. With ``entities``, labels and types of the
    links of those pairs are refreshed.
    """
    ran = broadcast_if_small(source_pairs.select("source_a", "source_b").distinct().withColumn("ran", F.lit(True)))
    kept = links.join(ran, ["source_a", "source_b"], "left").where(
        ~(F.coalesce("ran", F.lit(False)) & (F.col("status") == "PROPOSED"))
    )
    key = node_pair_key("source_a", "iri_a", "source_b", "iri_b")
    fresh = proposals.withColumn("_k", key).join(kept.select(key.alias("_k")), "_k", "left_anti").drop("_k")
    out = kept.unionByName(fresh.withColumn("ran", F.lit(True)))
    if entities is not None:
        for s in "ab":
            now = entities.select(F.col("source").alias(f"source_{s}"), F.col("iri").alias(f"iri_{s}"),
                                  F.col("label").alias("_l"), F.col("types").alias("_t"))
            out = out.join(now, [f"source_{s}", f"iri_{s}"], "left")
            known = F.col("ran") & F.col("_t").isNotNull()
            out = (out.withColumn(f"label_{s}", F.when(known, F.col("_l")).otherwise(F.col(f"label_{s}")))
                   .withColumn(f"types_{s}", F.when(known, F.col("_t")).otherwise(F.col(f"types_{s}"))).drop("_l", "_t"))
    return out.select(*links.columns)


# --- preview --------------------------------------------------------------------------------


def score_histogram(scores, bins=20) -> DataFrame:
    """(bin, pairs) over every compared pair, empty bins included.

    ``scores`` has ``score`` and optionally ``pairs``, the number of pairs of a row.
    """
    weight = F.col("pairs") if "pairs" in scores.columns else F.lit(1)
    n = scores.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.sum(weight).alias("pairs")
    )
    axis = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return axis.join(n, "bin", "left").select("bin", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"))


def proposal_diff(old, new):
    """(counts, rows): proposals added, removed and unchanged between two link tables."""
    keys = ["source_a", "iri_a", "source_b", "iri_b"]
    o = old.where("status = 'PROPOSED'").select(*keys, F.col("score").alias("old_score"), F.lit(True).alias("o"))
    n = new.select(*keys, F.col("score").alias("new_score"), F.lit(True).alias("n"))
    rows = o.join(n, keys, "full_outer").select(
        *keys, "old_score", "new_score",
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged").alias("change"),
    )
    return rows.groupBy("change").agg(F.count(F.lit(1)).alias("pairs")), rows


def score_given_pairs(pairs, quads, cfg, clusters, edges=None) -> DataFrame:
    """Score pairs (source_a, iri_a, source_b, iri_b), source_a < source_b, without exclusions.

    Adds group_id, score, compared_weight, evidence, outcome; pairs without a shared group have
    outcome NO_SHARED_GROUP.
    """
    spark = quads.sparkSession
    data = quads.where("graph_kind = 'data'")
    expanded = cut_lineage(closures.expanded_groups(spark, cfg, edges))
    order_of_rank = expanded.select("rank", "group_order").distinct()
    keys = ["source_a", "iri_a", "source_b", "iri_b"]
    nodes = pairs.select(F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("iri_a").alias("s")),
                                           F.struct(F.col("source_b").alias("source"), F.col("iri_b").alias("s")))).alias("e")).select("e.*").distinct()
    own = data.join(nodes, ["source", "s"], "left_semi")
    entities = entity_frame(own, cfg, expanded)
    ranks = F.broadcast(order_of_rank)
    values = resolve_values(concept_values(own, cfg), data).join(ranks, "group_order")
    by_iri = clusters.groupBy("iri").agg(F.min("cluster_id").alias("cluster_id"))
    feats = with_features(numbered_values(values), by_iri, cfg.long_text).groupBy("source", "iri").agg(
        F.array_sort(F.collect_list(F.struct("rank", "concept_no", "pos", "feature"))).alias("v"))
    p = pairs.select(*keys).distinct()
    for s in "ab":
        e = entities.join(feats, ["source", "iri"], "left").select(
            F.col("source").alias(f"source_{s}"), F.col("iri").alias(f"iri_{s}"), F.col("groups").alias(f"g_{s}"),
            F.col("primary").alias(f"p_{s}"), F.col("untyped").alias(f"u_{s}"),
            F.transform(F.coalesce("v", F.array()), lambda x: x["feature"]).alias(f"f_{s}"))
        p = p.join(e, [f"source_{s}", f"iri_{s}"], "left")
    shared = closures.shared_group(F.col("g_a"), F.col("p_a"), F.col("g_b"), F.col("p_b"),
                                   F.col("u_a") if cfg.compare_untyped else F.lit(False),
                                   F.col("u_b") if cfg.compare_untyped else F.lit(False))
    p = p.withColumn("rank", shared).select(*keys, "rank", "f_a", "f_b")
    found = p.where("rank is not null").join(ranks, "rank")
    scored = with_displays(score_pairs(found, cfg), values).withColumn("group_id", per_group(cfg, lambda g: g.id))
    cols = ["group_id", "score", "compared_weight", "evidence", "outcome"]
    return pairs.join(scored.select(*keys, *cols), keys, "left").withColumn(
        "outcome", F.coalesce("outcome", F.lit("NO_SHARED_GROUP"))
    )


def decision_agreement(links, quads, cfg, clusters, edges=None):
    """(counts, rows): decided links rescored without exclusions, against the decision taken."""
    decided = links.where(F.col("status").isin(*CONFIRMED, "REJECTED")).select(
        "id", "source_a", "iri_a", "source_b", "iri_b", "status")
    scored = score_given_pairs(decided, quads, cfg, clusters, edges)
    rows = scored.select(
        "id", "source_a", "iri_a", "source_b", "iri_b", "status", "group_id",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(F.col("status") == "REJECTED", "rejected").otherwise("confirmed").alias("decision"),
        F.when(F.col("outcome") == "PROPOSABLE", "above").otherwise("below").alias("side"),
    ).withColumn("surprising", (F.col("decision") == "confirmed") != (F.col("side") == "above"))
    return rows.groupBy("decision", "side").agg(F.count(F.lit(1)).alias("links")), rows


def preview(quads, links, cfg, source_a, source_b, edges=None) -> dict:
    """What a run with this configuration would give; nothing is written."""
    run = run_matching(quads, links, cfg, source_a, source_b, edges)
    first, second = sorted([source_a, source_b])
    own = links.where((F.col("source_a") == first) & (F.col("source_b") == second))
    counts, rows = proposal_diff(own, run.proposals)
    clusters = build_clusters(links, run.identical)
    agreement, decided = decision_agreement(own, quads, cfg, clusters, edges)
    return {
        "summary": run_summary(run),
        "proposals": run.proposals,
        "histogram": preview_histogram(run),
        "diff": counts,
        "diff_rows": rows,
        "agreement": agreement,
        "agreement_rows": decided,
    }


def preview_histogram(run: MatchingRun) -> DataFrame:
    """Histogram of a run. Pairs skipped because their evidence cannot suffice are scored here."""
    scores = run.scored.where("reason is null and score is not null").select("score", "pairs")
    if run.scored.where("reason is null and score is null").limit(1).count() > 0:
        rest = score_pairs(run.hopeless.withColumnsRenamed({"features_a": "f_a", "features_b": "f_b"}), run.cfg)
        scores = scores.unionByName(rest.select("score", (F.col("n_a") * F.col("n_b")).alias("pairs")))
    return score_histogram(scores)
