"""Candidate generation: entity classes, blocking keys, exclusions.

Entities of one source whose comparable values, groups and cluster situation are the same are
interchangeable: they get the same candidates and scores. They are folded into one *class* with a
count before any pair is formed, so a value shared by a third of all entities costs one class, not
a quadratic number of pairs. Members are put back after scoring, see ``plans.matching``.
"""

from pyspark.sql import Column, DataFrame, functions as F

from quadweave.functions.text import fold, normalize_folded, tokens_of_normalized
from quadweave.operators.closures import shared_group
from quadweave.runtime import broadcast_if_small, cut_lineage, skew_safe_join, tasks_for

# Values of a concept that meet in a cell, and of each of two parts of a key cut into cells.
CELL_VALUES = 1024
# Pairs that a task looks at in cells, and rows that it reads.
CELL_PAIRS, CELL_ROWS = 2_000_000, 10_000


def value_keys(comparator, cv, prefix=4) -> Column:
    """Blocking keys of one resolved value.

    ``e:`` the normalised exact value; ``y:`` each year of the interval; ``t:`` each word, and
    ``p:`` the first ``prefix`` letters of words that have as many (0: no such keys).
    """
    norm = normalize_folded(fold(cv["text"]))
    first = F.year(cv["date"]["start"])
    last = F.year(cv["date"]["end"])
    words = tokens_of_normalized(norm)
    stems = F.filter(words, lambda t: F.char_length(t) >= prefix) if prefix else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.when(
            (comparator == "exact") & cv["text"].isNotNull(),
            F.when(norm != "", F.array(F.concat(F.lit("e:"), norm))).otherwise(none),
        )
        .when(
            cv["date"]["start"].isNotNull(),
            F.transform(F.sequence(first, last), lambda y: F.concat(F.lit("y:"), y.cast("string"))),
        )
        .when(
            cv["text"].isNotNull(),
            F.array_union(
                F.transform(words, lambda t: F.concat(F.lit("t:"), t)),
                F.transform(stems, lambda t: F.concat(F.lit("p:"), F.substring(t, 1, prefix))),
            ),
        ),
        none,
    )


def blocking_keys(resolved, prefix=4) -> DataFrame:
    """(source, iri, rank, key): distinct keys of the values of keyed concepts."""
    return (
        resolved.where("keyed")
        .select("source", "iri", "rank", F.explode(value_keys(F.col("comparator"), F.col("cv"), prefix)).alias("key"))
        .distinct()
    )


def eligibility(entities) -> DataFrame:
    """Per source: entities, untyped, in no group."""
    return entities.groupBy("source").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if("untyped").alias("untyped"),
        F.count_if(~F.col("untyped") & (F.size("groups") == 0)).alias("not_in_any_group"),
    )


def group_sizes(classes, cfg) -> DataFrame:
    """(source_a, source_b, rank, group_order, pairs, blocked) for every two sources of a group.

    Sizes leave out entities already matched in the other source. The frame has at most
    sources^2 x groups rows.
    """
    per = classes.where(F.size("groups") > 0).select("source", F.explode("groups").alias("rank"), "n", "sources_in_cluster")
    total = per.groupBy("source", "rank").agg(F.sum("n").alias("n"))
    matched = (
        per.select("source", "rank", "n", F.explode("sources_in_cluster").alias("other"))
        .where("other <> source")
        .groupBy("source", "rank", "other")
        .agg(F.sum("n").alias("m"))
    )
    a = total.select(F.col("source").alias("source_a"), "rank", F.col("n").alias("na"))
    b = total.select(F.col("source").alias("source_b"), "rank", F.col("n").alias("nb"))
    ma = matched.select(F.col("source").alias("source_a"), "rank", F.col("other").alias("source_b"), F.col("m").alias("ma"))
    mb = matched.select(F.col("source").alias("source_b"), "rank", F.col("other").alias("source_a"), F.col("m").alias("mb"))
    both = (
        a.join(b, "rank").where("source_a < source_b")
        .join(ma, ["source_a", "source_b", "rank"], "left")
        .join(mb, ["source_a", "source_b", "rank"], "left")
    )
    size_a = F.col("na") - F.coalesce("ma", F.lit(0))
    size_b = F.col("nb") - F.coalesce("mb", F.lit(0))
    return (
        both.select("source_a", "source_b", "rank", (size_a * size_b).alias("pairs"))
        .where("pairs > 0")
    )


def _sided(classes, side):
    """Classes with every column of theirs under the side's suffix; ``rank`` and ``key`` keep their names."""
    name = lambda c: c if c in ("rank", "key") else f"class_{side}" if c == "class_id" else f"{c}_{side}"
    return classes.select(*[F.col(c).alias(name(c)) for c in classes.columns])


def _source_pairs(modes, cond):
    """(source_a, source_b, rank) of the modes that meet ``cond``, as a table that is broadcast if small."""
    return broadcast_if_small(cut_lineage(modes.where(cond).select("source_a", "source_b", "rank")))


def _keys_in(keys, rank):
    return F.filter(keys, lambda k: k["rank"] == rank)


def cell_rows(classes, modes, cfg, rank_of, size=CELL_VALUES) -> DataFrame:
    """Rows of groups with keys, sorted by cell: each class under each of its keys, with the values of its group.

    ``rank_of`` gives the rank of each group's number in the configuration. A key of more than ``size`` values is cut into parts, and every two parts meet in a cell of their
    own; the pairs of a cell are formed by ``functions.cells``, under the first key that both hold.
    """
    cut = _source_pairs(modes, "blocked")
    met = cut.select(F.col("source_a").alias("source"), "rank").unionByName(cut.select(F.col("source_b").alias("source"), "rank")).distinct()
    rank = F.col("rank")
    member = classes.where(F.size("groups") > 0).withColumn("rank", F.explode("groups")).join(met, ["source", "rank"], "left_semi")
    keys = F.transform(_keys_in("keys", rank), lambda k: k["key"])
    concepts = max(len(g.concepts) for g in cfg.groups)
    held = (
        member.withColumn("own", keys)
        .select("*", F.explode("own").alias("key"))
        .withColumn("weight", F.greatest(F.lit(1), F.ceil(F.col("n_values") / concepts)))
    )
    # One row per key; hot keys, which are listed for all tasks, stand for more than ``size`` values each.
    counts = cut_lineage(held.groupBy("rank", "key").agg(F.sum("weight").alias("size"), F.count(F.lit(1)).alias("rows")))
    parts = F.when(F.col("size") > size, F.ceil(F.col("size") / (size // 2))).otherwise(F.lit(1))
    hot = F.broadcast(counts.where(F.col("size") > size).select("rank", "key", parts.cast("int").alias("parts")))
    sums = counts.agg(F.sum(F.col("rows").cast("double") * F.col("rows") / 2).alias("pairs"), F.sum(F.col("rows") * parts).alias("rows")).first()
    tasks = max(tasks_for(int(sums["pairs"] or 0), CELL_PAIRS), tasks_for(int(sums["rows"] or 0), CELL_ROWS))
    values = F.transform(
        F.filter("features", lambda f: f["g"] == rank),
        lambda f: F.struct(
            f["c"].alias("c"), f["pos"].alias("pos"), F.when(_case_sensitive(cfg, rank_of, f), f["raw"]).otherwise(f["norm"]).alias("word"),
            F.array_join(f["words"], " ").alias("words"), F.unix_date(f["date"]["start"]).alias("start"), F.unix_date(f["date"]["end"]).alias("end"),
            f["date"]["day_precise"].alias("precise"), f["number"].alias("number")))
    situation = F.to_json(F.struct("source", "groups", "primary", "untyped", "sources_in_cluster"))
    cells = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j")))
    rows = (
        held.join(hot, ["rank", "key"], "left")
        .withColumn("part", F.pmod(F.xxhash64("class_id"), F.coalesce("parts", F.lit(1))).cast("int"))
        .select("rank", "key", "part", "class_id", "source", situation.alias("situation"), "n",
                F.filter("own", lambda k: k < F.col("key")).alias("earlier"), values.alias("values"), F.explode(cells).alias("cell"))
        .select("rank", "key", F.col("cell.i").alias("cell_i"), F.col("cell.j").alias("cell_j"), "part", "class_id", "source", "situation", "n", "earlier", "values")
    )
    cell = ["rank", "key", "cell_i", "cell_j"]
    return rows.repartition(tasks, *cell).sortWithinPartitions(*cell)


def _case_sensitive(cfg, rank_of, feature) -> Column:
    """Whether a feature's concept compares its text as it is written."""
    out = F.lit(False)
    for i, g in enumerate(cfg.groups):
        for n, c in enumerate(g.concepts):
            if c.options.get("caseSensitive"):
                out = out | ((feature["g"] == rank_of[i]) & (feature["c"] == n))
    return out


def class_pairs(classes, modes, cfg, in_cells=False) -> DataFrame:
    """Candidate class pairs, source_a < source_b, before exclusions: ``rank`` and both classes' columns.

    With ``in_cells``, pairs that share a key are left to :func:`cell_rows`. ``classes`` carry groups as ranks, ``keys`` as (rank, key) and whatever their pairs are examined
    and scored by; ``modes`` is the result of :func:`group_sizes` with ``blocked``. A class moves once
    per key and cell of the grid; its pairs are formed there and may be scored in the same task.
    """
    a, b = (lambda df: _sided(df, "a")), (lambda df: _sided(df, "b"))
    rank, has_group = F.col("rank"), F.size("groups") > 0
    member = classes.where(has_group).withColumn("rank", F.explode("groups"))
    cols = ["rank", *a(classes).columns, *b(classes).columns]
    parts = []
    # 1. Groups to be compared whole, or without blocking concepts: every pair of the group.
    if _any(modes.where("not blocked")):
        left = a(member).join(_source_pairs(modes, "not blocked"), ["source_a", "rank"])
        parts.append(skew_safe_join(left, b(member), ["source_b", "rank"], ["class_a"], ["class_b"]).select(*cols))

    # 2. Groups with keys: pairs sharing one, each formed under the first key that both hold.
    if _any(modes.where("blocked")):
        cut = _source_pairs(modes, "blocked")
        keyed = member.where(F.size(_keys_in("keys", rank)) > 0)
        if not in_cells:
            held = keyed.withColumn("key", F.explode(F.transform(_keys_in("keys", rank), lambda k: k["key"])))
            held_a, held_b = (held.join(cut.select(F.col(f"source_{s}").alias("source"), "rank").distinct(), ["source", "rank"], "left_semi") for s in "ab")
            shared = _keys_in(F.array_intersect("keys_a", "keys_b"), rank)
            met = skew_safe_join(a(held_a), b(held_b), ["rank", "key"], ["class_a"], ["class_b"]).where("source_a < source_b")
            parts.append(met.where(F.col("key") == F.array_min(shared)["key"]).join(cut, ["source_a", "source_b", "rank"], "left_semi").select(*cols))
        # 3. An entity without any key meets everyone of a blocked group.
        keyless = member.where(F.size(_keys_in("keys", rank)) == 0)
        if _any(keyless):
            kl = a(keyless).join(cut, ["source_a", "rank"])
            parts.append(skew_safe_join(kl, b(member), ["source_b", "rank"], ["class_a"], ["class_b"]).select(*cols))
            kr = b(keyless).join(cut, ["source_b", "rank"])
            parts.append(skew_safe_join(a(keyed), kr, ["source_a", "rank"], ["class_a"], ["class_b"]).select(*cols))

    # 4. Option: untyped entities against the typed ones, under the typed side's own group.
    if cfg.compare_untyped:
        free = classes.where("untyped").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(len(cfg.groups)))))
        typed = classes.where(~F.col("untyped") & has_group).withColumn("rank", F.array_min("primary"))
        for x, y in ((a(free), b(typed)), (a(typed), b(free))):
            met = skew_safe_join(x, y, ["rank"], ["class_a"], ["class_b"]).where("source_a < source_b")
            parts.append(met.select(*cols))
    if not parts:
        return a(member).where(F.lit(False)).join(b(member), "rank").select(*cols)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _any(df):
    """Whether a written frame has rows."""
    return df.limit(1).count() > 0


def examine_pairs(pairs, rejected, cfg, order_of_rank) -> DataFrame:
    """Keep pairs of :func:`class_pairs` emitted under their own shared group and give each its exclusion reason.

    ``reason`` is null, REJECTED or INVARIANT; pairs of entities already matched in the other
    source are dropped, as are the entities of such pairs. ``feasible`` tells whether the concepts
    both sides have values for could ever satisfy the group's evidence rules.
    """
    p = (
        pairs
        .where(
            shared_group(F.col("groups_a"), F.col("primary_a"), F.col("groups_b"), F.col("primary_b"),
                         F.col("untyped_a"), F.col("untyped_b")) == F.col("rank")
        )
        .where(~F.array_contains("sources_in_cluster_a", F.col("source_b"))
               & ~F.array_contains("sources_in_cluster_b", F.col("source_a")))
        .join(F.broadcast(order_of_rank), "rank")
    )
    crossing = F.arrays_overlap("sources_in_cluster_a", "sources_in_cluster_b")
    if rejected is not None:
        refused = broadcast_if_small(cut_lineage(rejected.groupBy("cluster_a", "cluster_b").agg(F.collect_set("pair").alias("refused"))))
        p = p.join(refused, ["cluster_a", "cluster_b"], "left")
        exact = F.array_contains("refused", F.struct(
            F.col("source_a").alias("source_a"), F.col("rep_a").alias("iri_a"),
            F.col("source_b").alias("source_b"), F.col("rep_b").alias("iri_b")))
        reason = (
            F.when(F.coalesce(exact, F.lit(False)), F.lit("REJECTED"))
            .when(crossing | F.col("refused").isNotNull(), F.lit("INVARIANT"))
        )
    else:
        reason = F.when(crossing, F.lit("INVARIANT"))
    return p.withColumn("reason", reason).withColumn("feasible", _feasible(cfg)).select(
        "class_a", "source_a", "n_a", "features_a", "class_b", "source_b", "n_b", "features_b", "rank", "group_order", "reason", "feasible"
    )


def _feasible(cfg) -> Column:
    """Whether common concepts can reach the minimum weight and cover the required ones."""
    common = F.array_intersect(
        F.transform(F.filter("concepts_a", lambda x: x["g"] == F.col("rank")), lambda x: x["c"]),
        F.transform(F.filter("concepts_b", lambda x: x["g"] == F.col("rank")), lambda x: x["c"]),
    )
    out = None
    for i, g in enumerate(cfg.groups):
        weights = F.array(*[F.lit(c.weight) for c in g.concepts]).cast("array<double>")
        required = F.array(*[F.lit(n) for n, c in enumerate(g.concepts) if c.key in g.required]).cast("array<int>")
        unknown = any(r not in {c.key for c in g.concepts} for r in g.required)
        reach = F.aggregate(common, F.lit(0.0), lambda acc, c: acc + F.element_at(weights, c + 1))
        ok = (
            F.lit(not unknown)
            & (F.size(common) > 0)
            & (reach >= g.minimum_weight)
            & (F.size(F.array_except(required, common)) == 0)
        )
        cond = F.col("group_order") == i
        out = F.when(cond, ok) if out is None else out.when(cond, ok)
    return F.coalesce(out, F.lit(False))
