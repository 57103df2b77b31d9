"""Class hierarchies: transitive closures, depth, and type groups."""

from pyspark.sql import DataFrame, Window, functions as F

from quadweave.plans.config import group_types
from quadweave.runtime import cut_lineage
from quadweave.vocab import SUBCLASS_OF


def subclass_edges(quads: DataFrame) -> DataFrame:
    """(sub, super) pairs stated between named classes."""
    return (
        quads.where((F.col("p") == SUBCLASS_OF) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri"))
        .select(F.col("s").alias("sub"), F.col("o").alias("super"))
        .where("sub <> super")
        .distinct()
    )


def _reach(edges, src, dst, start=None):
    """(origin, reached) pairs by repeated doubling of paths; terminates on cycles.

    Path doubling needs as many rounds as the logarithm of the longest chain. With ``start`` only
    paths from those nodes are followed, one step per round.
    """
    step = edges.select(F.col(src).alias("origin"), F.col(dst).alias("reached")).distinct()
    if start is not None:
        known = start.select(F.col("node").alias("origin"), F.col("node").alias("reached")).distinct()
    else:
        known = step
    known = cut_lineage(known)
    size = known.count()
    while True:
        hop = (step if start is not None else known).select(
            F.col("origin").alias("reached"), F.col("reached").alias("next")
        )
        more = known.join(hop, "reached").select("origin", F.col("next").alias("reached"))
        known = cut_lineage(known.unionByName(more).distinct(), replaces=known)
        grown = known.count()
        if grown == size:
            return known
        size = grown


def subclass_closure(edges: DataFrame, roots: DataFrame = None) -> DataFrame:
    """(root, type): every class with itself and its transitive subclasses.

    ``roots(node)`` restricts the closure; by default every class of ``edges`` is a root.
    """
    if roots is not None:
        pairs = _reach(edges, "super", "sub", roots)
    else:
        nodes = edges.select(F.explode(F.array("sub", "super")).alias("n")).distinct()
        pairs = _reach(edges, "super", "sub").unionByName(
            nodes.select(F.col("n").alias("origin"), F.col("n").alias("reached"))
        )
    return pairs.distinct().select(F.col("origin").alias("root"), F.col("reached").alias("type"))


def superclass_closure(edges: DataFrame, types: DataFrame = None) -> DataFrame:
    """(type, ancestor): every class with itself and all its ancestors."""
    flipped = edges.select(F.col("super").alias("sub"), F.col("sub").alias("super"))
    return subclass_closure(flipped, types).select(
        F.col("root").alias("type"), F.col("type").alias("ancestor")
    )


def with_subclasses(types, edges: DataFrame) -> DataFrame:
    """(type): the given types (a list, or a frame with ``type``) and everything below them."""
    if not isinstance(types, DataFrame):
        types = edges.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return subclass_closure(edges, types.select(F.col("type").alias("node"))).select("type").distinct()


def type_subclasses(edges: DataFrame, root: str) -> DataFrame:
    """(type): the root and everything below it."""
    start = edges.sparkSession.createDataFrame([(root,)], "node string")
    return subclass_closure(edges, start).select("type")


def class_depth(edges: DataFrame) -> DataFrame:
    """(type, depth): length of the longest chain of superclasses above a class.

    Classes that are above each other form one level: edges inside a cycle add nothing, so a chain
    ends where it would meet a class again.
    """
    edges = cut_lineage(edges.select("sub", "super").where("sub <> super").distinct())
    nodes = edges.select(F.explode(F.array("sub", "super")).alias("type")).distinct()
    reach = _reach(edges, "sub", "super")
    if reach.where("origin = reached").limit(1).count():
        # Classes that reach each other share a level, named by the smallest of them.
        mutual = reach.join(reach.select(F.col("reached").alias("origin"), F.col("origin").alias("reached")), ["origin", "reached"])
        level = mutual.groupBy("origin").agg(F.min("reached").alias("low"))
        level = nodes.join(level, F.col("type") == F.col("origin"), "left").select("type", F.least("type", F.coalesce("low", "type")).alias("level"))
    else:
        level = nodes.select("type", F.col("type").alias("level"))
    level = cut_lineage(level)
    up = (
        edges.join(level.select(F.col("type").alias("sub"), F.col("level").alias("a")), "sub")
        .join(level.select(F.col("type").alias("super"), F.col("level").alias("b")), "super")
        .where("a <> b").select("a", "b").distinct()
    )
    up = cut_lineage(up)
    depth = cut_lineage(level.select("level").distinct().withColumn("depth", F.lit(0)))
    while True:
        lifted = up.join(depth.withColumnRenamed("level", "b"), "b").groupBy(F.col("a").alias("level")).agg((F.max("depth") + 1).alias("up"))
        new = cut_lineage(
            depth.join(lifted, "level", "left").select(
                "level", F.greatest("depth", F.coalesce("up", F.lit(0))).cast("int").alias("depth"),
                (F.coalesce("up", F.lit(0)) > F.col("depth")).alias("changed"),
            ),
            replaces=depth,
        )
        done = new.where("changed").limit(1).count() == 0
        depth = new.select("level", "depth")
        depth._written_at = new._written_at
        if done:
            return level.join(depth, "level").select("type", "depth")


def expanded_groups(spark, cfg, edges: DataFrame = None) -> DataFrame:
    """(group_order, group_id, type, rank): types of each group with their subclasses.

    ``rank`` orders groups from the most to the least specific: fewest types, then configuration
    order. The frame is bounded by groups x ontology classes.
    """
    given = group_types(spark, cfg)
    if cfg.include_subclasses and edges is not None:
        closed = subclass_closure(edges, given.select(F.col("type").alias("node")))
        given = (
            given.join(closed.withColumnRenamed("type", "below"), given["type"] == closed["root"])
            .select("group_order", "group_id", F.col("below").alias("type"))
            .distinct()
        )
    sizes = given.groupBy("group_order").agg(F.count(F.lit(1)).alias("size"))
    # One row per configured group: a single window partition is proven small.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("size", "group_order"))
    ranked = sizes.select("group_order", rank.alias("rank"))
    return given.join(F.broadcast(ranked), "group_order")


def narrower_groups(expanded: DataFrame) -> DataFrame:
    """(narrow, wide): ranks of groups whose types are strictly included in another's."""
    sizes = expanded.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    common = (
        expanded.select("type", F.col("rank").alias("narrow"))
        .join(expanded.select("type", F.col("rank").alias("wide")), "type")
        .where("narrow <> wide")
        .groupBy("narrow", "wide")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        common.join(sizes.select(F.col("rank").alias("narrow"), F.col("n").alias("n1")), "narrow")
        .join(sizes.select(F.col("rank").alias("wide"), F.col("n").alias("n2")), "wide")
        .where("shared = n1 and n2 > n1")
        .select("narrow", "wide")
    )


def groups_of(typed: DataFrame, expanded: DataFrame) -> DataFrame:
    """(source, iri, groups, primary) of entities given as (source, iri, type) rows.

    ``groups`` holds the ranks of every group of the entity, ``primary`` those without a narrower
    group among them; both are bounded by the number of configured groups.
    """
    from quadweave.runtime import broadcast_if_small

    ranks = broadcast_if_small(expanded.select("type", "rank"))
    member = typed.join(ranks, "type").groupBy("source", "iri").agg(
        F.array_sort(F.collect_set("rank")).alias("groups")
    )
    below = narrower_groups(expanded).groupBy(F.lit(1).alias("k")).agg(
        F.collect_set(F.struct("narrow", "wide")).alias("below")
    )
    # ``below`` is one row of at most groups x groups pairs.
    member = member.join(F.broadcast(below), F.lit(1) == F.col("k"), "left")
    nested = F.transform(
        F.filter(
            F.coalesce("below", F.array().cast("array<struct<narrow:int,wide:int>>")),
            lambda x: F.array_contains("groups", x["narrow"]),
        ),
        lambda x: x["wide"],
    )
    return member.select("source", "iri", "groups", F.array_except("groups", nested).alias("primary"))


def shared_group(groups_a, primary_a, groups_b, primary_b, untyped_a=None, untyped_b=None):
    """Column: rank under which two entities are compared; null when they are not.

    The most specific group common to both and primary for at least one; an untyped side takes the
    most specific primary group of the other.
    """
    common = F.array_intersect(
        F.array_intersect(groups_a, groups_b), F.array_union(primary_a, primary_b)
    )
    out = F.array_min(common)
    if untyped_a is None:
        return out
    return (
        F.when(untyped_a & untyped_b, F.lit(None).cast("int"))
        .when(untyped_a, F.array_min(primary_b))
        .when(untyped_b, F.array_min(primary_a))
        .otherwise(out)
    )
