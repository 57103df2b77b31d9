"""Statement patterns, filters and joins over the quad table."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadweave.functions.text import fold, not_blank
from quadweave.runtime import broadcast_if_small
from quadweave.vocab import CREATED, LABEL_PREDICATES, MODIFIED, RDF_TYPE, XSD


def match(quads, s=None, p=None, o=None, source=None) -> DataFrame:
    """Statement pattern: given terms are fixed, the others are wildcards."""
    for name, term in (("s", s), ("p", p), ("o", o), ("source", source)):
        if term is not None:
            quads = quads.where(
                F.col(name).isin(list(term)) if isinstance(term, (list, tuple, set)) else F.col(name) == term
            )
    return quads


def data_quads(quads) -> DataFrame:
    """Data graphs only: never metadata, ontology or matching graphs."""
    return quads.where(F.col("graph_kind") == "data")


def iri_subjects(quads) -> DataFrame:
    return quads.where(F.col("s_kind") == "iri")


def exclude_bookkeeping(quads) -> DataFrame:
    """Drop rdf:type, creation and modification statements."""
    return quads.where(~F.col("p").isin(RDF_TYPE, CREATED, MODIFIED))


def wanted_quads(quads, cfg) -> DataFrame:
    """Only the predicates a matching configuration reads; the list reaches the scan."""
    return quads.where(F.col("p").isin(cfg.wanted_predicates()))


def folded_contains(df, needle, columns) -> DataFrame:
    """Rows one of whose columns contains the needle, ignoring case and accents."""
    want = fold(F.trim(F.lit(needle)))
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(fold(c).contains(want), F.lit(False))
    return df.where(cond)


def typed(quads) -> DataFrame:
    """(source, s, type) of IRI subjects in data graphs."""
    return (
        iri_subjects(data_quads(quads))
        .where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri"))
        .select("source", "s", F.col("o").alias("type"))
        .distinct()
    )


def instances(quads, types) -> DataFrame:
    """(s): subjects of any of the given types (a list, or a frame with a ``type`` column)."""
    t = quads.where(F.col("p") == RDF_TYPE)
    if isinstance(types, DataFrame):
        t = t.join(broadcast_if_small(types.select(F.col("type").alias("o")).distinct()), "o", "left_semi")
    else:
        t = t.where(F.col("o").isin(list(types)))
    return t.select("s").distinct()


# --- basic graph patterns -------------------------------------------------------------------


def pattern(quads, s, p, o, graph=None) -> DataFrame:
    """Bindings of one triple pattern; terms starting with ``?`` are variables.

    Without ``graph`` the pattern sees the union of all graphs as a set of triples.
    """
    cols, conds, names = [], [], {}
    for term, column in ((s, "s"), (p, "p"), (o, "o"), (graph, "graph")):
        if term is None:
            continue
        if term.startswith("?"):
            if term[1:] in names:
                conds.append(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
                cols.append(F.col(column).alias(term[1:]))
        else:
            conds.append(F.col(column) == term)
    for c in conds:
        quads = quads.where(c)
    return quads.select(*cols).distinct()


def bgp(quads, patterns) -> DataFrame:
    """Natural join of triple patterns ``(s, p, o[, graph])`` on their shared variables.

    Patterns are joined so that each one shares a variable with those before it; a pattern that
    shares none with the rest is refused, as it would be a cross product.
    """
    left = list(patterns)
    out = pattern(quads, *left.pop(0))
    while left:
        for i, pat in enumerate(left):
            names = {t[1:] for t in pat if t and t.startswith("?")}
            shared = [c for c in out.columns if c in names]
            if shared:
                out = out.join(pattern(quads, *left.pop(i)), shared)
                break
        else:
            raise ValueError("the graph pattern is not connected")
    return out


def optional(df, other) -> DataFrame:
    """Left join on the variables both sides share."""
    return df.join(other, [c for c in df.columns if c in other.columns], "left")


def not_exists(df, other) -> DataFrame:
    """Rows of ``df`` without a counterpart on the shared variables."""
    return df.join(other, [c for c in df.columns if c in other.columns], "left_anti")


def union_graphs(*frames) -> DataFrame:
    """Union with set semantics."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates()


# --- labels ---------------------------------------------------------------------------------


def _priority(predicates, column="p") -> Column:
    order = F.create_map(*[F.lit(x) for i, p in enumerate(predicates) for x in (p, i)])
    return F.try_element_at(order, F.col(column))


def first_by_priority(quads, predicates, keys=("s",)) -> DataFrame:
    """(keys, value): first non-blank literal over an ordered list of predicates.

    Within a predicate the smallest lexical form is taken. ``min_by`` keeps one row per key on the
    map side, so a subject with many values costs nothing in the shuffle.
    """
    lit = quads.where(
        F.col("p").isin(list(predicates)) & (F.col("o_kind") == "literal") & not_blank("o")
    )
    order = F.struct(_priority(predicates).alias("rank"), F.col("o").alias("value"))
    return lit.groupBy(*keys).agg(F.min(order)["value"].alias("value"))


def best_label(quads) -> DataFrame:
    """(s, label): label predicate, else any literal that is not a dateTime, else the IRI."""
    is_label = F.col("p").isin(LABEL_PREDICATES)
    usable = (F.col("o_kind") == "literal") & not_blank("o")
    fallback = usable & (F.coalesce("o_datatype", F.lit("")) != XSD + "dateTime")
    rank = F.when(usable & is_label, _priority(LABEL_PREDICATES)).when(
        fallback, F.lit(len(LABEL_PREDICATES))
    )
    return (
        quads.groupBy("s")
        .agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("o").alias("o")))).alias("m"))
        .select("s", F.coalesce(F.col("m")["o"], F.col("s")).alias("label"))
    )


def profile_label(quads) -> DataFrame:
    """(source, s, label): label literal within the entity's own source; absent when none."""
    return first_by_priority(
        iri_subjects(data_quads(quads)), LABEL_PREDICATES, ("source", "s")
    ).withColumnRenamed("value", "label")


def shared_source_label(df, sources, column="graph") -> DataFrame:
    """Add ``source_name``: the short name of the data source a graph belongs to."""
    names = broadcast_if_small(sources.select(F.col("graph").alias(column), F.col("short_name").alias("source_name")))
    return df.join(names, column, "left")


# --- entity lists ---------------------------------------------------------------------------


def list_by_types(quads, types, internal_source=None, edges=None) -> DataFrame:
    """Entities of any listed type, once each, with matched types, origin, label and dates.

    ``types`` is a list or a frame with a ``type`` column; ``edges`` (sub, super) adds their subclasses.
    """
    if edges is not None:
        from quadweave.operators.closures import with_subclasses

        types = with_subclasses(types, edges)
    data = iri_subjects(data_quads(quads))
    hit = data.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri"))
    if isinstance(types, DataFrame):
        hit = hit.join(broadcast_if_small(types.select(F.col("type").alias("o")).distinct()), "o", "left_semi")
    else:
        hit = hit.where(F.col("o").isin(list(types)))
    internal = F.lit(False) if internal_source is None else F.col("source") == internal_source
    entities = hit.groupBy("s").agg(
        F.array_sort(F.collect_set("o")).alias("matched_types"),
        F.when(F.max(internal), "internal").otherwise("external").alias("origin"),
        F.min("source").alias("source"),
    )
    facts = data.join(entities.select("s"), "s", "left_semi")
    dates = (
        facts.where(F.col("p").isin(CREATED, MODIFIED))
        .groupBy("s")
        .agg(
            F.min(F.when(F.col("p") == CREATED, F.col("o"))).alias("created"),
            F.max(F.when(F.col("p") == MODIFIED, F.col("o"))).alias("modified"),
        )
    )
    return entities.join(best_label(facts), "s").join(dates, "s", "left").orderBy(F.lower("label"), "s")


def list_without_type(quads) -> DataFrame:
    """(s): IRI subjects having no type in any graph."""
    some = quads.where(F.col("p") == RDF_TYPE).select("s").distinct()
    return iri_subjects(data_quads(quads)).select("s").distinct().join(some, "s", "left_anti")


def _names(quads) -> DataFrame:
    return quads.where(F.col("p").isin(LABEL_PREDICATES)).select("s", F.col("o").alias("name"))


def _capped(df, limit) -> DataFrame:
    ordered = df.orderBy(F.col("name").asc_nulls_first(), "s")
    return ordered if limit is None else ordered.limit(limit)


def name_contains(quads, type_iri, text, limit=None) -> DataFrame:
    """(s, name): entities of a type one of whose names contains the text, ordered by name."""
    hit = _names(quads).where(F.lower("name").contains(text.lower()))
    return _capped(
        hit.join(instances(quads, [type_iri]), "s", "left_semi").groupBy("s").agg(F.min("name").alias("name")),
        limit,
    )


def property_contains(quads, type_iri, predicate, text, limit=None, name_predicate=LABEL_PREDICATES[0]) -> DataFrame:
    """(s, name, value): the same on a property's value, or on the name of the linked entity."""
    values = quads.where(F.col("p") == predicate).select("s", "o")
    linked = quads.where(F.col("p") == name_predicate).select(F.col("s").alias("o"), F.col("o").alias("oname"))
    v = F.coalesce("oname", "o")
    hit = (
        values.join(instances(quads, [type_iri]), "s", "left_semi")
        .join(linked, "o", "left")
        .select("s", v.alias("value"))
        .where(F.lower("value").contains(text.lower()))
        .groupBy("s")
        .agg(F.min("value").alias("value"))
    )
    names = _names(quads).groupBy("s").agg(F.min("name").alias("name"))
    return _capped(hit.join(names, "s", "left").select("s", "name", "value"), limit)


def list_by_type(quads, type_iri, limit=None) -> DataFrame:
    """(s, name): entities of a type with their smallest name, ordered by name."""
    names = _names(quads).groupBy("s").agg(F.min("name").alias("name"))
    return _capped(instances(quads, [type_iri]).join(names, "s", "left"), limit)


def describe_entities(quads, subjects, sources=None) -> DataFrame:
    """One row per (s, p): values with datatype, language, linked name and origin source.

    ``subjects`` is a frame with an ``s`` column. The linked name is the best label of an IRI
    object over all graphs.
    """
    own = quads.join(broadcast_if_small(subjects.select("s").distinct()), "s", "left_semi")
    targets = own.where(F.col("o_kind") == "iri").select(F.col("o").alias("s")).distinct()
    names = best_label(quads.join(targets, "s", "left_semi")).select(
        F.col("s").alias("o"), F.col("label").alias("linked_name")
    )
    value = F.struct("o", "o_kind", "o_datatype", "o_lang", "linked_name", "source")
    return (
        own.join(names, "o", "left")
        .groupBy("s", "p")
        .agg(F.array_sort(F.collect_set(value)).alias("values"))
    )


def same_as_targets(quads, subjects, same_as) -> DataFrame:
    """(s, same_as, sources): equivalents of entities with the sources that describe them."""
    hit = quads.where(F.col("p") == same_as).join(
        broadcast_if_small(subjects.select("s").distinct()), "s", "left_semi"
    ).select("s", F.col("o").alias("same_as")).distinct()
    where = data_quads(quads).select(F.col("s").alias("same_as"), "source").distinct()
    return hit.join(where, "same_as", "left").groupBy("s", "same_as").agg(
        F.array_sort(F.collect_set("source")).alias("sources")
    )


def identical_iris(quads) -> DataFrame:
    """(iri, sources): IRIs that are subjects in at least two data sources."""
    return (
        iri_subjects(data_quads(quads))
        .select(F.col("s").alias("iri"), "source")
        .distinct()
        .groupBy("iri")
        .agg(F.array_sort(F.collect_set("source")).alias("sources"))
        .where(F.size("sources") > 1)
    )


# --- sorts, limits, sets --------------------------------------------------------------------


def sort_entities(df, column, ascending=True) -> DataFrame:
    """Order by a text column ignoring case, or by a date or timestamp column as it is."""
    key = F.lower(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.orderBy(key.asc() if ascending else key.desc())


def filter_sort_page(df, term, search_columns, order_column, ascending=True, page=0, page_size=20) -> DataFrame:
    """Rows containing a term (ignoring case), sorted, one page of them."""
    if term:
        cond = F.lit(False)
        for c in search_columns:
            cond = cond | F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
        df = df.where(cond)
    return sort_entities(df, order_column, ascending).offset(page * page_size).limit(page_size)


def limit_default(df, n=None, default=None) -> DataFrame:
    """``n`` rows, else ``default`` rows, else all."""
    bound = default if n is None else n
    return df if bound is None else df.limit(bound)


def common_entities(a, b, key="iri") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def drop_common_entities(a, b, key="entity"):
    """Both tables without the entities present in both."""
    return (
        a.join(b.select(key).distinct(), key, "left_anti"),
        b.join(a.select(key).distinct(), key, "left_anti"),
    )


def top_k_per_group(df, keys, order, k, rank="rank") -> DataFrame:
    """Best ``k`` rows per group, all for ``None``. Spark pushes the rank filter below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(rank) <= k)
