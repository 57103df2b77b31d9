"""Descriptive statistics over quads."""

from pyspark.sql import DataFrame, functions as F

from quadweave.functions.iri import compact_iri, local_name, ontology_local_name, ontology_namespace
from quadweave.functions.text import content_words, edit_similarity, split_local_name
from quadweave.operators.closures import superclass_closure, type_subclasses
from quadweave.operators.patterns import best_label, data_quads, exclude_bookkeeping, instances, top_k_per_group
from quadweave.runtime import broadcast_if_small
from quadweave.vocab import DATE_TYPES, LABEL_PREDICATES, NUMBER_TYPES, RDF_TYPE, RICO, SKOS, XSD


def triple_count(quads) -> DataFrame:
    """(source, triples): statements per source."""
    return data_quads(quads).groupBy("source").agg(F.count(F.lit(1)).alias("triples"))


def _type_rows(quads):
    return data_quads(quads).where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri")).select("source", "s", F.col("o").alias("type"))


def type_usage(quads, classes=None) -> DataFrame:
    """(type, source, entities, total, label, defined): use of each type per source.

    ``classes`` (class, label) adds defined types; unused ones have no source. Ordered by total.
    """
    per = _type_rows(quads).groupBy("type", "source").agg(F.countDistinct("s").alias("entities"))
    total = per.groupBy("type").agg(F.sum("entities").alias("total"))
    out = per.join(total, "type")
    if classes is not None:
        c = classes.groupBy(F.col("class").alias("type")).agg(F.min("label").alias("label")).withColumn("defined", F.lit(True))
        out = out.join(c, "type", "full_outer")
    else:
        out = out.withColumn("label", F.lit(None).cast("string")).withColumn("defined", F.lit(None).cast("boolean"))
    return out.select("type", "source", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("total", F.lit(0)).alias("total"),
                      "label", F.coalesce("defined", F.lit(False)).alias("defined")).orderBy(F.desc("total"), "type", "source")


def _of_types(quads, types):
    """Data statements of subjects having one of the types in the same source; each once."""
    t = _type_rows(quads)
    if isinstance(types, DataFrame):
        t = t.join(broadcast_if_small(types.select("type").distinct()), "type", "left_semi")
    else:
        t = t.where(F.col("type").isin(list(types)))
    return data_quads(quads).join(t.select("source", "s").distinct(), ["source", "s"], "left_semi")


def predicate_usage(quads, types) -> DataFrame:
    """(p, source, subjects): distinct subjects per predicate and source, for the given types."""
    rows = _of_types(quads, types).where(F.col("p") != RDF_TYPE)
    return rows.groupBy("p", "source").agg(F.countDistinct("s").alias("subjects"))


def predicate_profile(quads, types, properties=None, edges=None, prefixes=None, samples=None, shown_chars=None) -> DataFrame:
    """(p, total, kind, average_length, samples, defined, label, comparator) for the given types.

    ``kind`` is the dominant value kind, ties by name; ``samples`` are the distinct values, or the
    ``samples`` smallest of them, ``shown_chars`` characters of each if given. ``properties`` (uri, label, kind, domain, datatype) adds those declared on
    the types or their superclasses.
    """
    rows = _of_types(quads, types).where(F.col("p") != RDF_TYPE)
    total = rows.select("p", "source", "s").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("total"))
    datatype = F.coalesce("o_datatype", F.lit(XSD + "string"))
    kind = F.when(F.col("o_kind") == "iri", F.lit("iri")).when(
        F.col("o_kind") == "literal", F.concat(F.lit("literal:"), compact_iri(datatype, prefixes))).otherwise("other")
    per_kind = rows.groupBy("p", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("o_kind") == "literal", F.char_length("o"))).alias("chars"),
        F.count_if(F.col("o_kind") == "literal").alias("literals"),
    )
    dominant = per_kind.groupBy("p").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("kind").alias("kind")))["kind"].alias("kind"),
        (F.sum("chars") / F.nullif(F.sum("literals"), F.lit(0))).alias("average_length"),
    )
    shown = F.col("o") if shown_chars is None else F.when(
        F.char_length("o") > shown_chars, F.concat(F.substring("o", 1, shown_chars), F.lit("…"))).otherwise(F.col("o"))
    some = top_k_per_group(rows.select("p", "o").distinct(), ["p"], ["o"], samples).groupBy("p").agg(
        F.array_sort(F.collect_list(shown)).alias("samples"))
    out = total.join(dominant, "p").join(some, "p")
    if properties is not None:
        given = types if isinstance(types, DataFrame) else quads.sparkSession.createDataFrame([(t,) for t in types], "type string")
        if edges is not None:
            given = superclass_closure(edges, given.select(F.col("type").alias("node"))).select(F.col("ancestor").alias("type"))
        declared = properties.join(broadcast_if_small(given.select(F.col("type").alias("domain")).distinct()), "domain", "left_semi").groupBy(
            F.col("uri").alias("p")).agg(
                F.min("label").alias("label"),
                F.min(F.when(F.col("kind") == "OBJECT_PROPERTY", "iri").when(
                    F.col("datatype").isNotNull(), F.concat(F.lit("literal:"), compact_iri("datatype", prefixes))).otherwise("unknown")).alias("dkind"))
        out = out.join(declared, "p", "full_outer").withColumn("defined", F.col("dkind").isNotNull()).withColumn("kind", F.coalesce("kind", "dkind"))
    else:
        out = out.withColumn("label", F.lit(None).cast("string")).withColumn("defined", F.lit(False))
    out = out.withColumn("comparator", suggest_comparator(F.col("p"), F.col("kind"), F.col("average_length"), prefixes))
    return out.select("p", F.coalesce("total", F.lit(0)).alias("total"), "kind", "average_length", "samples", "defined", "label", "comparator").orderBy(
        F.desc("total"), "p")


def suggest_comparator(p, kind, average_length, prefixes=None):
    """Column: comparator suggested for a predicate from its dominant kind."""
    from quadweave.functions.iri import expand_curie

    datatype = expand_curie(F.regexp_replace(kind, "^literal:", ""), prefixes)
    literal = kind.startswith("literal:")
    return (
        F.when(kind == "iri", "linkedEntity")
        .when(literal & datatype.isin(DATE_TYPES), "date")
        .when(literal & datatype.isin(NUMBER_TYPES), "number")
        .when(p.isin(LABEL_PREDICATES), "name")
        .when(average_length > 100, "text")
        .otherwise("string")
    )


def uncompared_predicates(usage, group) -> DataFrame:
    """Predicates used by a group's types and in none of its concepts."""
    used = [p for c in group.concepts for p in c.predicates]
    return usage.where(~F.col("p").isin(used) if used else F.lit(True))


def coverage(quads, group, types=None) -> DataFrame:
    """(source, concept, entities, entities_with_value, percent) of one configured group.

    ``types`` are the group's types closed over subclasses (default: as configured).
    """
    spark = quads.sparkSession
    t = _type_rows(quads)
    t = t.join(broadcast_if_small(types.select("type").distinct()), "type", "left_semi") if types is not None else t.where(F.col("type").isin(group.types))
    ent = t.select("source", "s").distinct()
    n = ent.groupBy("source").agg(F.count(F.lit(1)).alias("entities"))
    # One row per configured predicate.
    preds = spark.createDataFrame([(c.key, p) for c in group.concepts for p in dict.fromkeys(c.predicates)], "concept string, p string")
    have = (
        data_quads(quads).where(F.col("p").isin(sorted({p for c in group.concepts for p in c.predicates})))
        .select("source", "s", "p").distinct()
        .join(ent, ["source", "s"], "left_semi").join(F.broadcast(preds), "p")
        .groupBy("source", "concept").agg(F.countDistinct("s").alias("with_value"))
    )
    grid = n.withColumn("concept", F.explode(F.array(*[F.lit(c.key) for c in group.concepts])))
    v = F.coalesce("with_value", F.lit(0))
    return grid.join(have, ["source", "concept"], "left").select(
        "source", "concept", "entities", v.alias("entities_with_value"),
        (F.floor(1000.0 * v / F.col("entities") + 0.5) / 10.0).alias("percent"))


def used_types(quads) -> DataFrame:
    return data_quads(quads).where(F.col("p") == RDF_TYPE).select(F.col("o").alias("type")).distinct()


def used_predicates(quads) -> DataFrame:
    return data_quads(quads).select("p").distinct()


def count_by_type(quads, type_iri) -> DataFrame:
    """Exact number of distinct subjects of a type."""
    return quads.where((F.col("p") == RDF_TYPE) & (F.col("o") == type_iri)).agg(F.countDistinct("s").alias("n"))


def properties_of_type(quads, type_iri) -> DataFrame:
    return quads.join(instances(quads, [type_iri]), "s", "left_semi").select("p").distinct()


def resources_of_type(quads, type_iri) -> DataFrame:
    return instances(quads, [type_iri])


def types_by_namespace(quads, classes=None, configured=None) -> DataFrame:
    """(namespace, used, defined): used types per ontology namespace and the defined ones not used.

    ``configured`` local names are left out of the defined list.
    """
    strip = F.regexp_replace(ontology_namespace("type"), "[#/]$", "")
    used = quads.where(F.col("p") == RDF_TYPE).select(F.col("o").alias("type")).distinct().groupBy(strip.alias("namespace")).agg(
        F.array_sort(F.collect_set("type")).alias("used"))
    none = F.array().cast("array<string>")
    if classes is None:
        return used.withColumn("defined", none)
    skip = F.array(*[F.lit(x) for x in configured or []]).cast("array<string>")
    known = classes.select(F.col("class").alias("type")).distinct().groupBy(strip.alias("namespace")).agg(
        F.array_sort(F.collect_set("type")).alias("all"))
    out = used.join(known, "namespace", "full_outer")
    names = F.transform(F.coalesce("used", none), lambda t: ontology_local_name(t))
    return out.select("namespace", F.coalesce("used", none).alias("used"), F.filter(
        F.coalesce("all", none),
        lambda t: ~F.array_contains(names, ontology_local_name(t)) & ~F.array_contains(skip, ontology_local_name(t))).alias("defined"))


def richest_entity(quads, types=None) -> DataFrame:
    """(type, s, triples): per type, the subject with most statements (ties: smallest IRI)."""
    n = quads.groupBy("s").agg(F.count(F.lit(1)).alias("triples"))
    t = quads.where(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("type")).distinct()
    if types is not None:
        t = t.where(F.col("type").isin(list(types)))
    best = t.join(n, "s").groupBy("type").agg(F.min(F.struct((-F.col("triples")).alias("n"), F.col("s").alias("s"))).alias("b"))
    return best.select("type", "b.s", (-F.col("b.n")).alias("triples"))


def ontology_classes_labelled(quads, class_types) -> DataFrame:
    """(namespace, class, label_en, label_fr): classes with a label per language, ordered."""
    c = quads.where((F.col("p") == RDF_TYPE) & F.col("o").isin(list(class_types)) & (F.col("s_kind") == "iri")).select("s").distinct()
    lab = quads.where((F.col("p") == LABEL_PREDICATES[1]) & (F.col("o_kind") == "literal")).groupBy("s").agg(
        F.min(F.when(F.coalesce("o_lang", F.lit("")).isin("", "en"), F.col("o"))).alias("label_en"),
        F.min(F.when(F.col("o_lang") == "fr", F.col("o"))).alias("label_fr"))
    return c.join(lab, "s", "left").select(ontology_namespace("s").alias("namespace"), F.col("s").alias("class"), "label_en", "label_fr").orderBy("namespace", "class")


def group_by_matched_type(entities) -> DataFrame:
    """(type, entities): an entity list by matched type, "Other" when none."""
    e = entities.select("s", "label", F.explode_outer("matched_types").alias("type"))
    return e.groupBy(F.coalesce("type", F.lit("Other")).alias("type")).agg(
        F.array_sort(F.collect_list(F.struct("label", "s"))).alias("entities")).orderBy("type")


def vocabulary_types(onto_edges, configured=None) -> DataFrame:
    """Types whose instances are vocabulary entries: rico:Type closure, skos:Concept, configured."""
    spark = onto_edges.sparkSession
    extra = spark.createDataFrame([(t,) for t in [SKOS + "Concept", *(configured or [])]], "type string")
    return type_subclasses(onto_edges, RICO + "Type").unionByName(extra).distinct()


def usage_profile(quads, vocabulary=None, max_types=None, max_predicates=None, max_values=None, max_targets=None, max_chars=None, only_predicates=None):
    """Aggregate picture of the data: dict of frames.

    ``types`` (type, entities): the largest types; ``predicates`` (type, p, subjects, sources,
    kinds); ``values`` (type, p, o, o_kind, n, label): recurring short values, then vocabulary
    entries. All of them by default; each bound is an argument. ``max_chars`` leaves out longer
    literals, so that free text does not appear.
    """
    data = data_quads(quads)
    # Triples of the union of graphs are a set; the type may be stated in any graph.
    t = quads.where((F.col("p") == RDF_TYPE)).select("s", F.col("o").alias("type")).distinct()
    sized = _type_rows(quads).groupBy("type").agg(F.countDistinct("s").alias("entities"))
    types = sized.orderBy(F.desc("entities"), "type")
    if max_types is not None:
        types = types.limit(max_types)
        t = t.join(types.select("type"), "type", "left_semi")
    facts = exclude_bookkeeping(data)
    if only_predicates is not None:
        facts = facts.join(broadcast_if_small(only_predicates.select("p").distinct()), "p", "left_semi")
    base = facts.join(t, "s")
    per = base.groupBy("type", "p").agg(F.countDistinct("s").alias("subjects"), F.array_sort(F.collect_set("source")).alias("sources"))
    preds = top_k_per_group(per, ["type"], [F.desc("subjects"), "p"], max_predicates).drop("rank")
    if max_predicates is not None:
        base = base.join(preds.select("type", "p"), ["type", "p"], "left_semi")
    text = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("text@"), "o_lang")).when(
        F.coalesce("o_datatype", F.lit(XSD + "string")).endswith("#string"), F.lit("text")).otherwise(compact_iri("o_datatype"))
    lit_kinds = base.where("o_kind = 'literal'").groupBy("type", "p", text.alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("after", F.lit(0))
    targets = base.where("o_kind = 'iri'").select("type", "p", "o").distinct().join(
        quads.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("o"), F.col("o").alias("ot")).distinct(), "o")
    linked = top_k_per_group(targets.groupBy("type", "p", "ot").agg(F.count(F.lit(1)).alias("n")), ["type", "p"], [F.desc("n"), "ot"], max_targets)
    linked = linked.select("type", "p", F.concat(F.lit("→ "), compact_iri("ot")).alias("kind"), "n", F.lit(1).alias("after"))
    kinds = lit_kinds.unionByName(linked).groupBy("type", "p").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("after", (-F.col("n")).alias("n"), "kind"))), lambda x: x["kind"]).alias("kinds"))
    preds = preds.join(kinds, ["type", "p"], "left").withColumn("kinds", F.coalesce("kinds", F.array(F.lit("→ entity"))))
    shown = F.col("o_kind") != "bnode"
    if max_chars is not None:
        shown = (F.col("o_kind") == "iri") | ((F.col("o_kind") == "literal") & (F.char_length("o") <= max_chars))
    counts = base.where(shown).groupBy("type", "p", "o", "o_kind").agg(F.count(F.lit(1)).alias("n"))
    again = counts.where("n >= 2").withColumn("late", F.lit(0))
    if vocabulary is not None:
        entry = quads.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("o"), F.col("o").alias("type")).join(
            broadcast_if_small(vocabulary.select("type").distinct()), "type", "left_semi").select("o").distinct()
        once = counts.where("n < 2 and o_kind = 'iri'").join(entry, "o", "left_semi").withColumn("late", F.lit(1))
        again = again.unionByName(once)
    values = top_k_per_group(again, ["type", "p"], ["late", F.desc("n"), "o"], max_values, "position")
    iris = values.where("o_kind = 'iri'").select(F.col("o").alias("s")).distinct()
    names = best_label(quads.join(broadcast_if_small(iris), "s", "left_semi")).select(F.col("s").alias("o"), "label")
    return {"types": types, "predicates": preds, "values": values.join(names, "o", "left")}


def find_usage(quads, text, type_iri=None, term_hits=None, max_predicates=None, max_types=None):
    """(p, type, entities, subjects): use of the predicates a phrase may mean, on their main types.

    A predicate matches when a word of its local name equals a word of the phrase, or is similar
    (0.8) to one of more than four letters. ``term_hits`` (p, hit_rank) adds ontology hits after.
    """
    preds = used_predicates(quads)
    q = F.explode(content_words(F.lit(text)))
    words = quads.sparkSession.range(1).select(q.alias("q"))
    local = preds.select("p", F.explode(content_words(split_local_name(local_name("p")))).alias("w"))
    # The phrase is a handful of words: the nested-loop join is driven by them.
    hit = local.join(F.broadcast(words), (F.col("w") == F.col("q")) | ((F.char_length("q") > 4) & (edit_similarity(F.col("w"), F.col("q")) >= 0.8)))
    cand = hit.select("p").distinct().withColumn("order", F.lit(0))
    if term_hits is not None:
        cand = cand.unionByName(term_hits.select("p", F.col("hit_rank").alias("order")).join(cand, "p", "left_anti"))
    if max_predicates is not None:
        cand = cand.orderBy("order", "p").limit(max_predicates)
    t = quads.where(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("type")).distinct()
    if type_iri is not None:
        t = t.where(F.col("type") == type_iri)
    use = data_quads(quads).join(cand.select("p"), "p").select("p", "s").distinct().join(t, "s")
    per = use.groupBy("p", "type").agg(F.count(F.lit(1)).alias("subjects"))
    top = top_k_per_group(per, ["p"], [F.desc("subjects"), "type"], max_types).drop("rank")
    size = t.groupBy("type").agg(F.count(F.lit(1)).alias("entities"))
    return cand.select("p").join(top, "p", "left").join(size, "type", "left").select("p", "type", "entities", "subjects")


def validate_vocabulary(cfg, quads, links=None, classes=None) -> DataFrame:
    """(code, group_id, subject): findings that depend on the data."""
    spark = quads.sparkSession
    types = spark.createDataFrame([(i, g.id, g.label, t) for i, g in enumerate(cfg.groups) for t in g.types], "n int, group_id string, label string, type string")
    known = used_types(quads)
    if classes is not None:
        known = known.unionByName(classes.select(F.col("class").alias("type")))
    unknown = types.join(known.distinct(), "type", "left_anti").select(F.lit("UNKNOWN_TYPE").alias("code"), "group_id", F.col("type").alias("subject"))
    first = types.groupBy("type").agg(F.min(F.struct("n", "label"))["label"].alias("first"))
    twice = types.join(first, "type").where("label <> first").select(F.lit("TYPE_IN_TWO_GROUPS").alias("code"), "group_id", F.col("type").alias("subject"))
    preds = spark.createDataFrame([(g.id, p) for g in cfg.groups for c in g.concepts for p in c.predicates], "group_id string, p string")
    unused = preds.join(used_predicates(quads), "p", "left_anti").select(F.lit("UNUSED_PREDICATE").alias("code"), "group_id", F.col("p").alias("subject"))
    out = unknown.unionByName(twice).unionByName(unused)
    if links is not None:
        ids = [g.id for g in cfg.groups]
        gone = links.where(F.col("group_id").isNotNull() & ~F.col("group_id").isin(ids)).select("group_id").distinct()
        out = out.unionByName(gone.select(F.lit("REFERENCED_GROUP_REMOVED").alias("code"), "group_id", F.col("group_id").alias("subject")))
    return out.distinct()
