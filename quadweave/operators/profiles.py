"""Entity profiles: types, labels, and values resolved for comparison."""

from pyspark.sql import DataFrame, Window, functions as F

from quadweave.functions.dates import INTERVAL_TYPE, interval, parse_number, parse_partial_date, show_interval
from quadweave.functions.text import not_blank
from quadweave.operators.patterns import data_quads, first_by_priority, iri_subjects, profile_label, typed, wanted_quads
from quadweave.plans.config import concept_predicates
from quadweave.vocab import DATE_TYPES, NUMBER_TYPES, RICO, TEXT_PREDICATES


def linked_text(quads) -> DataFrame:
    """(iri, text): what a linked IRI is called, in any data graph."""
    return first_by_priority(data_quads(quads), TEXT_PREDICATES).select(
        F.col("s").alias("iri"), F.col("value").alias("text")
    )


def linked_date(quads) -> DataFrame:
    """(iri, date): the date of a linked IRI.

    Its normalized, else its expressed date; else the hull of its beginning and end, each a literal
    or the date of a linked entity; with one bound only, or inverted bounds, the first bound known.
    """
    data = data_quads(quads)
    names = {
        "normalized": RICO + "normalizedDateValue",
        "expressed": RICO + "expressedDate",
        "begin": RICO + "beginningDate",
        "end": RICO + "endDate",
    }
    literal = (F.col("o_kind") == "literal") & not_blank("o")
    first = (
        data.where(F.col("p").isin(list(names.values())) & literal)
        .groupBy("s")
        .agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in names.items()])
    )
    parsed = first.select("s", *[parse_partial_date(n).alias(n) for n in names])
    own = parsed.select("s", F.coalesce("normalized", "expressed").alias("own"), "begin", "end")
    hops = data.where(
        F.col("p").isin(RICO + "hasBeginningDate", RICO + "hasEndDate")
        & (F.col("o_kind") == "iri") & (F.col("o") != F.col("s"))
    )
    nested = (
        hops.join(own.select(F.col("s").alias("o"), F.col("own").alias("date")), "o")
        .where("date is not null")
        .groupBy("s")
        .agg(
            *[
                F.min(F.when(F.col("p") == RICO + p, F.struct("o", "date")))["date"].alias(n)
                for n, p in (("begin_at", "hasBeginningDate"), ("end_at", "hasEndDate"))
            ]
        )
    )
    both = own.join(nested, "s", "full_outer").select(
        F.col("s").alias("iri"),
        "own",
        F.coalesce("begin", "begin_at").alias("b"),
        F.coalesce("end", "end_at").alias("e"),
    )
    hull = F.when(F.col("b.start") <= F.col("e.end"), interval(F.col("b.start"), F.col("e.end"), False))
    return both.select("iri", F.coalesce("own", hull, "b", "e").cast(INTERVAL_TYPE).alias("date")).where(
        "date is not null"
    )


def concept_values(quads, cfg, dealt=False) -> DataFrame:
    """Values of every concept of every group, once per entity and concept; ``dealt`` out by entity if asked.

    (source, iri, group_order, concept_no, concept, comparator, keyed, predicate_pos, o, o_kind,
    o_datatype, o_lang); a value found through several predicates keeps its first position.
    """
    spark = quads.sparkSession
    # One row per configured predicate: bounded by the configuration.
    preds = F.broadcast(concept_predicates(spark, cfg))
    facts = iri_subjects(data_quads(quads)).where(F.col("p").isin(cfg.predicates()))
    keys = ["source", "s", "group_order", "concept_no", "concept", "comparator", "keyed",
            "o", "o_kind", "o_datatype", "o_lang"]
    found = facts.join(preds, "p")
    if dealt:
        found = found.select(*keys, "predicate_pos").repartition("source", "s")
    return (
        found
        .groupBy(*keys)
        .agg(F.min("predicate_pos").alias("predicate_pos"))
        .withColumnRenamed("s", "iri")
    )


def has_linked_values(quads, cfg) -> bool:
    """Whether a compared predicate has IRI values: a pruned scan that stops at the first one."""
    hit = data_quads(quads).where(F.col("p").isin(cfg.predicates()) & (F.col("o_kind") == "iri"))
    return hit.select("p").limit(1).count() > 0


def _looked_up(values, quads):
    """(o, o_kind, l_text, l_date): text and date of the distinct linked entities."""
    targets = values.where("o_kind = 'iri'").select(F.col("o").alias("iri")).distinct()
    reach = data_quads(quads)
    text = linked_text(reach.join(targets.withColumnRenamed("iri", "s"), "s", "left_semi"))
    one_hop = reach.where(
        F.col("p").isin(RICO + "hasBeginningDate", RICO + "hasEndDate") & (F.col("o_kind") == "iri")
    ).join(targets.withColumnRenamed("iri", "s"), "s", "left_semi")
    dated = targets.unionByName(one_hop.select(F.col("o").alias("iri"))).distinct()
    date = linked_date(reach.join(dated.withColumnRenamed("iri", "s"), "s", "left_semi"))
    return (
        targets.join(text, "iri", "left")
        .join(date, "iri", "left")
        .select(F.col("iri").alias("o"), F.lit("iri").alias("o_kind"), F.col("text").alias("l_text"),
                F.col("date").alias("l_date"))
    )


def resolve_values(values, quads, linked=True) -> DataFrame:
    """Add ``cv`` (kind, text, date, number, iri, display), dropping values that do not resolve.

    Linked entities are looked up once per distinct IRI; ``linked=False`` skips the look-up when no
    value is an IRI.
    """
    is_lit, is_iri = F.col("o_kind") == "literal", F.col("o_kind") == "iri"
    comparator = F.col("comparator")
    wants_date = (comparator == "date") | (
        (comparator == "auto") & is_lit & F.coalesce("o_datatype", F.lit("")).isin(DATE_TYPES)
    )
    wants_number = (comparator == "number") | (
        (comparator == "auto") & is_lit & F.coalesce("o_datatype", F.lit("")).isin(NUMBER_TYPES)
    )
    if linked:
        # Literals are not looked up: a frequent one would send all its rows to one task.
        found = values.where(is_iri).join(_looked_up(values, quads), ["o", "o_kind"], "left")
        v = found.unionByName(values.where(~is_iri), allowMissingColumns=True)
    else:
        v = values.withColumn("l_text", F.lit(None).cast("string")).withColumn("l_date", F.lit(None).cast(INTERVAL_TYPE))
    v = v.withColumn("date", F.when(wants_date & is_lit, parse_partial_date("o")).when(wants_date, F.col("l_date")))
    kind = (
        F.when(wants_date, F.lit("DATE"))
        .when(wants_number, F.lit("NUMBER"))
        .when((comparator == "linkedEntity") | ((comparator == "auto") & is_iri), F.lit("ENTITY"))
        .otherwise(F.lit("TEXT"))
    )
    v = v.withColumn("kind", kind)
    kind = F.col("kind")
    number = F.when((kind == "NUMBER") & is_lit, parse_number("o"))
    txt = F.when(kind.isin("TEXT", "ENTITY"), F.when(is_lit, F.col("o")).when(is_iri, F.col("l_text")))
    iri = F.when((kind == "ENTITY") & is_iri, F.col("o"))
    display = (
        F.when(is_lit, F.col("o"))
        .when(kind == "DATE", F.coalesce("l_text", show_interval(F.col("date"))))
        .otherwise(F.coalesce("l_text", "o"))
    )
    v = v.select(
        *[c for c in values.columns],
        F.struct(
            kind.alias("kind"), txt.alias("text"), F.col("date").alias("date"),
            number.alias("number"), iri.alias("iri"), display.alias("display"),
        ).alias("cv"),
    )
    cv = F.col("cv")
    return v.where(
        ((cv["kind"] == "TEXT") & cv["text"].isNotNull())
        | ((cv["kind"] == "DATE") & cv["date"].isNotNull())
        | ((cv["kind"] == "NUMBER") & cv["number"].isNotNull())
        | ((cv["kind"] == "ENTITY") & (cv["text"].isNotNull() | cv["iri"].isNotNull()))
    )


def slim_values(resolved) -> DataFrame:
    """Resolved values without the text and display of literals, which :func:`full_values` takes from ``o`` again.

    A long text is then written, moved and sorted once instead of three times.
    """
    other = ~F.col("o_kind").eqNullSafe("literal")
    cv = F.col("cv")
    return resolved.withColumn("cv", cv.withField("text", F.when(other, cv["text"])).withField("display", F.when(other, cv["display"])))


def full_values(resolved) -> DataFrame:
    """Resolved values with the text and display of literals, whether they were left out or not."""
    literal, cv = F.col("o_kind").eqNullSafe("literal"), F.col("cv")
    text = F.when(literal & cv["kind"].isin("TEXT", "ENTITY"), F.col("o")).otherwise(cv["text"])
    return resolved.withColumn("cv", cv.withField("text", text).withField("display", F.when(literal, F.col("o")).otherwise(cv["display"])))


def numbered_values(resolved) -> DataFrame:
    """Every value with its position ``pos`` among those of its entity and concept."""
    w = Window.partitionBy("source", "iri", "group_order", "concept_no").orderBy(
        "predicate_pos", "o", "o_kind", F.coalesce("o_datatype", F.lit("")), F.coalesce("o_lang", F.lit(""))
    )
    return resolved.withColumn("pos", F.row_number().over(w))


def profile_values(quads, cfg) -> DataFrame:
    """Long table of resolved values; see the contract in the survey."""
    return numbered_values(resolve_values(concept_values(quads, cfg), quads))


def profiles(quads, cfg) -> DataFrame:
    """(source, iri, types, label): entities with a type or a value the configuration reads."""
    data = iri_subjects(data_quads(quads))
    t = typed(quads).groupBy("source", "s").agg(F.array_sort(F.collect_set("type")).alias("types"))
    valued = wanted_quads(data, cfg).select("source", "s").distinct()
    return (
        t.join(valued, ["source", "s"], "full_outer")
        .join(profile_label(data), ["source", "s"], "left")
        .select(
            "source",
            F.col("s").alias("iri"),
            F.coalesce("types", F.array().cast("array<string>")).alias("types"),
            "label",
        )
    )
