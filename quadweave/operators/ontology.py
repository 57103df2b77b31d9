"""Ontology quads to schema tables. Ontologies are small next to data, but stay distributed."""

from pyspark.sql import DataFrame, functions as F

from quadweave.functions.iri import datatype_category, is_datatype, ontology_local_name
from quadweave.runtime import cut_lineage
from quadweave.vocab import OWL, RDF, RDF_TYPE, RDFS, RDFS_LABEL, SUBCLASS_OF


def _first_label(quads):
    """(s, label): label without language, in English or in French; smallest in that order."""
    lang = F.coalesce("o_lang", F.lit(""))
    rows = quads.where((F.col("p") == RDFS_LABEL) & (F.col("o_kind") == "literal") & lang.isin("", "en", "fr"))
    return rows.groupBy("s").agg(F.min(F.struct(lang.alias("l"), F.col("o").alias("o")))["o"].alias("label"))


def _typed(quads, *types):
    return quads.where((F.col("p") == RDF_TYPE) & F.col("o").isin(list(types)) & (F.col("s_kind") == "iri")).select("s", F.col("o").alias("t")).distinct()


def _within(df, column, namespace):
    return df.where(F.col(column).startswith(namespace)) if namespace else df


def extract_classes(quads, namespace=None) -> DataFrame:
    """(class, local_name, label) of owl and rdfs classes."""
    c = _within(_typed(quads, OWL + "Class", RDFS + "Class").select("s").distinct(), "s", namespace)
    return c.join(_first_label(quads), "s", "left").select(
        F.col("s").alias("class"), ontology_local_name("s").alias("local_name"),
        F.coalesce("label", ontology_local_name("s")).alias("label"))


def extract_hierarchy(quads, namespace=None) -> DataFrame:
    """(sub, super) between named classes; anonymous restrictions are skipped."""
    h = quads.where((F.col("p") == SUBCLASS_OF) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri"))
    return _within(h.select(F.col("s").alias("sub"), F.col("o").alias("super")).distinct(), "sub", namespace)


def _jumps(rest) -> list:
    """(cell, next) for the cells 1, 2, 4, ... further on: the last table is empty, unless some list runs into itself."""
    cells, reach = rest.count(), 1
    jumps = [rest]
    while jumps[-1].limit(1).count() and reach <= cells:
        ahead = jumps[-1].select(F.col("cell").alias("next"), F.col("next").alias("then"))
        jumps.append(cut_lineage(jumps[-1].join(ahead, "next").select("cell", F.col("then").alias("next"))))
        reach *= 2
    return jumps


def _list_cells(heads, rest) -> DataFrame:
    """(node, cell, at): every cell of the list that starts at ``cell`` of ``heads`` (node, cell), one row per node.

    Pointer doubling: each round knows the cell 2^k further on and adds to the cells found so far
    those 2^k behind them, so a list of n cells takes log n rounds. No cell comes up twice in a list
    that ends, so each round writes what is new; in a list that runs into itself, a cell counts at its
    first place.
    """
    jumps = _jumps(cut_lineage(rest.select("cell", "next")))
    cells = cut_lineage(heads.select("node", "cell", F.lit(0).cast("long").alias("at")))
    if jumps[-1].limit(1).count() == 0:
        for k, jump in enumerate(jumps[:-1]):
            cells = cells.unionByName(cut_lineage(cells.join(jump, "cell").select("node", F.col("next").alias("cell"), (F.col("at") + 2**k).alias("at"))))
        return cells
    size = cells.count()
    for k, jump in enumerate(jumps):
        further = cells.join(jump, "cell").select("node", F.col("next").alias("cell"), (F.col("at") + 2**k).alias("at"))
        cells = cut_lineage(cells.unionByName(further).groupBy("node", "cell").agg(F.min("at").alias("at")), replaces=cells)
        grown = cells.count()
        if grown == size:
            break
        size = grown
    return cells


def flatten_lists(quads) -> DataFrame:
    """(node, pos, member): IRIs of every node that is a named class or a union, unions flattened.

    ``node`` is any subject of owl:unionOf; nested unions are replaced by their members. Lists of
    any length are followed; a union that contains itself is an error.
    """
    first = quads.where((F.col("p") == RDF + "first") & (F.col("o_kind") != "literal")).groupBy("s").agg(
        F.min(F.struct("o", "o_kind")).alias("f")).select(F.col("s").alias("cell"), "f.o", "f.o_kind")
    rest = quads.where((F.col("p") == RDF + "rest") & (F.col("o_kind") != "literal") & (F.col("o") != RDF + "nil")).groupBy("s").agg(
        F.min("o").alias("next")).withColumnRenamed("s", "cell")
    unions = quads.where((F.col("p") == OWL + "unionOf") & (F.col("o_kind") != "literal")).groupBy("s").agg(F.min("o").alias("cell"))
    cells = _list_cells(unions.where(F.col("cell") != RDF + "nil").select(F.col("s").alias("node"), "cell"), rest)
    items = cut_lineage(cells.join(first, "cell").select(
        "node", F.array(F.col("at").cast("int")).alias("pos"), F.col("o").alias("member"), F.col("o_kind").alias("kind")))
    known = items.select(F.col("node").alias("inner"), F.col("pos").alias("ipos"), F.col("member").alias("imember"), F.col("kind").alias("ikind"))
    inner = unions.select(F.col("s").alias("inner"))
    # The cells themselves are far fewer than their places in lists that share them.
    if first.join(inner, first["o"] == F.col("inner"), "left_semi").limit(1).count() == 0:
        return items.where("kind = 'iri'").select("node", "pos", "member")
    inner = known.select("inner").distinct()
    depth, deepest = 0, inner.count()
    out = items
    while True:
        nested = out.join(inner, out["member"] == F.col("inner"), "left_semi")
        if nested.limit(1).count() == 0:
            return out.where("kind = 'iri'").select("node", "pos", "member")
        if depth > deepest:
            raise ValueError("a union contains itself")
        deeper = nested.join(known, nested["member"] == known["inner"]).select(
            "node", F.concat("pos", "ipos").alias("pos"), F.col("imember").alias("member"), F.col("ikind").alias("kind"))
        plain = out.join(inner, out["member"] == F.col("inner"), "left_anti")
        out = cut_lineage(plain.unionByName(deeper), replaces=out if depth else None)
        depth += 1


def resolve_members(df, quads, column, lists=None) -> DataFrame:
    """Replace a node column by the IRIs it stands for: itself, or the members of a union.

    Adds ``member`` and ``pos``; anonymous nodes that are no union give no row.
    """
    m = flatten_lists(quads) if lists is None else lists
    joined = df.join(m.withColumnRenamed("node", column).withColumnRenamed("member", "_m"), column, "left")
    return joined.withColumn("member", F.coalesce("_m", F.when(F.col(f"{column}_kind") == "iri", F.col(column)))).drop("_m").where("member is not null")


def range_members(quads, predicate) -> DataFrame:
    """(property, pos, member): domains or ranges of properties, unions flattened."""
    r = quads.where((F.col("p") == predicate) & (F.col("o_kind") != "literal")).select(
        F.col("s").alias("property"), F.col("o").alias("node"), F.col("o_kind").alias("node_kind")).distinct()
    return resolve_members(r, quads, "node").select("property", F.concat_ws("/", "node", F.col("pos").cast("array<string>")).alias("pos"), "member")


def inverse_properties(quads) -> DataFrame:
    """(property, inverse), either direction of owl:inverseOf."""
    i = quads.where((F.col("p") == OWL + "inverseOf") & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select("s", "o")
    return i.select(F.col("s").alias("property"), F.col("o").alias("inverse")).unionByName(
        i.select(F.col("o").alias("property"), F.col("s").alias("inverse"))).distinct()


def extract_restrictions(quads) -> DataFrame:
    """(property, class, min, max, ranges): owl:Restriction nodes per restricted class.

    Exact (qualified) cardinalities set both bounds; onClass, else allValuesFrom, gives ranges. Of
    several restrictions on one property the largest minimum and smallest maximum are kept.
    """
    nodes = quads.where((F.col("p") == RDF_TYPE) & (F.col("o") == OWL + "Restriction")).select("s").distinct()
    hosts = quads.where(F.col("p").isin(SUBCLASS_OF, OWL + "equivalentClass") & (F.col("s_kind") == "iri")).select(
        F.col("s").alias("class"), F.col("o").alias("s")).distinct().join(nodes, "s", "left_semi")
    about = quads.join(nodes, "s", "left_semi")
    number = lambda *names: F.min(F.when(F.col("p").isin([OWL + n for n in names]) & (F.col("o_kind") == "literal"), F.trim("o").try_cast("int")))
    parts = about.groupBy("s").agg(
        F.min(F.when((F.col("p") == OWL + "onProperty") & (F.col("o_kind") == "iri"), F.col("o"))).alias("property"),
        number("minCardinality").alias("mn"), number("maxCardinality").alias("mx"), number("cardinality").alias("ex"),
        number("minQualifiedCardinality").alias("qmn"), number("maxQualifiedCardinality").alias("qmx"), number("qualifiedCardinality").alias("qex"),
        F.min(F.when((F.col("p") == OWL + "onClass") & (F.col("o_kind") != "literal"), F.struct("o", "o_kind"))).alias("oc"),
        F.min(F.when((F.col("p") == OWL + "allValuesFrom") & (F.col("o_kind") != "literal"), F.struct("o", "o_kind"))).alias("av"),
    ).where("property is not null")
    r = hosts.join(parts, "s")
    # Later statements override earlier ones: exact over bound, qualified over plain.
    bounds = r.groupBy("property", "class").agg(
        F.max(F.coalesce("qex", "qmn", "ex", "mn")).alias("min"), F.min(F.coalesce("qex", "qmx", "ex", "mx")).alias("max"))
    on = r.select("property", "class", F.coalesce("oc", "av").alias("n")).where("n is not null").select(
        "property", "class", F.col("n.o").alias("node"), F.col("n.o_kind").alias("node_kind"))
    ranges = resolve_members(on, quads, "node").groupBy("property", "class").agg(F.array_sort(F.collect_set("member")).alias("ranges"))
    return bounds.join(ranges, ["property", "class"], "left")


def merge_cardinality(functional, low, high):
    """(min, max) columns: functional means at most one; a restriction tightens."""
    return low, F.least(F.when(functional, F.lit(1)), high)


def extract_properties(quads, namespace=None) -> DataFrame:
    """One row per property and domain (or restricted class).

    (uri, local_name, label, kind, domain, ranges, datatype, category, min, max)
    """
    kinds = F.when(F.col("t") == OWL + "DatatypeProperty", 2).when(F.col("t") == OWL + "ObjectProperty", 1).otherwise(0)
    p = _typed(quads, OWL + "ObjectProperty", OWL + "DatatypeProperty", RDF + "Property").groupBy("s").agg(F.max(kinds).alias("k"))
    p = _within(p, "s", namespace).withColumnRenamed("s", "uri")
    ranges = range_members(quads, RDFS + "range").groupBy(F.col("property").alias("uri")).agg(F.array_sort(F.collect_set("member")).alias("global_ranges"))
    functional = _typed(quads, OWL + "FunctionalProperty").select(F.col("s").alias("uri"), F.lit(True).alias("functional"))
    domains = quads.where((F.col("p") == RDFS + "domain") & (F.col("o_kind") == "iri")).select(F.col("s").alias("uri"), F.col("o").alias("domain"))
    restr = extract_restrictions(quads).select(F.col("property").alias("uri"), F.col("class").alias("domain"), "min", "max", F.col("ranges").alias("own_ranges"))
    where = domains.unionByName(restr.select("uri", "domain")).distinct()
    out = (
        p.join(ranges, "uri", "left").join(functional, "uri", "left")
        .join(_first_label(quads).withColumnRenamed("s", "uri"), "uri", "left")
        .join(where, "uri", "left").join(restr, ["uri", "domain"], "left")
    )
    none = F.array().cast("array<string>")
    first = F.try_element_at(F.coalesce("global_ranges", none), F.lit(1))
    kind = F.when(F.col("k") == 1, "OBJECT_PROPERTY").when(F.col("k") == 2, "DATATYPE_PROPERTY").when(
        F.coalesce(is_datatype(first), F.lit(False)), "DATATYPE_PROPERTY").otherwise("OBJECT_PROPERTY")
    out = out.withColumn("kind", kind).withColumn("ranges", F.coalesce("own_ranges", "global_ranges", none))
    data = F.col("kind") == "DATATYPE_PROPERTY"
    datatype = F.when(data, F.try_element_at("ranges", F.lit(1)))
    low, high = merge_cardinality(F.coalesce("functional", F.lit(False)), F.col("min"), F.col("max"))
    return out.select(
        "uri", ontology_local_name("uri").alias("local_name"), F.coalesce("label", ontology_local_name("uri")).alias("label"), "kind", "domain",
        F.when(data, none).otherwise(F.col("ranges")).alias("ranges"), datatype.alias("datatype"),
        F.when(data, datatype_category(datatype)).alias("category"), low.alias("min"), high.alias("max"),
    ).orderBy("local_name", F.coalesce(ontology_local_name("domain"), F.lit("")))
