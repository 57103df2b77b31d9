"""IRIs: namespaces, local names, CURIEs, keys and value kinds."""

from pyspark.sql import Column, functions as F

from quadweave.vocab import IMPLICIT_PREFIXES, RDF, RDFS, XSD

PAIR_SEPARATOR = "⇄"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def namespace_of(iri) -> Column:
    """Everything up to the last ``#`` or ``/``, whichever comes later."""
    return F.regexp_extract(_c(iri), r"^(.*[#/])", 1)


def local_name(iri) -> Column:
    """What follows :func:`namespace_of`."""
    return F.regexp_replace(_c(iri), r"^.*[#/]", "")


def ontology_local_name(iri) -> Column:
    """After the first ``#``; without one, after the last ``/``."""
    c = _c(iri)
    return F.when(F.instr(c, "#") > 0, F.regexp_replace(c, "^[^#]*#", "")).otherwise(
        F.regexp_replace(c, "^.*/", "")
    )


def ontology_namespace(iri) -> Column:
    """Up to the first ``#``; without one, up to the last ``/``."""
    c = _c(iri)
    return F.when(F.instr(c, "#") > 0, F.regexp_extract(c, "^([^#]*#)", 1)).otherwise(
        F.regexp_extract(c, "^(.*/)", 1)
    )


def is_absolute_iri(iri) -> Column:
    c = _c(iri)
    return c.contains("://") | c.startswith("urn:")


def _prefix_map(prefixes):
    pairs = {**IMPLICIT_PREFIXES, **(prefixes or {})}
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def expand_curie(col, prefixes=None) -> Column:
    """Absolute IRIs unchanged; ``prefix:local`` through declared, then implicit prefixes."""
    s = F.trim(_c(col))
    colon = F.instr(s, ":")
    ns = F.try_element_at(_prefix_map(prefixes), F.substring_index(s, ":", 1))
    return F.when(
        ~is_absolute_iri(s) & (colon > 1) & ns.isNotNull(),
        F.concat(ns, F.regexp_replace(s, "^[^:]*:", "")),
    ).otherwise(s)


def compact_iri(col, prefixes=None) -> Column:
    """``prefix:local`` by the longest matching namespace whose local part has no ``/`` or ``#``."""
    c = _c(col)
    pairs = sorted({**IMPLICIT_PREFIXES, **(prefixes or {})}.items(), key=lambda kv: -len(kv[1]))
    out = None
    for prefix, ns in pairs:
        rest = F.substring(c, F.lit(len(ns) + 1), F.char_length(c))
        cond = c.startswith(ns) & (rest != "") & ~rest.rlike("[/#]")
        value = F.concat(F.lit(prefix + ":"), rest)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(c)


def prefixes_for(namespaces, prefixes=None):
    """(namespace, prefix) rows: known prefixes, and ``ns1..n`` by namespace for the others."""
    from pyspark.sql import Window

    known = {ns: p for p, ns in {**IMPLICIT_PREFIXES, **(prefixes or {})}.items()}
    by_ns = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    d = namespaces.distinct().withColumn("known", F.try_element_at(by_ns, F.col("namespace")))
    # One row per distinct unknown namespace: the ordering below is over a vocabulary, not data.
    w = Window.partitionBy(F.col("known").isNull()).orderBy("namespace")
    return d.select(
        "namespace",
        F.coalesce("known", F.concat(F.lit("ns"), F.row_number().over(w).cast("string"))).alias("prefix"),
    )


def mint_iri(prefix, type_iri, key) -> Column:
    """``<prefix>/<type local name>/<hash of the key>``."""
    return F.concat_ws("/", _c(prefix), ontology_local_name(type_iri), F.sha2(_c(key), 256))


def source_pair_key(a, b) -> Column:
    return F.concat_ws(PAIR_SEPARATOR, F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def node_key(source, iri) -> Column:
    return F.concat_ws("\u0001", _c(source), _c(iri))


def node_pair_key(source_a, iri_a, source_b, iri_b) -> Column:
    """Key of an unordered pair of nodes."""
    a, b = node_key(source_a, iri_a), node_key(source_b, iri_b)
    return F.concat_ws("\u0002", F.least(a, b), F.greatest(a, b))


def link_id(source_a, iri_a, source_b, iri_b) -> Column:
    return F.sha2(node_pair_key(source_a, iri_a, source_b, iri_b), 256)


# Categories of XSD datatypes, by local name; any other datatype is LITERAL.
DATATYPE_CATEGORIES = {
    "STRING": ["string"],
    "BOOLEAN": ["boolean"],
    "INTEGER": [
        "integer", "int", "long", "short", "byte", "positiveInteger", "nonNegativeInteger",
        "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort",
        "unsignedByte",
    ],
    "DECIMAL": ["decimal"],
    "FLOAT": ["float", "double"],
    "DATETIME": [
        "date", "time", "dateTime", "dateTimeStamp", "gYear", "gMonth", "gDay", "gYearMonth",
        "gMonthDay", "duration", "yearMonthDuration", "dayTimeDuration",
    ],
    "BINARY": ["hexBinary", "base64Binary"],
    "URI": ["anyURI"],
}


def is_datatype(range_iri) -> Column:
    c = _c(range_iri)
    return c.startswith(XSD) | c.isin(RDFS + "Literal", RDF + "langString")


def datatype_category(range_iri) -> Column:
    """Category of the datatype a property takes; LITERAL when unknown or absent."""
    pairs = {XSD + n: cat for cat, names in DATATYPE_CATEGORIES.items() for n in names}
    pairs[RDF + "langString"] = "STRING"
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _c(range_iri)), F.lit("LITERAL"))


def value_kind(o_kind="o_kind", o_datatype="o_datatype", o_lang="o_lang") -> Column:
    """``iri``, ``text@<lang>``, ``literal:<datatype local name>`` or ``other``."""
    return (
        F.when(_c(o_kind) == "iri", F.lit("iri"))
        .when((_c(o_kind) == "literal") & _c(o_lang).isNotNull(), F.concat(F.lit("text@"), _c(o_lang)))
        .when(
            _c(o_kind) == "literal",
            F.concat(F.lit("literal:"), F.coalesce(local_name(o_datatype), F.lit("string"))),
        )
        .otherwise(F.lit("other"))
    )
