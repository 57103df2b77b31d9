"""Namespaces, well-known IRIs and table contracts."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DCTERMS = "http://purl.org/dc/terms/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
FOAF = "http://xmlns.com/foaf/0.1/"
RICO = "https://www.ica.org/standards/RiC/ontology#"

# Prefixes known without a declaration.
IMPLICIT_PREFIXES = {
    "rdf": RDF,
    "rdfs": RDFS,
    "owl": OWL,
    "xsd": XSD,
    "dcterms": DCTERMS,
    "skos": SKOS,
    "foaf": FOAF,
    "rico": RICO,
}

RDF_TYPE = RDF + "type"
SAME_AS = OWL + "sameAs"
CREATED = DCTERMS + "created"
MODIFIED = DCTERMS + "modified"
RDFS_LABEL = RDFS + "label"
SUBCLASS_OF = RDFS + "subClassOf"

# Label predicates, in order of preference.
LABEL_PREDICATES = [RICO + "name", RDFS + "label", DCTERMS + "title", FOAF + "name"]

# Predicates giving the text of a linked entity, in order of preference.
TEXT_PREDICATES = LABEL_PREDICATES + [RICO + "textualValue", RICO + "expressedDate"]

# Datatypes read as dates and as numbers.
DATE_TYPES = [XSD + t for t in ("date", "dateTime", "gYear", "gYearMonth", "dateTimeStamp")]
NUMBER_TYPES = [
    XSD + t
    for t in (
        "integer", "int", "long", "short", "byte", "decimal", "double", "float",
        "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger",
        "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte",
    )
]

# Metadata vocabulary of the source catalogue (override by argument where another one is used).
META = "urn:quadweave:meta#"
META_GRAPH = "urn:quadweave:graph:metadata"
MATCHING_GRAPH = "urn:quadweave:graph:matching"


def data_graph(source):
    """Graph IRI of a data source."""
    return "urn:datasource:" + source


QUAD_COLUMNS = [
    "source", "graph", "graph_kind", "s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang",
]
QUAD_SCHEMA = ", ".join(f"{c} string" for c in QUAD_COLUMNS)

EVIDENCE_TYPE = (
    "array<struct<concept:string,comparator:string,weight:double,score:double,"
    "value_a:string,value_b:string>>"
)
LINK_SCHEMA = (
    "id string, source_a string, iri_a string, label_a string, types_a array<string>, "
    "source_b string, iri_b string, label_b string, types_b array<string>, "
    "status string, origin string, group_id string, score double, compared_weight double, "
    f"evidence {EVIDENCE_TYPE}, inferred_from array<string>, "
    "proposed_at timestamp, decided_at timestamp, note string"
)

CONFIRMED = ("ACCEPTED", "MANUAL")
STATUSES = ("PROPOSED", "ACCEPTED", "REJECTED", "MANUAL", "INFERRED")
