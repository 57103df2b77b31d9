"""The given tables as quads: the inputs of the registered queries.

Each set is described once by SQL expressions over a table and read with one scan per table.
"""

import re
from functools import reduce

from pyspark.sql import functions as F

from quadweave.vocab import FOAF, OWL, QUAD_COLUMNS, RDF_TYPE, RDFS, RDFS_LABEL, RICO, SUBCLASS_OF, XSD

P = "urn:p:"
# Rows of a table that one task turns into quads: each gives several rows of long strings.
ROWS_PER_TASK = 100_000

# table, graph kind, source expression, subject expression, [(predicate, object expression, kind, datatype)]
STAR = [
    ("customer", "data", "'crm'", "concat('urn:c:', c_custkey)", [
        (RDF_TYPE, "'urn:t:Customer'", "iri", None), (RICO + "name", "c_name", "literal", "string"),
        (P + "nation", "concat('urn:n:', c_nationkey)", "iri", None), (P + "segment", "c_mktsegment", "literal", "string"),
        (P + "balance", "cast(c_acctbal as string)", "literal", "decimal")]),
    ("supplier", "data", "'erp'", "concat('urn:s:', s_suppkey)", [
        (RDF_TYPE, "'urn:t:Supplier'", "iri", None), (FOAF + "name", "s_name", "literal", "string"),
        (P + "nation", "concat('urn:n:', s_nationkey)", "iri", None), (P + "balance", "cast(s_acctbal as string)", "literal", "decimal")]),
    ("part", "data", "'catalog'", "concat('urn:part:', p_partkey)", [
        (RDF_TYPE, "'urn:t:Part'", "iri", None), (RICO + "name", "p_name", "literal", "string"),
        (P + "brand", "p_brand", "literal", "string"), (P + "kind", "p_type", "literal", "string"),
        (P + "size", "cast(p_size as string)", "literal", "integer")]),
    ("nation", "data", "'geo'", "concat('urn:n:', n_nationkey)", [
        (RDF_TYPE, "'urn:t:Nation'", "iri", None), (RDFS_LABEL, "n_name", "literal", "string"),
        (P + "region", "concat('urn:r:', n_regionkey)", "iri", None)]),
    ("region", "data", "'geo'", "concat('urn:r:', r_regionkey)", [(RDFS_LABEL, "r_name", "literal", "string")]),
]
DOCS = [
    ("documents", "data", "source", "concat('urn:d:', doc_id)", [
        (RDF_TYPE, "'urn:t:Document'", "iri", None), (P + "text", "text", "literal", "string"),
        (P + "lang", "lang", "literal", "string"), (P + "chars", "cast(n_chars as string)", "literal", "string")]),
]
EVENTS = [
    ("events", "data", "event_type", "concat('urn:e:', event_id)", [
        (RDF_TYPE, "concat('urn:t:', event_type)", "iri", None), (P + "day", "cast(cast(ts as date) as string)", "literal", "date"),
        (P + "value", "cast(value as string)", "literal", "double"), (P + "user", "concat('urn:u:', user_id)", "iri", None)]),
]
ONTOLOGY = [
    ("region", "ontology", "''", "concat('urn:k:r', r_regionkey)", [
        (RDF_TYPE, f"'{OWL}Class'", "iri", None), (RDFS_LABEL, "r_name", "literal", "string"), (SUBCLASS_OF, "'urn:k:world'", "iri", None)]),
    ("nation", "ontology", "''", "concat('urn:k:n', n_nationkey)", [
        (RDF_TYPE, f"'{OWL}Class'", "iri", None), (RDFS_LABEL, "n_name", "literal", "string"),
        (SUBCLASS_OF, "concat('urn:k:r', n_regionkey)", "iri", None)]),
    ("customer", "ontology", "''", "concat('urn:k:c', c_custkey)", [
        (RDF_TYPE, f"'{OWL}Class'", "iri", None), (RDFS_LABEL, "c_name", "literal", "string"),
        (SUBCLASS_OF, "concat('urn:k:n', c_nationkey)", "iri", None)]),
    ("part", "ontology", "''", "concat('urn:k:p', p_partkey)", [
        (RDF_TYPE, f"'{OWL}ObjectProperty'", "iri", None), (RDFS_LABEL, "p_name", "literal", "string"),
        (RDFS + "comment", "concat(p_brand, ' ', p_type)", "literal", "string"),
        (RDFS + "domain", "concat('urn:k:n', p_size)", "iri", None), (RDFS + "range", "concat('urn:k:r', p_size % 5)", "iri", None)]),
]


def dealt(t, used, rows):
    """The columns of a table that the expressions ``used`` name, its rows dealt out to tasks of about ``rows``.

    Scans are cut by compressed bytes, so that one task may read millions of short rows; rows of long
    texts are few in every cut and stay where they are. The number of rows comes from the files' footers.
    """
    words = set(re.findall(r"\w+", " ".join(used).lower()))
    t = t.select(*[c for c in t.columns if c.lower() in words])
    n = t.count()
    if n <= rows * t.rdd.getNumPartitions():
        return t
    return t.repartition(-(-n // rows), *t.columns)


def quads_of(spark, sf_dir, spec):
    """Quads of a set, one scan per table."""
    out = []
    for table, kind, source, subject, facts in spec:
        t = dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"), [source, subject, *(o for _, o, _, _ in facts)], ROWS_PER_TASK)
        facts_of = F.explode(F.array(*[
            F.struct(F.lit(p).alias("p"), F.expr(o).alias("o"), F.lit(k).alias("o_kind"),
                     F.lit(None if dt is None else XSD + dt).cast("string").alias("o_datatype"))
            for p, o, k, dt in facts])).alias("f")
        graph = F.concat(F.lit("urn:datasource:"), F.col("source")) if kind == "data" else F.lit("urn:graph:onto")
        out.append(
            t.select(F.expr(source).alias("source"), F.expr(subject).alias("s"), facts_of)
            .select("source", graph.alias("graph"), F.lit(kind).alias("graph_kind"), "s", F.lit("iri").alias("s_kind"),
                    "f.*", F.lit(None).cast("string").alias("o_lang")).select(*QUAD_COLUMNS))
    return reduce(lambda a, b: a.unionByName(b), out)


def quads_sql(spec):
    """The same set as a SQL query over the tables."""
    rows = []
    for table, kind, source, subject, facts in spec:
        for p, o, k, dt in facts:
            d = "NULL" if dt is None else f"'{XSD}{dt}'"
            rows.append(f"SELECT {source} AS source, {subject} AS s, '{p}' AS p, {o} AS o, '{k}' AS o_kind, {d} AS o_datatype FROM {table}")
    return " UNION ALL ".join(rows)
