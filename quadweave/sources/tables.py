"""The quad table: reading CSV and line formats, replacing and deleting sources, exports, catalogue."""

from pyspark.sql import DataFrame, functions as F

from quadweave.functions.iri import expand_curie
from quadweave.operators.patterns import data_quads
from quadweave.vocab import LINK_SCHEMA, META, META_GRAPH, MODIFIED, QUAD_COLUMNS, QUAD_SCHEMA, RDFS_LABEL, XSD, data_graph

ENTITY_CSV = "entity string, property string, value string, typevalue string"


def read_entity_csv(spark, path) -> DataFrame:
    """Long CSV of entity, property, value, typevalue; entity and property trimmed."""
    df = spark.read.schema(ENTITY_CSV).csv(path, header=True, enforceSchema=False)
    return df.withColumn("entity", F.trim("entity")).withColumn("property", F.trim("property"))


def csv_to_quads(df, source, decision_prefix=None):
    """(quads, decisions): typed statements, and the rows that carry past decisions."""
    p = expand_curie("property")
    is_decision = p.startswith(decision_prefix) if decision_prefix else F.lit(False)
    kind = F.when(F.col("typevalue") == "iri", "iri").otherwise("literal")
    datatype = (
        F.when((F.col("typevalue") == "date") & F.col("value").rlike(r"^\d{4}$"), XSD + "gYear")
        .when((F.col("typevalue") == "date") & F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$"), XSD + "date")
        .when(F.col("typevalue") == "number", XSD + "integer")
        .when(F.col("typevalue") == "iri", F.lit(None).cast("string"))
        .otherwise(XSD + "string")
    )
    rows = df.where(~is_decision).select(
        F.lit(source).alias("source"), F.lit(data_graph(source)).alias("graph"), F.lit("data").alias("graph_kind"),
        F.col("entity").alias("s"), F.when(F.col("entity").startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), p.alias("p"),
        F.when(F.col("typevalue") == "iri", expand_curie("value")).otherwise(F.col("value")).alias("o"),
        kind.alias("o_kind"), datatype.alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")).distinct()
    decisions = df.where(is_decision).select(
        "entity", F.substring(p, F.lit(len(decision_prefix or "") + 1), F.char_length(p)).alias("decision"), "value")
    return rows, decisions


# One statement of N-Triples or N-Quads: subject, predicate, object, optional graph.
_IRI = r'<(?:[^<>"{}|^`\\\s]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>'
STATEMENT = (
    rf'^\s*({_IRI}|_:\S+)\s+({_IRI})\s+'
    rf'({_IRI}|_:[^\s.]\S*|"(?:[^"\\]|\\.)*"(?:\^\^{_IRI}|@[A-Za-z0-9-]+)?)'
    rf'\s*({_IRI}|_:\S+)?\s*\.\s*(?:#.*)?$'
)
# The one-letter escapes of the format.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(c):
    """Escapes decoded in one pass from left to right: what an escape yields is not read again."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)([^\\]+|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.)"), F.lit(1))
    letters = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])

    def plain(x):
        hexadecimal = F.lpad(F.substring(x, F.lit(3), F.char_length(x)), 8, "0")
        return (
            F.when(~x.startswith("\\"), x)
            .when(x.rlike(r"^\\[uU][0-9A-Fa-f]"), F.decode(F.unhex(hexadecimal), "UTF-32"))
            .otherwise(F.coalesce(letters[F.substring(x, 2, 1)], x))
        )

    return F.when(c.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(c)


def stage_nquads(spark, path) -> DataFrame:
    """Parsed lines (line, ok, s, p, o, ...) of N-Triples or N-Quads files; comments left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    g = lambda i: F.regexp_extract("value", STATEMENT, i)
    bare = lambda c: F.when(c.startswith("<"), _unescape(F.regexp_replace(c, "^<|>$", ""))).otherwise(c)
    t = lines.select(F.col("value").alias("line"), F.col("value").rlike(STATEMENT).alias("ok"), g(1).alias("s"), g(2).alias("p"), g(3).alias("o"), g(4).alias("g"))
    lit = F.col("o").startswith('"')
    lang = F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1)
    dt = F.regexp_extract("o", r'"\^\^<([^<>]*)>$', 1)
    body = _unescape(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1))
    return t.select(
        "line", "ok", bare(F.col("s")).alias("s"), F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), bare(F.col("p")).alias("p"),
        F.when(lit, body).otherwise(bare(F.col("o"))).alias("o"),
        F.when(lit, "literal").when(F.col("o").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.when(lit, F.when(dt != "", dt).when(lang == "", XSD + "string")).alias("o_datatype"),
        F.when(lit & (lang != ""), lang).alias("o_lang"), F.nullif(bare(F.col("g")), F.lit("")).alias("file_graph"))


def read_nquads(spark, path, source, on_error="fail") -> DataFrame:
    """Statements of a file in the source's own graph, whatever graph the file names.

    A malformed line stops the job that reads it (``on_error="fail"``), or is left out (``"skip"``);
    :func:`import_report` lists such lines.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    staged = stage_nquads(spark, path)
    if on_error == "fail":
        bad = F.raise_error(F.concat(F.lit("malformed statement: "), F.col("line")))
        staged = staged.withColumn("s", F.when(F.col("ok"), F.col("s")).otherwise(bad))
    else:
        staged = staged.where("ok")
    return staged.select(
        F.lit(source).alias("source"), F.lit(data_graph(source)).alias("graph"), F.lit("data").alias("graph_kind"),
        "s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang").distinct()


def import_report(staged, shown=None):
    """(counts, warnings): statements and malformed lines; all malformed lines, or ``shown`` of them.

    ``more`` counts the malformed lines that are not shown.
    """
    more = F.lit(0).cast("long") if shown is None else F.greatest(F.col("malformed") - shown, F.lit(0))
    counts = staged.agg(F.count_if("ok").alias("statements"), F.count_if(~F.col("ok")).alias("malformed")).withColumn("more", more)
    bad = staged.where(~F.col("ok")).select("line")
    return counts, bad if shown is None else bad.limit(shown)


def write_quads(quads, path, mode="overwrite"):
    """Write the quad table partitioned by graph kind and source."""
    quads.select(*QUAD_COLUMNS).write.mode(mode).partitionBy("graph_kind", "source").parquet(path)


def read_quads(spark, path) -> DataFrame:
    return spark.read.schema(QUAD_SCHEMA).parquet(path).select(*QUAD_COLUMNS)


def replace_source(quads, new, source) -> DataFrame:
    """The quad table with a source's content replaced by ``new``."""
    old = quads.where(~((F.col("graph_kind") == "data") & (F.col("source") == source)))
    return old.unionByName(new.withColumn("source", F.lit(source)).withColumn("graph", F.lit(data_graph(source))).withColumn("graph_kind", F.lit("data")).distinct())


def store_source(new, path, source):
    """Overwrite one source's partition on disk; nothing is touched when staging ``new`` fails.

    All statements of ``new`` become the source's. They are staged as a table first, so a failing
    import leaves the partition alone; the overwrite then replaces that partition only. A source
    left without statements loses its partition.
    """
    from quadweave.runtime import _files, cut_lineage, release

    spark = new.sparkSession
    mine = new.withColumn("source", F.lit(source)).withColumn("graph", F.lit(data_graph(source))).withColumn("graph_kind", F.lit("data"))
    staged = cut_lineage(mine.select(*QUAD_COLUMNS).distinct())
    if staged.limit(1).count() == 0:
        escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        fs, folder = _files(spark, f"{path}/graph_kind=data/source={escape(source)}")
        fs.delete(folder, True)
    else:
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_kind", "source").parquet(path)
    release(staged)


def append_to_source(quads, new, source) -> DataFrame:
    """Add statements to a source, as a set."""
    inside = (F.col("source") == source) & (F.col("graph_kind") == "data")
    mine = new.withColumn("source", F.lit(source)).withColumn("graph", F.lit(data_graph(source))).withColumn("graph_kind", F.lit("data"))
    return quads.where(~inside).unionByName(quads.where(inside).unionByName(mine.select(*QUAD_COLUMNS)).dropDuplicates())


def _term(value, kind, datatype=None, lang=None):
    esc = F.col(value)
    for plain, raw in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r")):
        esc = F.regexp_replace(esc, plain, raw)
    lit = F.concat(F.lit('"'), esc, F.lit('"'))
    if datatype:
        lit = F.when(F.col(lang).isNotNull(), F.concat(lit, F.lit("@"), F.col(lang))).when(
            F.col(datatype).isNotNull() & (F.col(datatype) != XSD + "string"), F.concat(lit, F.lit("^^<"), F.col(datatype), F.lit(">"))).otherwise(lit)
    iri = F.concat(F.lit("<"), F.col(value), F.lit(">"))
    return F.when(F.col(kind) == "literal", lit).when(F.col(kind) == "bnode", F.col(value)).otherwise(iri)


def as_triples(quads, source) -> DataFrame:
    """(value): one source as N-Triples lines, each statement once; rows without a term are left out."""
    q = data_quads(quads).where(F.col("source") == source).dropna(subset=["s", "p", "o"])
    return q.select(F.concat_ws(" ", _term("s", "s_kind"), F.concat(F.lit("<"), "p", F.lit(">")), _term("o", "o_kind", "o_datatype", "o_lang"), F.lit(".")).alias("value")).distinct()


def export_triples(quads, source, path):
    as_triples(quads, source).write.mode("overwrite").text(path)


def export_quads(quads, graphs, path):
    """Write whole graphs with their names; :func:`restore_quads` reads them back."""
    quads.where(F.col("graph").isin(list(graphs))).select(*QUAD_COLUMNS).write.mode("overwrite").partitionBy("graph_kind").parquet(path)


def restore_quads(spark, path) -> DataFrame:
    return spark.read.schema(QUAD_SCHEMA).parquet(path).select(*QUAD_COLUMNS)


def load_links(spark, path) -> DataFrame:
    """Stored links; rows without an end or a status are dropped."""
    return spark.read.schema(LINK_SCHEMA).json(path).dropna(subset=["source_a", "iri_a", "source_b", "iri_b", "status"])


def save_links(links, path):
    links.write.mode("overwrite").json(path)


def write_same_as(quads, clusters) -> DataFrame:
    """The quad table with its sameAs graph rewritten from the clusters."""
    from quadweave.operators.clusters import same_as_quads

    return quads.where("graph_kind <> 'matching'").unionByName(same_as_quads(clusters))


# --- catalogue ------------------------------------------------------------------------------


def source_catalog(quads, meta=META) -> DataFrame:
    """(short_name, long_name, type, graph, last_change) from the metadata graph, by short name."""
    m = quads.where("graph_kind = 'meta'")
    pick = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    instant = lambda p: F.max(F.when(F.col("p") == p, F.expr("try_to_timestamp(o)")))
    per = m.groupBy("s").agg(
        pick(meta + "shortName").alias("short_name"), pick(meta + "sourceType").alias("type"), pick(meta + "graph").alias("graph"),
        pick(RDFS_LABEL).alias("label"), instant(meta + "lastSync").alias("sync"), instant(MODIFIED).alias("mod"),
    ).where("short_name is not null and type is not null and graph is not null")
    return per.groupBy("short_name").agg(
        F.coalesce(F.max("label"), F.first("short_name")).alias("long_name"), F.max("type").alias("type"), F.max("graph").alias("graph"),
        F.max(F.greatest(F.coalesce("sync", "mod"), F.coalesce("mod", "sync"))).alias("last_change")).orderBy("short_name")


def catalog_quads(sources, meta=META) -> DataFrame:
    """Catalogue rows as metadata statements."""
    iri = F.concat(F.lit(meta + "source/"), F.col("short_name"))
    pairs = [(meta + "shortName", "short_name"), (meta + "sourceType", "type"), (meta + "graph", "graph"), (RDFS_LABEL, "long_name"),
             (meta + "lastSync", "last_change")]
    kv = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in pairs])).alias("kv")
    none = F.lit(None).cast("string")
    return sources.select(iri.alias("s"), kv).where("kv.o is not null").select(
        F.lit("").alias("source"), F.lit(META_GRAPH).alias("graph"), F.lit("meta").alias("graph_kind"), "s", F.lit("iri").alias("s_kind"),
        "kv.p", "kv.o", F.lit("literal").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))


def delete_source(quads, sources, name, internal_source=None, meta=META):
    """(quads, sources) without a source: its graph, its catalogue row, references to its graph."""
    if name == internal_source:
        raise ValueError("the internal source cannot be deleted")
    graph = data_graph(name)
    about = ((F.col("p") == meta + "graph") & (F.col("o") == graph)) | ((F.col("p") == meta + "shortName") & (F.col("o") == name))
    described = quads.where("graph_kind = 'meta'").where(about).select("s").distinct()
    left = quads.where(~((F.col("graph_kind") == "data") & (F.col("source") == name)))
    # Its description, and statements of others that point to it.
    kept = left.where("graph_kind = 'meta'").join(described, "s", "left_anti").join(
        described.select(F.col("s").alias("o")), "o", "left_anti").select(*QUAD_COLUMNS)
    return left.where("graph_kind <> 'meta'").unionByName(kept), sources.where(F.col("short_name") != name)


def upsert_catalogue(sources, changes, key="short_name"):
    """(sources, duplicates): change rows replace those with their key, others are added.

    Keys given twice in ``changes`` are reported and not applied. Null fields keep their old value.
    """
    dup = changes.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    ok = changes.join(dup.select(key), key, "left_anti")
    old = sources.alias("old").join(ok.alias("new"), key, "full_outer")
    cols = [F.coalesce(f"new.{c}", f"old.{c}").alias(c) if c in changes.columns and c != key else F.col(c) for c in sources.columns]
    return old.select(*cols), dup


def record_import(sources, source, at) -> DataFrame:
    """The catalogue after an import into ``source``: its ``last_change`` is ``at``, or later if it was."""
    here = F.col("short_name") == source
    at = F.lit(at).cast("timestamp")
    return sources.withColumn("last_change", F.when(here, F.greatest("last_change", at)).otherwise(F.col("last_change")))


def load_ontology_once(quads, new) -> DataFrame:
    """Add ontology graphs that are not there yet."""
    # One row per graph, as many as there are sources: rows of ``new`` stay in their tasks.
    there = F.broadcast(quads.select("graph").distinct())
    return quads.unionByName(new.join(there, "graph", "left_anti").select(*QUAD_COLUMNS).distinct())
