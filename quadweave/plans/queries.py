"""Registered queries: every operator on quads derived from the given tables, with its SQL twin."""

from pyspark.sql import functions as F

from quadweave.functions import iri as I
from quadweave.functions import text as T
from quadweave.functions.dates import parse_partial_date
from quadweave.operators import blocking, clusters as C, closures, links as L, ontology as X, patterns as Pt
from quadweave.operators import profiles as Pr, search as Q, stats as A, tabular, updates as U
from quadweave.plans import matching as M
from quadweave.plans.config import load_config
from quadweave.plans.datasets import DOCS, EVENTS, ONTOLOGY, P, STAR, quads_of, quads_sql
from quadweave.runtime import cut_lineage
from quadweave.sources import tables as S
from quadweave.vocab import FOAF, LINK_SCHEMA, RDF_TYPE, RDFS_LABEL, RICO, SUBCLASS_OF

QUERIES, ORACLES = {}, {}
NAME = RICO + "name"
SQ = f"WITH q AS ({quads_sql(STAR)}) "
DQ = f"WITH q AS ({quads_sql(DOCS)}) "
EQ = f"WITH q AS ({quads_sql(EVENTS)}) "
OQ = f"q AS ({quads_sql(ONTOLOGY)})"
FOLD = "strip_accents(lower({}))"
TOKENS = "list_filter(string_split_regex(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
STOP = "[" + ", ".join("'" + w + "'" for w in T.STOP_WORDS) + "]"
WORDS = "list_distinct(list_filter(" + TOKENS + ", lambda w: NOT list_contains(" + STOP + ", w)))"
LABELS = "'" + "', '".join([NAME, RDFS_LABEL, "http://purl.org/dc/terms/title", FOAF + "name"]) + "'"


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def star(spark, d):
    return quads_of(spark, d, STAR)


def docs(spark, d):
    return quads_of(spark, d, DOCS)


def events(spark, d):
    return quads_of(spark, d, EVENTS)


def onto(spark, d):
    return quads_of(spark, d, ONTOLOGY)


def joined(c):
    return F.array_join(F.array_sort(c), "|")


# --- sources --------------------------------------------------------------------------------


@query(SQ + "SELECT source, count(*) AS triples FROM q GROUP BY source")
def triple_count(spark, d):
    return A.triple_count(star(spark, d))


@query(DQ + "SELECT source, p, count(*) AS n FROM (SELECT source, p, o FROM q WHERE source <> 'src0' UNION ALL "
       "SELECT 'src0', p, o FROM q WHERE source = 'src1') GROUP BY source, p")
def replace_source(spark, d):
    q = docs(spark, d)
    return S.replace_source(q, q.where("source = 'src1'"), "src0").groupBy("source", "p").agg(F.count(F.lit(1)).alias("n"))


@query(DQ + "SELECT source, count(*) AS n FROM (SELECT source, s, p, o FROM q UNION SELECT 'src0', s, p, o FROM q WHERE source = 'src1') GROUP BY source")
def append_to_source(spark, d):
    q = docs(spark, d)
    return S.append_to_source(q, q.where("source = 'src1'"), "src0").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(SQ + "SELECT DISTINCT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN o_datatype LIKE '%#string' "
       "THEN '\"' || o || '\"' ELSE '\"' || o || '\"^^<' || o_datatype || '>' END || ' .' AS value FROM q WHERE source = 'crm'")
def export_triples(spark, d):
    return S.as_triples(star(spark, d), "crm")


@query(SQ + "SELECT source, count(*) AS n FROM q WHERE source <> 'erp' GROUP BY source")
def delete_source(spark, d):
    q = star(spark, d)
    cat = spark.createDataFrame([("erp",)], "short_name string")
    return S.delete_source(q, cat, "erp", "crm")[0].groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _catalogue(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("short_name")).agg(F.max("ts").alias("last_change")).select(
        "short_name", F.upper("short_name").alias("long_name"), F.lit("external").alias("type"),
        F.concat(F.lit("urn:datasource:"), "short_name").alias("graph"), F.date_trunc("second", "last_change").alias("last_change"))


@query("SELECT event_type AS short_name, upper(event_type) AS long_name, 'external' AS type, 'urn:datasource:' || event_type AS graph, "
       "strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS last_change FROM events GROUP BY event_type")
def source_catalog(spark, d):
    return S.source_catalog(S.catalog_quads(_catalogue(spark, d))).withColumn("last_change", F.date_format("last_change", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_type AS short_name, CASE WHEN event_type < 'p' THEN 'changed' ELSE upper(event_type) END AS long_name FROM events GROUP BY event_type")
def upsert_catalogue(spark, d):
    c = _catalogue(spark, d)
    ch = c.where("short_name < 'p'").select("short_name", F.lit("changed").alias("long_name"))
    return S.upsert_catalogue(c, ch)[0].select("short_name", "long_name")


# --- patterns and joins ---------------------------------------------------------------------


@query(SQ + f"SELECT s, o FROM q WHERE p = '{P}segment' AND source = 'crm'")
def match_pattern(spark, d):
    return Pt.match(star(spark, d), p=P + "segment", source="crm").select("s", "o")


@query(SQ + f"SELECT a.s AS e, b.o AS region, c.o AS label FROM q a JOIN q b ON a.o = b.s AND b.p = '{P}region' JOIN q c ON c.s = b.o AND c.p = '{RDFS_LABEL}' WHERE a.p = '{P}nation'")
def graph_pattern(spark, d):
    return Pt.bgp(star(spark, d), [("?e", P + "nation", "?n"), ("?n", P + "region", "?region"), ("?region", RDFS_LABEL, "?label")]).select("e", "region", "label")


@query(SQ + f"SELECT a.s, b.o AS segment FROM q a LEFT JOIN q b ON a.s = b.s AND b.p = '{P}segment' WHERE a.p = '{P}balance'")
def optional_pattern(spark, d):
    q = star(spark, d)
    return Pt.optional(Pt.pattern(q, "?s", P + "balance", "?b").select("s"), Pt.pattern(q, "?s", P + "segment", "?segment"))


@query(SQ + f"SELECT DISTINCT s FROM q WHERE s NOT IN (SELECT s FROM q WHERE p = '{RDF_TYPE}')")
def list_without_type(spark, d):
    return Pt.list_without_type(star(spark, d))


@query(SQ + f"SELECT s, 'urn:t:Nation' AS types, 'external' AS origin, min(o) FILTER (p = '{RDFS_LABEL}') AS label FROM q WHERE s LIKE 'urn:n:%' GROUP BY s "
       f"UNION ALL SELECT s, 'urn:t:Supplier', 'internal', min(o) FILTER (p = '{FOAF}name') FROM q WHERE s LIKE 'urn:s:%' GROUP BY s")
def list_by_types(spark, d):
    return Pt.list_by_types(star(spark, d), ["urn:t:Nation", "urn:t:Supplier"], "erp").select("s", joined(F.col("matched_types")).alias("types"), "origin", "label")


@query(SQ + f"SELECT s, min(o) AS name FROM q WHERE p IN ({LABELS}) AND s LIKE 'urn:c:%' AND lower(o) LIKE '%99%' GROUP BY s")
def name_contains(spark, d):
    return Pt.name_contains(star(spark, d), "urn:t:Customer", "99")


@query(SQ + f"SELECT a.s, min(n.o) AS name, min(r.o) AS value FROM q a JOIN q r ON r.s = a.o AND r.p = '{RDFS_LABEL}' LEFT JOIN q n ON n.s = a.s AND n.p IN ({LABELS}) "
       f"WHERE a.p = '{P}nation' AND a.s LIKE 'urn:c:%' AND lower(r.o) LIKE '%nation_1%' GROUP BY a.s")
def property_contains(spark, d):
    return Pt.property_contains(star(spark, d), "urn:t:Customer", P + "nation", "nation_1", name_predicate=RDFS_LABEL)


@query("SELECT doc_id FROM documents WHERE " + FOLD.format("text") + " LIKE '%ere%'")
def folded_contains(spark, d):
    return Pt.folded_contains(spark.read.parquet(f"{d}/documents.parquet"), "ÉRÉ", ["text"]).select("doc_id")


@query(SQ + f"SELECT s AS iri, min(o) AS text FROM q WHERE p IN ({LABELS}) GROUP BY s")
def linked_text(spark, d):
    return Pr.linked_text(star(spark, d))


@query(SQ + f"SELECT s, coalesce(min(o) FILTER (p IN ({LABELS})), min(o) FILTER (o_kind = 'literal'), s) AS label FROM q GROUP BY s")
def best_label(spark, d):
    return Pt.best_label(star(spark, d))


@query(SQ + f"SELECT q.s, q.p, count(DISTINCT q.o) AS n, max(l.o) AS linked FROM q LEFT JOIN q l ON l.s = q.o AND q.o_kind = 'iri' AND l.p = '{RDFS_LABEL}' WHERE q.s LIKE 'urn:s:%' AND q.p <> '{RDF_TYPE}' GROUP BY q.s, q.p")
def describe_entities(spark, d):
    q = star(spark, d)
    e = Pt.describe_entities(q, Pt.instances(q, ["urn:t:Supplier"])).where(F.col("p") != RDF_TYPE)
    return e.select("s", "p", F.size("values").cast("long").alias("n"), F.array_max(F.transform("values", lambda v: v["linked_name"])).alias("linked"))


@query("SELECT iri, sources FROM (SELECT 'urn:u:' || user_id AS iri, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS sources, count(DISTINCT event_type) AS n FROM events GROUP BY user_id) WHERE n > 1")
def identical_iris(spark, d):
    q = events(spark, d).where(F.col("p") == P + "user").withColumn("s", F.col("o"))
    return Pt.identical_iris(q).select("iri", F.array_join("sources", "|").alias("sources"))


@query(SQ + f"SELECT DISTINCT s FROM q WHERE p = '{P}balance' INTERSECT SELECT s FROM q WHERE p = '{P}segment'")
def common_entities(spark, d):
    q = star(spark, d)
    return Pt.common_entities(q.where(F.col("p") == P + "balance"), q.where(F.col("p") == P + "segment"), "s")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE lower(c_name) LIKE '%9%' OR lower(c_mktsegment) LIKE '%9%' ORDER BY lower(c_name) DESC LIMIT 20 OFFSET 20")
def filter_sort_page(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet")
    return Pt.filter_sort_page(t, "9", ["c_name", "c_mktsegment"], "c_name", False, 1).select("c_custkey", "c_name", "c_acctbal")


# --- statistics -----------------------------------------------------------------------------


@query(SQ + f"SELECT o AS type, source, count(DISTINCT s) AS entities, sum(count(DISTINCT s)) OVER (PARTITION BY o)::BIGINT AS total FROM q WHERE p = '{RDF_TYPE}' GROUP BY o, source")
def type_usage(spark, d):
    return A.type_usage(star(spark, d)).select("type", "source", "entities", F.col("total").cast("long").alias("total"))


@query(SQ + f"SELECT p, source, count(DISTINCT s) AS subjects FROM q WHERE p <> '{RDF_TYPE}' AND source IN ('crm', 'erp') GROUP BY p, source")
def predicate_usage(spark, d):
    return A.predicate_usage(star(spark, d), ["urn:t:Customer", "urn:t:Supplier"])


@query(SQ + f", b AS (SELECT * FROM q WHERE source IN ('crm', 'erp') AND p <> '{RDF_TYPE}'), smp AS (SELECT p, string_agg(o, '|' ORDER BY o) AS samples FROM (SELECT DISTINCT p, o FROM b) GROUP BY p) "
       "SELECT b.p, count(*) AS total, round(avg(CASE WHEN o_kind = 'literal' THEN length(o) END), 6) AS average_length, max(CASE WHEN o_kind = 'iri' THEN 'linkedEntity' "
       f"WHEN o_datatype LIKE '%#decimal' THEN 'number' WHEN b.p IN ({LABELS}) THEN 'name' ELSE 'string' END) AS comparator, max(samples) AS samples FROM b JOIN smp USING (p) GROUP BY b.p")
def predicate_profile(spark, d):
    p = A.predicate_profile(star(spark, d), ["urn:t:Customer", "urn:t:Supplier"])
    return p.select("p", "total", F.round("average_length", 6).alias("average_length"), "comparator", F.array_join("samples", "|").alias("samples"))


DOC_CONFIG = {
    "defaults": {"threshold": 0.75, "minimumComparedWeight": 2.0, "maxProposalsPerEntity": 5},
    "equivalentGroups": [{
        "id": "document", "groupLabel": "Document", "equivalentTypes": ["urn:t:Document"], "requiredConcepts": ["text"],
        "properties": {
            "text": {"predicates": [P + "text"], "comparator": "text", "weight": 3},
            "lang": {"predicates": [P + "lang"], "comparator": "exact", "weight": 1},
            "chars": {"predicates": [P + "chars"], "comparator": "exact", "weight": 1, "blocking": True}}}],
}


@query(DQ + f"SELECT source, concept, count(DISTINCT s) AS entities_with_value, round(100.0 * count(DISTINCT s) / max(n), 1) AS percent FROM (SELECT q.source, q.s, "
       f"CASE q.p WHEN '{P}text' THEN 'text' WHEN '{P}lang' THEN 'lang' WHEN '{P}chars' THEN 'chars' END AS concept, n FROM q JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source) WHERE q.p <> '{RDF_TYPE}' AND q.o IS NOT NULL) GROUP BY source, concept")
def coverage(spark, d):
    g = load_config(DOC_CONFIG).groups[0]
    return A.coverage(docs(spark, d), g).select("source", "concept", "entities_with_value", "percent")


@query(SQ + "SELECT DISTINCT p FROM q")
def used_predicates(spark, d):
    return A.used_predicates(star(spark, d))


@query("SELECT count(*) AS n FROM customer")
def count_by_type(spark, d):
    return A.count_by_type(star(spark, d), "urn:t:Customer")


@query("SELECT 'urn:part:' || p_partkey AS s, p_name AS name FROM part")
def list_by_type(spark, d):
    return Pt.list_by_type(star(spark, d), "urn:t:Part")


@query(SQ + "SELECT DISTINCT p FROM q WHERE s LIKE 'urn:part:%'")
def properties_of_type(spark, d):
    return A.properties_of_type(star(spark, d), "urn:t:Part")


@query("SELECT '" + RDF_TYPE.rsplit("#", 1)[0] + "' AS namespace, 'x' AS used WHERE false UNION ALL SELECT '', string_agg(DISTINCT 'urn:t:' || event_type, '|' ORDER BY 'urn:t:' || event_type) FROM events")
def types_by_namespace(spark, d):
    return A.types_by_namespace(events(spark, d)).select("namespace", F.array_join("used", "|").alias("used"))


@query("WITH k AS (SELECT 'urn:d:' || doc_id AS s, 1 + count(text) + count(lang) + count(n_chars) AS n FROM documents GROUP BY doc_id) SELECT 'urn:t:Document' AS type, s, n::INT AS triples FROM k ORDER BY n DESC, s LIMIT 1")
def richest_entity(spark, d):
    return A.richest_entity(docs(spark, d)).select("type", "s", F.col("triples").cast("int").alias("triples"))


@query(SQ + f", b AS (SELECT t.o AS type, q.p, q.o, q.s, q.o_kind FROM q JOIN q t ON t.s = q.s AND t.p = '{RDF_TYPE}' WHERE q.p <> '{RDF_TYPE}') "
       "SELECT type, p, o, n, r AS position FROM (SELECT type, p, o, n, row_number() OVER (PARTITION BY type, p ORDER BY n DESC, o) AS r FROM (SELECT type, p, o, count(*) AS n FROM b GROUP BY type, p, o HAVING count(*) >= 2))")
def recurring_values(spark, d):
    v = A.usage_profile(star(spark, d))["values"]
    return v.select("type", "p", "o", "n", F.col("position").cast("long").alias("position"))


@query(SQ + f"SELECT t.o AS type, q.p, count(DISTINCT q.s) AS subjects, string_agg(DISTINCT q.source, '|' ORDER BY q.source) AS sources FROM q JOIN q t ON t.s = q.s AND t.p = '{RDF_TYPE}' WHERE q.p <> '{RDF_TYPE}' GROUP BY t.o, q.p")
def usage_profile(spark, d):
    p = A.usage_profile(star(spark, d))["predicates"]
    return p.select("type", "p", "subjects", F.array_join("sources", "|").alias("sources"))


@query(SQ + f"SELECT q.p, t.o AS type, count(DISTINCT q.s) AS subjects FROM q JOIN q t ON t.s = q.s AND t.p = '{RDF_TYPE}' WHERE q.p IN ('{P}nation', '{P}balance') GROUP BY q.p, t.o")
def find_usage(spark, d):
    return A.find_usage(star(spark, d), "nation or balanse").select("p", "type", "subjects")


@query("SELECT 'UNUSED_PREDICATE' AS code, 'g' AS group_id, 'urn:p:none' AS subject UNION ALL SELECT 'UNKNOWN_TYPE', 'g', 'urn:t:None'")
def validate_vocabulary(spark, d):
    cfg = load_config({"equivalentGroups": [{"id": "g", "groupLabel": "G", "equivalentTypes": ["urn:t:None", "urn:t:Part"], "properties": {"n": [NAME, "urn:p:none"]}}]})
    return A.validate_vocabulary(cfg, star(spark, d))


@query("SELECT p_type AS entity, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names FROM part GROUP BY p_type")
def pivot_multivalue(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_type as entity", "stack(2, 'brand', p_brand, 'name', p_name) as (property, value)", "'string' as typevalue")
    w = tabular.pivot_multivalue(t, ["brand", "name"])
    return w.select("entity", F.array_join("brand_values", "|").alias("brands"), F.array_join("name_values", "|").alias("names"))


# --- scalar functions -----------------------------------------------------------------------


@query("SELECT doc_id, md5(array_to_string(" + TOKENS.format("text") + ", ' ')) AS words, len(" + WORDS.format("text") + ") AS content_words FROM documents")
def fold_and_tokens(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    t = t.select("doc_id", T.normalize("text").alias("n"))
    tok = T.tokens_of_normalized(F.col("n"))
    return t.select("doc_id", F.md5(F.array_join(tok, " ")).alias("words"), F.size(T.content_words_of(tok)).cast("long").alias("content_words"))


@query("SELECT a.p_name AS x, b.p_name AS y, round(1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 9) AS similarity "
       "FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1)")
def edit_similarity(spark, d):
    n = spark.read.parquet(f"{d}/part.parquet").select("p_name").distinct().withColumn("k", F.substring_index("p_name", " ", 1))
    m = n.select("k", F.col("p_name").alias("x")).join(n.select("k", F.col("p_name").alias("y")), "k")
    return m.select("x", "y", F.round(T.edit_similarity(F.col("x"), F.col("y")), 9).alias("similarity"))


@query("SELECT o_orderkey, CAST(make_date(year(o_orderdate)::BIGINT, month(o_orderdate)::BIGINT, 1::BIGINT) AS VARCHAR) AS first_day, CAST(last_day(o_orderdate) AS VARCHAR) AS last_day FROM orders")
def partial_dates(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", parse_partial_date(F.date_format("o_orderdate", "yyyy-MM")).alias("i"))
    return t.select("o_orderkey", F.col("i.start").cast("string").alias("first_day"), F.col("i.end").cast("string").alias("last_day"))


@query("SELECT page_id, regexp_extract(url, '^(.*[#/])', 1) AS namespace, regexp_replace(url, '^.*[#/]', '') AS local_name, "
       "CASE WHEN contains(url, '#') THEN regexp_replace(url, '^[^#]*#', '') ELSE regexp_replace(url, '^.*/', '') END AS ontology_name FROM pages")
def iri_parts(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet")
    return t.select("page_id", I.namespace_of("url").alias("namespace"), I.local_name("url").alias("local_name"), I.ontology_local_name("url").alias("ontology_name"))


# --- matching -------------------------------------------------------------------------------

DOC_VALUES = ("d AS (SELECT source, 'urn:d:' || doc_id AS iri, lang, n_chars, " + WORDS.format("text") + " AS w FROM documents), "
              "pr AS (SELECT a.source AS source_a, a.iri AS iri_a, b.source AS source_b, b.iri AS iri_b, a.lang = b.lang AS same, len(a.w) AS la, len(b.w) AS lb, len(list_intersect(a.w, b.w)) AS c "
              "FROM d a JOIN d b ON a.n_chars = b.n_chars AND a.source < b.source), "
              "sc AS (SELECT *, la > 0 AND lb > 0 AS ok, floor((3.0::DOUBLE * (CASE WHEN la > 0 AND lb > 0 THEN c::DOUBLE / (la + lb - c) END) + (CASE WHEN same THEN 1.0 ELSE 0.0 END)::DOUBLE + 1.0::DOUBLE) / 5.0::DOUBLE * 10000 + 0.5) / 10000.0 AS score FROM pr), "
              "rk AS (SELECT *, row_number() OVER (PARTITION BY source_a, iri_a, source_b ORDER BY score DESC, iri_b) AS ra, row_number() OVER (PARTITION BY source_b, iri_b, source_a ORDER BY score DESC, iri_a) AS rb FROM sc WHERE ok AND score >= 0.75) ")


def _no_links(spark):
    return spark.createDataFrame([], LINK_SCHEMA)


@query("WITH " + DOC_VALUES + "SELECT source_a, iri_a, source_b, iri_b, score FROM rk WHERE ra <= 5 OR rb <= 5")
def match_documents(spark, d):
    run = M.run_all_pairs(docs(spark, d), _no_links(spark), load_config(DOC_CONFIG))
    return run.proposals.select("source_a", "iri_a", "source_b", "iri_b", "score")


@query("WITH " + DOC_VALUES + ", n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT a.source AS source_a, b.source AS source_b, a.n AS entities_a, b.n AS entities_b, a.n * b.n AS possible_pairs, "
       "coalesce(k.c, 0) AS compared_pairs, coalesce(k.below, 0) AS below_threshold, coalesce(k.weak, 0) AS insufficient_evidence, coalesce(r.c, 0) AS proposals FROM n a JOIN n b ON a.source < b.source "
       "LEFT JOIN (SELECT source_a, source_b, count(*) AS c, count(*) FILTER (ok AND score < 0.75) AS below, count(*) FILTER (NOT ok) AS weak FROM sc GROUP BY source_a, source_b) k ON k.source_a = a.source AND k.source_b = b.source "
       "LEFT JOIN (SELECT source_a, source_b, count(*) AS c FROM rk WHERE ra <= 5 OR rb <= 5 GROUP BY source_a, source_b) r ON r.source_a = a.source AND r.source_b = b.source")
def run_summary(spark, d):
    run = M.run_all_pairs(docs(spark, d), _no_links(spark), load_config(DOC_CONFIG))
    return M.run_summary(run).select("source_a", "source_b", "entities_a", "entities_b", "possible_pairs", "compared_pairs", "below_threshold", "insufficient_evidence", "proposals")


@query("WITH " + DOC_VALUES + "SELECT b::INT AS bin, count(s.score) AS pairs FROM range(20) t(b) LEFT JOIN (SELECT CASE WHEN ok THEN score ELSE floor(((CASE WHEN same THEN 1.0 ELSE 0.0 END)::DOUBLE + 1.0) / 2.0 * 10000 + 0.5) / 10000.0 END AS score FROM sc) s ON least(floor(s.score * 20), 19) = b GROUP BY b")
def score_histogram(spark, d):
    run = M.run_all_pairs(docs(spark, d), _no_links(spark), load_config(DOC_CONFIG))
    return M.preview_histogram(run)


PART_CONFIG = {
    "defaults": {"maxProposalsPerEntity": 2},
    "equivalentGroups": [{
        "id": "part", "groupLabel": "Part", "equivalentTypes": ["urn:t:Part"], "requiredConcepts": ["name"],
        "properties": {"name": {"predicates": [NAME], "comparator": "name", "weight": 3, "blocking": True}}}],
}


@query("WITH k AS (SELECT source, 'urn:d:' || doc_id AS iri, 'e:' || n_chars AS key FROM documents) SELECT source, iri, key FROM k")
def blocking_keys(spark, d):
    q, cfg = docs(spark, d), load_config(DOC_CONFIG)
    e = closures.expanded_groups(spark, cfg)
    return blocking.blocking_keys(M.ranked_values(q, cfg, e)).select("source", "iri", "key")


@query("WITH t AS (SELECT p_type, p_brand, p_name FROM part), a AS (SELECT DISTINCT p_type, p_name AS v FROM t) SELECT x.p_type AS source_entity, y.p_type AS target_entity, count(*) AS shared FROM a x JOIN a y ON x.v = y.v AND x.p_type < y.p_type GROUP BY ALL")
def shared_values(spark, d):
    q = spark.read.parquet(f"{d}/part.parquet").select("p_type", F.col("p_name").alias("v")).distinct()
    from quadweave.runtime import skew_safe_join

    m = skew_safe_join(q.withColumnRenamed("p_type", "source_entity"), q.withColumnRenamed("p_type", "target_entity"), ["v"], ["source_entity"], ["target_entity"], target=1)
    return m.where("source_entity < target_entity").groupBy("source_entity", "target_entity").agg(F.count(F.lit(1)).alias("shared"))


@query()
def match_tables(spark, d):
    """Suppliers as a long table matched with itself: names and nations with equal weights; the SQL twin stands with the letters."""
    n = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("concat('s', s_suppkey) as entity", "stack(2, 'name', s_name, 'nation', cast(s_nationkey as string)) as (property, value)").withColumn(
        "typevalue", F.when(F.col("property") == "name", "string").otherwise("number"))
    return tabular.match_tables(n, n, [["urn:t:Supplier"]], 95)


# --- links and clusters ---------------------------------------------------------------------


def _copy_links(spark, d, status="ACCEPTED"):
    """A chain of links from each copy of a text to the smallest one, in another source."""
    e = spark.read.parquet(f"{d}/documents.parquet").select("source", F.concat(F.lit("urn:d:"), "doc_id").alias("iri"), F.md5("text").alias("h"))
    root = e.groupBy("h").agg(F.min(F.struct("source", "iri")).alias("r"))
    pairs = e.join(root, "h").where("source <> r.source").select(
        F.col("r.source").alias("source_a"), F.col("r.iri").alias("iri_a"), F.col("source").alias("source_b"), F.col("iri").alias("iri_b"))
    given = {"id": I.link_id("source_a", "iri_a", "source_b", "iri_b"), "status": F.lit(status), "origin": F.lit("ALGORITHM"), "score": F.lit(1.0)}
    from pyspark.sql.types import _parse_datatype_string

    cols = []
    for f in _parse_datatype_string(LINK_SCHEMA).fields:
        c = given.get(f.name, F.col(f.name) if f.name in pairs.columns else F.lit(None))
        cols.append(c.cast(f.dataType).alias(f.name))
    return pairs.select(*cols)


def _no_identical(spark):
    return spark.createDataFrame([], "iri string, sources array<string>")


# Links from the smallest copy of a text to its copies in other sources.
LINKS_SQL = ("e AS (SELECT source, 'urn:d:' || doc_id AS iri, md5(text) AS h FROM documents), "
             "r AS (SELECT h, source AS rs, iri AS ri FROM e QUALIFY row_number() OVER (PARTITION BY h ORDER BY source, iri) = 1), "
             "l AS (SELECT rs AS source_a, ri AS iri_a, source AS source_b, iri AS iri_b FROM e JOIN r USING (h) WHERE source <> rs), "
             "n AS (SELECT source_a AS source, iri_a AS iri, source_a || '~' || iri_a AS c FROM l UNION SELECT source_b, iri_b, source_a || '~' || iri_a FROM l) ")


@query("WITH " + LINKS_SQL + "SELECT source, iri, c AS cluster FROM n")
def build_clusters(spark, d):
    c = C.build_clusters(_copy_links(spark, d), _no_identical(spark))
    return c.select("source", "iri", F.replace("cluster_id", F.lit("\u0001"), F.lit("~")).alias("cluster"))


@query("WITH " + LINKS_SQL + "SELECT DISTINCT a.iri AS s, b.iri AS o FROM n a JOIN n b USING (c) WHERE a.iri <> b.iri")
def same_as(spark, d):
    return C.same_as(C.build_clusters(_copy_links(spark, d), _no_identical(spark)))


@query("WITH " + LINKS_SQL + "SELECT source, c AS cluster, count(*) AS n FROM n GROUP BY source, c HAVING count(*) > 1")
def conflicts(spark, d):
    lk = _copy_links(spark, d)
    c = C.conflicts(C.build_clusters(lk, _no_identical(spark)), lk)
    return c.select("source", F.replace("cluster_id", F.lit("\u0001"), F.lit("~")).alias("cluster"), F.size("nodes").cast("long").alias("n"))


@query("WITH " + LINKS_SQL + "SELECT a.source AS source_a, a.iri AS iri_a, b.source AS source_b, b.iri AS iri_b, 2 AS steps FROM n a JOIN n b USING (c) WHERE a.source < b.source AND a.source || '~' || a.iri <> c AND b.source || '~' || b.iri <> c")
def infer_links(spark, d):
    lk, none = _copy_links(spark, d), _no_identical(spark)
    r = C.reconcile(lk, C.build_clusters(lk, none), none).where("change = 'added'")
    return r.select("source_a", "iri_a", "source_b", "iri_b", F.size("inferred_from").alias("steps"))


@query("WITH " + LINKS_SQL + "SELECT c AS cluster, count(*) AS size, bool_or(k > 1) AS conflict FROM (SELECT *, count(*) OVER (PARTITION BY c, source) AS k FROM n) GROUP BY c")
def cluster_table(spark, d):
    lk = _copy_links(spark, d)
    t = C.cluster_table(C.build_clusters(lk, _no_identical(spark)), lk)
    return t.select(F.replace("cluster_id", F.lit("\u0001"), F.lit("~")).alias("cluster"), F.col("size").cast("long").alias("size"), "conflict")


@query("WITH " + LINKS_SQL + "SELECT source_a, source_b, count(*) AS n FROM (SELECT source_a, source_b FROM l) GROUP BY ALL")
def overview(spark, d):
    lk = _copy_links(spark, d)
    src = spark.read.parquet(f"{d}/documents.parquet").groupBy(F.col("source").alias("short_name")).agg(F.lit(None).cast("timestamp").alias("last_change"))
    runs = spark.createDataFrame([], "source_a string, source_b string, started_at timestamp, configuration_hash string")
    fl = lk.select("id", F.lit(False).alias("superseded"), F.lit(False).alias("orphan_a"), F.lit(False).alias("orphan_b"))
    return L.overview(lk, fl, src, runs).where("accepted > 0").select("source_a", "source_b", F.col("accepted").alias("n"))


@query("WITH " + LINKS_SQL + "SELECT source_a, iri_a, source_b, iri_b FROM l QUALIFY row_number() OVER (PARTITION BY source_a, iri_a, source_b ORDER BY iri_b) = 1")
def accept_proposals(spark, d):
    """Proposals to copies accepted one after the other: one counterpart per source."""
    lk = cut_lineage(_copy_links(spark, d, "PROPOSED"))
    dec = lk.select(F.struct("source_a", "iri_a", "source_b", "iri_b").alias("ord"), "id", F.lit("ACCEPT").alias("action"))
    out = L.apply_decisions(lk, dec, _no_identical(spark))
    return out.links.where("status = 'ACCEPTED'").select("source_a", "iri_a", "source_b", "iri_b")


@query("WITH " + LINKS_SQL + "SELECT source_a, iri_a, source_b, iri_b FROM l ORDER BY iri_a, iri_b, source_a, source_b LIMIT 50")
def page_links(spark, d):
    lk = _copy_links(spark, d).withColumn("id", F.concat_ws(" ", "source_a", "source_b"))
    return L.page_links(lk, 0, 50)[0].select("source_a", "iri_a", "source_b", "iri_b")


@query("WITH " + LINKS_SQL + "SELECT source_a, iri_a, source_b, iri_b FROM l WHERE source_b = (SELECT max(source_b) FROM l)")
def orphans(spark, d):
    lk = _copy_links(spark, d)
    gone = lk.agg(F.max("source_b")).first()[0]
    o = L.orphans(lk, docs(spark, d).where(F.col("source") != gone)).where("orphan_b").select("id")
    return lk.join(o, "id", "left_semi").select("source_a", "iri_a", "source_b", "iri_b")


# --- closures -------------------------------------------------------------------------------

EDGES = f"WITH RECURSIVE {OQ}, e AS (SELECT DISTINCT s AS sub, o AS super FROM q WHERE p = '{SUBCLASS_OF}'), "


@query(EDGES + "c AS (SELECT super AS root, sub AS type FROM e UNION SELECT c.root, e.sub FROM c JOIN e ON e.super = c.type) SELECT root, type FROM c UNION SELECT sub, sub FROM e UNION SELECT super, super FROM e")
def subclass_closure(spark, d):
    return closures.subclass_closure(closures.subclass_edges(onto(spark, d)))


@query(EDGES + "c AS (SELECT 'urn:k:r1' AS type UNION SELECT e.sub FROM c JOIN e ON e.super = c.type) SELECT type FROM c")
def type_subclasses(spark, d):
    return closures.type_subclasses(closures.subclass_edges(onto(spark, d)), "urn:k:r1")


@query(EDGES + "c AS (SELECT 'urn:k:world' AS type, 0 AS depth UNION ALL SELECT e.sub, c.depth + 1 FROM c JOIN e ON e.super = c.type) SELECT type, max(depth)::INT AS depth FROM c GROUP BY type")
def class_depth(spark, d):
    return closures.class_depth(closures.subclass_edges(onto(spark, d)))


# --- ontology and search --------------------------------------------------------------------


@query(f"WITH {OQ} SELECT s AS class, min(o) FILTER (p = '{RDFS_LABEL}') AS label FROM q WHERE s NOT LIKE 'urn:k:p%' GROUP BY s")
def extract_classes(spark, d):
    return X.extract_classes(onto(spark, d)).select("class", "label")


@query("SELECT 'urn:k:p' || p_partkey AS uri, 'OBJECT_PROPERTY' AS kind, 'urn:k:n' || p_size AS domain, 'urn:k:r' || (p_size % 5) AS ranges, p_name AS label FROM part")
def extract_properties(spark, d):
    return X.extract_properties(onto(spark, d)).select("uri", "kind", "domain", F.array_join("ranges", "|").alias("ranges"), "label")


@query(f"WITH {OQ} SELECT DISTINCT s AS sub, o AS super FROM q WHERE p = '{SUBCLASS_OF}'")
def extract_hierarchy(spark, d):
    return X.extract_hierarchy(onto(spark, d))


@query("WITH w AS (SELECT p_partkey, word, max(wt) AS wt FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, 3.0::DOUBLE AS wt FROM part "
       "UNION ALL SELECT p_partkey, lower(p_type), 1.0::DOUBLE FROM part) GROUP BY ALL) SELECT u.q AS query_id, 'urn:k:p' || p_partkey AS term, w.wt AS score "
       "FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS q FROM part) u JOIN w ON w.word = u.q")
def search_terms(spark, d):
    idx = Q.term_index(onto(spark, d))
    qs = spark.read.parquet(f"{d}/part.parquet").select(F.substring_index("p_name", " ", 1).alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    return Q.search_terms(idx, qs).select("query_id", "term", "score")


@query("SELECT n.n_nationkey AS query_id, 'urn:c:' || c.c_custkey AS iri, 0.9::DOUBLE AS score FROM nation n JOIN customer c ON c.c_custkey = n.n_nationkey UNION ALL SELECT n_nationkey, 'urn:s:' || s_suppkey, 0.9 FROM nation JOIN supplier ON s_suppkey = n_nationkey WHERE false")
def search_labels(spark, d):
    q = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("query_id"), F.format_string("%09d", F.col("n_nationkey")).alias("text"))
    hits = Q.search_labels(star(spark, d), q, types=["urn:t:Customer"])
    return hits.where("score >= 0.9").select("query_id", "iri", "score")



def _history(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'")
    return t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("question"),
                    F.lit(False).alias("edited"), F.lit(False).alias("decided"), F.lit(1).alias("use_count"),
                    F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("at"))


HIST = ("WITH h AS (SELECT conv_id || '-' || turn AS id, conv_id * 1000 + turn AS ts, " + WORDS.format("text") + " AS w FROM conversations WHERE role = 'user'), "
        "qs AS (SELECT item_id AS query_id, " + WORDS.format("text") + " AS w FROM benchmark), "
        "sm AS (SELECT query_id, id, round(len(list_intersect(h.w, qs.w))::DOUBLE / (len(h.w) + len(qs.w) - len(list_intersect(h.w, qs.w))) + 0.01 + CASE WHEN ts = (SELECT max(ts) FROM h) THEN 0.01 ELSE 0 END, 9) AS score FROM h, qs WHERE len(list_intersect(h.w, qs.w)) > 0) ")


@query(HIST + "SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sm) WHERE r <= 5")
def similar_questions(spark, d):
    q = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return Q.similar_questions(_history(spark, d), q, n=5).select("query_id", "id", F.round("score", 9).alias("score"))


@query("SELECT array_to_string(" + TOKENS.format("text") + ", ' ') AS words, count(*) AS use_count FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1")
def merge_history(spark, d):
    new = _history(spark, d).select("id", "question", F.lit("q").alias("query"), F.lit(None).cast("string").alias("generated"), "at")
    old = spark.createDataFrame([], "id string, question string, query string, edited boolean, use_count long, at timestamp")
    return Q.merge_history(old, new).select(F.array_join(T.tokens_of_normalized(T.normalize("question")), " ").alias("words"), "use_count")


# --- updates --------------------------------------------------------------------------------


@query(SQ + f"SELECT s, p, CASE WHEN p = '{P}segment' THEN 'x' ELSE o END AS o FROM q WHERE source = 'crm' UNION ALL SELECT DISTINCT s, 'http://purl.org/dc/terms/modified', '2026-01-01T00:00:00Z' FROM q WHERE source = 'crm'")
def replace_properties(spark, d):
    q = star(spark, d)
    ch = q.where(F.col("p") == P + "segment").select("s", "p", F.lit("x").alias("o"))
    return U.replace_properties(q, ch, "crm", "2026-01-01T00:00:00Z").where("source = 'crm'").select("s", "p", "o")


@query(SQ + "SELECT source, s, p, o FROM q WHERE NOT (source = 'geo' AND (s LIKE 'urn:r:%' OR o LIKE 'urn:r:%'))")
def delete_entities(spark, d):
    q = star(spark, d)
    return U.delete_entities(q, q.where(F.col("s").startswith("urn:r:")).select("s"), "geo")[0].select("source", "s", "p", "o")


@query(SQ + f"SELECT DISTINCT s FROM q WHERE p = '{P}balance' AND source = 'crm' AND o LIKE '-%'")
def touched_subjects(spark, d):
    q = star(spark, d)
    after = q.where(~((F.col("p") == P + "balance") & F.col("o").startswith("-")))
    return U.touched_subjects(q, after, "crm")


@query(SQ + "SELECT 'crm' AS source, count(*) + 2 * (SELECT count(*) FROM region) AS n FROM q WHERE source = 'crm'")
def create_entities(spark, d):
    new = spark.read.parquet(f"{d}/region.parquet").select(
        F.concat(F.lit("urn:new:"), "r_regionkey").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit("urn:t:Region").alias("o"), F.lit("iri").alias("o_kind"))
    out = U.create_entities(star(spark, d), new, "crm", "2026-01-01T00:00:00Z")
    return out.where("source = 'crm'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(SQ + f"SELECT DISTINCT s, 'http://purl.org/dc/terms/modified' AS p, '2026-01-01T00:00:00Z' AS o FROM q WHERE p = '{P}balance' AND source = 'crm' AND o LIKE '-%'")
def stamp_changes(spark, d):
    q = star(spark, d)
    after = q.where(~((F.col("p") == P + "balance") & F.col("o").startswith("-")))
    return U.stamp_changes(q, after, "crm", "2026-01-01T00:00:00Z").where(F.col("p").startswith("http://purl.org/dc/terms/")).select("s", "p", "o")


@query(SQ + "SELECT s, p, o, 'OUTSIDE_INTERNAL_SOURCE' AS violation FROM q WHERE source = 'erp'")
def check_writes(spark, d):
    q = star(spark, d)
    return U.check_writes(q.where("source in ('crm', 'erp')"), q, "crm")


@query(SQ + f"SELECT s FROM q WHERE p = '{P}balance' AND s NOT IN (SELECT s FROM q WHERE p = '{P}segment')")
def not_exists_pattern(spark, d):
    q = star(spark, d)
    return Pt.not_exists(Pt.pattern(q, "?s", P + "balance", "?b"), Pt.pattern(q, "?s", P + "segment", "?x")).select("s")


@query(SQ + f"SELECT DISTINCT s FROM q WHERE p = '{P}balance' AND s NOT IN (SELECT s FROM q WHERE p = '{P}segment')")
def drop_common_entities(spark, d):
    q = star(spark, d)
    a, _ = Pt.drop_common_entities(q.where(F.col("p") == P + "balance"), q.where(F.col("p") == P + "segment"), "s")
    return a.select("s").distinct()


@query("SELECT 'urn:t:Nation' AS type, count(*) AS n FROM nation UNION ALL SELECT 'urn:t:Supplier', count(*) FROM supplier")
def group_by_matched_type(spark, d):
    e = Pt.list_by_types(star(spark, d), ["urn:t:Nation", "urn:t:Supplier"])
    return A.group_by_matched_type(e).select("type", F.size("entities").cast("long").alias("n"))


@query("WITH " + LINKS_SQL + "SELECT CASE WHEN source_b = (SELECT max(source_b) FROM l) THEN 'removed' ELSE 'unchanged' END AS change, count(*) AS pairs FROM l GROUP BY ALL")
def proposal_diff(spark, d):
    lk = _copy_links(spark, d, "PROPOSED")
    gone = lk.agg(F.max("source_b")).first()[0]
    return M.proposal_diff(lk, lk.where(F.col("source_b") != gone))[0]


@query("SELECT 'urn:k:p' || p_partkey AS term, 'urn:k:n' || p_size AS domains, 'urn:k:r' || (p_size % 5) AS ranges, false AS functional FROM part")
def term_details(spark, d):
    t = Q.term_details(onto(spark, d))
    return t.select("term", F.array_join("domains", "|").alias("domains"), F.array_join("ranges", "|").alias("ranges"), "functional")


@query("WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part), o AS (SELECT min('urn:k:p' || p_partkey) AS iri, p_name FROM part GROUP BY p_name) SELECT p_name AS query_id, iri FROM o")
def resolve_terms(spark, d):
    q = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()
    used = spark.createDataFrame([], "iri string, n long")
    return Q.resolve_terms(q, used, onto(spark, d), ["OBJECT_PROPERTY"])


@query("WITH " + LINKS_SQL + "SELECT source_a, iri_a, source_b, iri_b FROM l WHERE source_a = 'src0' AND source_b <> (SELECT max(source_b) FROM l)")
def filter_links(spark, d):
    lk = _copy_links(spark, d, "PROPOSED")
    gone = lk.agg(F.max("source_b")).first()[0]
    fl = lk.select("id", (F.col("source_b") == gone).alias("superseded"), F.lit(False).alias("orphan_a"), F.lit(False).alias("orphan_b"))
    out = L.filter_links(lk.where("source_a = 'src0'"), fl, statuses=["PROPOSED"], min_score=0.5, q="URN:D:")
    return out.select("source_a", "iri_a", "source_b", "iri_b")
