"""Registered queries for operators and branches that the main list does not reach, with SQL twins."""

import uuid

from pyspark.sql import functions as F

from quadweave.functions import dates as D, iri as I, text as T
from quadweave.operators import clusters as C, closures, compare, links as L, ontology as X, patterns as Pt, profiles as Pr
from quadweave.operators import search as Q, stats as A, tabular, updates as U
from quadweave.plans import matching as M
from quadweave.plans.config import load_config
from quadweave.plans.datasets import ONTOLOGY, P, quads_of, quads_sql
from quadweave.plans.queries import (
    EDGES, HIST, LABELS, LINKS_SQL, NAME, ORACLES, PART_CONFIG, SQ, TOKENS, _copy_links, _history, _no_identical, _no_links, docs, onto, query, star,
)
from quadweave.runtime import cut_lineage, shared_folder
from quadweave.sources import tables as S
from quadweave.vocab import FOAF, OWL, RDF, RDF_TYPE, RDFS_LABEL, RICO, SUBCLASS_OF, XSD


def read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- identifiers and texts ------------------------------------------------------------------


@query("SELECT item_id, CASE WHEN s = '' THEN 'group' ELSE s END AS slug FROM (SELECT item_id, regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM benchmark)")
def slugs(spark, d):
    return read(spark, d, "benchmark").select("item_id", T.slug("text").alias("slug"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{FOAF}' || o_orderstatus WHEN 1 THEN 'urn:x:' || o_orderkey WHEN 2 THEN 'none:' || o_orderkey ELSE '{RICO}' || o_orderkey END AS iri FROM orders")
def expand_curies(spark, d):
    form = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(' foaf:', o_orderstatus) WHEN 1 THEN concat('urn:x:', o_orderkey) WHEN 2 THEN concat('none:', o_orderkey) ELSE concat('rico:', o_orderkey, ' ') END")
    return read(spark, d, "orders").select("o_orderkey", I.expand_curie(form).alias("iri"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'foaf:' || o_orderstatus WHEN 1 THEN 'http://x.example/' || o_orderkey ELSE '" + RICO + "a/' || o_orderkey END AS curie FROM orders")
def compact_iris(spark, d):
    form = F.expr(f"CASE o_orderkey % 3 WHEN 0 THEN concat('{FOAF}', o_orderstatus) WHEN 1 THEN concat('http://x.example/', o_orderkey) ELSE concat('{RICO}a/', o_orderkey) END")
    return read(spark, d, "orders").select("o_orderkey", I.compact_iri(form).alias("curie"))


@query("SELECT l_orderkey, l_linenumber, least(l_returnflag, l_linestatus) || '⇄' || greatest(l_returnflag, l_linestatus) AS pair_key, "
       "'urn:new/Line/' || sha256(l_orderkey || '-' || l_linenumber) AS minted FROM lineitem")
def pair_keys(spark, d):
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", I.source_pair_key("l_returnflag", "l_linestatus").alias("pair_key"), I.mint_iri(F.lit("urn:new"), F.lit("http://t.example/Line"), key).alias("minted"))


@query("SELECT conv_id, turn, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS line FROM conversations")
def collapsed_texts(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(T.collapse_ws("text")).alias("line"))


@query(SQ + "SELECT s, p, CASE WHEN o_kind = 'iri' THEN 'iri' ELSE 'literal:' || regexp_replace(o_datatype, '^.*[#/]', '') END AS kind, "
       "CASE WHEN o_datatype LIKE '%#string' THEN 'STRING' WHEN o_datatype LIKE '%#integer' THEN 'INTEGER' WHEN o_datatype LIKE '%#decimal' THEN 'DECIMAL' ELSE 'LITERAL' END AS category FROM q")
def value_kinds(spark, d):
    return star(spark, d).select("s", "p", I.value_kind().alias("kind"), I.datatype_category("o_datatype").alias("category"))


# --- numbers and dates ----------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::DOUBLE END AS number, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN abs(p_size - p_partkey % 50) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part")
def numbers(spark, d):
    n = D.parse_number(F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(' ', p_size, ' ') END"))
    return read(spark, d, "part").select("p_partkey", n.alias("number"), compare.cmp_number(n, (F.col("p_partkey") % 50).cast("double"), 5.0).alias("score"))


# The given timestamps in every form that a partial date may take.
FORMS = "CASE o_orderkey % 7 WHEN 0 THEN {y} WHEN 1 THEN {m} WHEN 2 THEN {d} WHEN 3 THEN {d} || 'T10:00:00Z' WHEN 4 THEN {y} || '/' || {d2} WHEN 5 THEN {d2} || '/' || {y0} ELSE 'about ' || {y} END"
DAYS_SQL = ("x AS (SELECT o_orderkey, o_orderdate::DATE AS day, year(o_orderdate)::BIGINT AS y, o_orderkey % 7 AS f FROM orders), "
            "i AS (SELECT *, CASE WHEN f IN (0, 4) THEN make_date(y, 1, 1) WHEN f = 1 THEN date_trunc('month', day)::DATE WHEN f IN (2, 3) THEN day END AS a, "
            "CASE WHEN f = 0 THEN make_date(y, 12, 31) WHEN f = 1 THEN last_day(day) WHEN f IN (2, 3) THEN day WHEN f = 4 THEN make_date(y + 1, 1, 1) END AS b FROM x) ")


def _any_date(t):
    form = FORMS.format(y="cast(year(o_orderdate) as string)", m="date_format(o_orderdate, 'yyyy-MM')", d="date_format(o_orderdate, 'yyyy-MM-dd')",
                        d2="concat(year(o_orderdate) + 1, '-01-01')", y0="cast(year(o_orderdate) - 1 as string)")
    return t.select("o_orderkey", "o_orderdate", D.parse_partial_date(F.expr(form)).alias("i"))


@query("WITH " + DAYS_SQL + "SELECT o_orderkey, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day, CASE WHEN a IS NOT NULL THEN f IN (2, 3) END AS day_precise FROM i")
def date_forms(spark, d):
    return _any_date(read(spark, d, "orders")).select(
        "o_orderkey", F.col("i.start").cast("string").alias("first_day"), F.col("i.end").cast("string").alias("last_day"), F.col("i.day_precise").alias("day_precise"))


@query("WITH " + DAYS_SQL + "SELECT o_orderkey, CASE WHEN a IS NULL THEN NULL ELSE a <= day + 20 AND day + 20 <= b END AS overlaps, "
       "CASE WHEN a IS NULL THEN NULL WHEN NOT (a <= day + 20 AND day + 20 <= b) THEN 0.0::DOUBLE WHEN f IN (2, 3) AND a = day + 20 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS score, "
       "CASE WHEN a IS NULL THEN NULL WHEN f IN (2, 3) THEN 1.0::DOUBLE WHEN a <= day AND day <= b THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS own FROM i")
def date_scores(spark, d):
    t = _any_date(read(spark, d, "orders"))
    later, same = (D.parse_partial_date(F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")) for n in (20, 0))
    t = t.withColumn("later", later).withColumn("same", same)
    i, j, k = F.col("i"), F.col("later"), F.col("same")
    return t.select("o_orderkey", D.interval_overlaps(i, j).alias("overlaps"), compare.cmp_date(i, j).alias("score"), compare.cmp_date(i, k).alias("own"))


# --- letters: ratios of the longest common subsequence --------------------------------------

# One row of the table per letter of the first text; row cells depend on their left neighbour, so both
# levels are folds over lists.
LCS = ("list_reduce(list_prepend([0 for _ in range(len({b}) + 1)], list_transform(string_split({a}, ''), lambda x: [ascii(x)])), lambda row, x: "
       "list_transform(list_reduce(list_prepend([0, 0], list_transform(range(1, len({b}) + 1), lambda j: [j, x[1]])), lambda acc, t: "
       "list_append(acc, CASE WHEN ascii({b}[t[1]]) = t[2] THEN row[t[1]] + 1 ELSE greatest(row[t[1] + 1], acc[len(acc)]) END))[2:], lambda v: v))[len({b}) + 1]")
# Names at a rounded ratio of 100, nations by equality, both counting the same.
ORACLES["match_tables"] = (
    "WITH s AS (SELECT 's' || s_suppkey AS e, lower(s_name) AS n, s_nationkey AS k FROM supplier), d AS (SELECT DISTINCT n FROM s), "
    "m AS (SELECT a.n AS x, b.n AS y, len(a.n) + len(b.n) AS t, " + LCS.format(a="a.n", b="b.n") + " AS c FROM d a, d b), "
    "r AS (SELECT p.e AS source_entity, q.e AS target_entity, (round((1.0::DOUBLE - (t - 2 * c)::DOUBLE / t) * 100) + CASE WHEN p.k = q.k THEN 100.0 ELSE 0.0 END)::DOUBLE / 2 AS score "
    "FROM s p JOIN m ON p.n = x JOIN s q ON q.n = y) SELECT * FROM r WHERE score >= 95")
SORTED = "array_to_string(list_sort(" + TOKENS + "), ' ')"
PLAIN = "array_to_string(" + TOKENS + ", ' ')"


@query("WITH n AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS k FROM part), w AS (SELECT a.p_name AS x, b.p_name AS y, " + PLAIN.format("a.p_name") + " AS nx, " + PLAIN.format("b.p_name") + " AS ny, "
       + SORTED.format("a.p_name") + " AS sx, " + SORTED.format("b.p_name") + " AS sy FROM n a JOIN n b ON a.k = b.k) SELECT x, y, round(greatest(2.0 * " + LCS.format(a="nx", b="ny") + " / (len(nx) + len(ny)), 2.0 * " + LCS.format(a="sx", b="sy") + " / (len(sx) + len(sy))), 9) AS score FROM w")
def name_similarity(spark, d):
    n = read(spark, d, "part").select("p_name").distinct().withColumn("k", F.substring_index("p_name", " ", 1))
    m = n.select("k", F.col("p_name").alias("x")).join(n.select("k", F.col("p_name").alias("y")), "k")
    return m.select("x", "y", F.round(compare.cmp_name(F.col("x"), F.col("y")), 9).alias("score"))


# --- hierarchies, patterns, labels ----------------------------------------------------------


@query(EDGES + "c AS (SELECT sub AS type, super AS ancestor FROM e UNION SELECT c.type, e.super FROM c JOIN e ON e.sub = c.ancestor) SELECT type, ancestor FROM c UNION SELECT sub, sub FROM e UNION SELECT super, super FROM e")
def superclass_closure(spark, d):
    return closures.superclass_closure(closures.subclass_edges(onto(spark, d)))


GROUPS = {"equivalentGroups": [
    {"id": "world", "groupLabel": "World", "equivalentTypes": ["urn:k:world"], "properties": {"n": [NAME]}},
    {"id": "one", "groupLabel": "One", "equivalentTypes": ["urn:k:r1"], "properties": {"n": [NAME]}},
    {"id": "two", "groupLabel": "Two", "equivalentTypes": ["urn:k:r2"], "properties": {"n": [NAME]}}]}


@query(EDGES + "c AS (SELECT super AS root, sub AS type FROM e UNION SELECT c.root, e.sub FROM c JOIN e ON e.super = c.type), m AS (SELECT root, type FROM c WHERE root IN ('urn:k:world', 'urn:k:r1', 'urn:k:r2') "
       "UNION SELECT r, r FROM (VALUES ('urn:k:world'), ('urn:k:r1'), ('urn:k:r2')) v(r)) SELECT type, string_agg(root, '|' ORDER BY root) AS groups, coalesce(max(CASE WHEN root <> 'urn:k:world' THEN root END), 'urn:k:world') AS narrowest FROM m GROUP BY type")
def type_groups(spark, d):
    """Every class of the ontology as an entity of its own type: its groups, and the most specific one."""
    cfg, edges = load_config(GROUPS), closures.subclass_edges(onto(spark, d))
    ex = closures.expanded_groups(spark, cfg, edges)
    roots = F.create_map(*[F.lit(x) for i, g in enumerate(cfg.groups) for x in (i, g.types[0])])
    names = ex.select("rank", roots[F.col("group_order")].alias("root")).distinct().collect()  # one row per group
    by_rank = F.create_map(*[F.lit(x) for r in names for x in (r["rank"], r["root"])])
    typed = ex.select(F.lit("s").alias("source"), F.col("type").alias("iri"), "type").distinct()
    g = closures.groups_of(typed, ex)
    named = lambda c: F.array_join(F.array_sort(F.transform(c, lambda r: by_rank[r])), "|")
    return g.select(F.col("iri").alias("type"), named("groups").alias("groups"), named("primary").alias("narrowest"))


@query(SQ + f"SELECT source, s, min(CASE p WHEN '{NAME}' THEN '0' WHEN '{RDFS_LABEL}' THEN '1' ELSE '2' END || o)[2:] AS label FROM q WHERE p IN ('{NAME}', '{RDFS_LABEL}', '{FOAF}name') GROUP BY source, s")
def profile_labels(spark, d):
    return Pt.profile_label(star(spark, d))


@query(SQ + "SELECT DISTINCT s, p, o FROM q WHERE source IN ('crm', 'erp')")
def union_graphs(spark, d):
    q = star(spark, d)
    return Pt.union_graphs(q.where("source = 'crm'"), q.where("source in ('crm', 'erp')")).select("s", "p", "o").distinct()


@query("SELECT 'urn:n:' || n_nationkey AS s FROM nation")
def resources_of_type(spark, d):
    return A.resources_of_type(star(spark, d), "urn:t:Nation").select("s")


@query("SELECT 'urn:k:n' || n_nationkey AS class, n_name AS label_en FROM nation UNION ALL SELECT 'urn:k:r' || r_regionkey, r_name FROM region UNION ALL SELECT 'urn:k:c' || c_custkey, c_name FROM customer")
def ontology_labels(spark, d):
    return A.ontology_classes_labelled(onto(spark, d), [OWL + "Class"]).select("class", "label_en")


# --- links ----------------------------------------------------------------------------------


@query("WITH " + LINKS_SQL + "SELECT n.source, n.iri, m.source AS member_source, m.iri AS member_iri FROM n JOIN n m USING (c)")
def cluster_members(spark, d):
    c = C.build_clusters(_copy_links(spark, d), _no_identical(spark))
    return C.cluster_of(c.select("source", "iri"), c)


@query("WITH " + LINKS_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY source_a, iri_a, source_b ORDER BY iri_b) AS r FROM l) SELECT source_a, iri_a, source_b, iri_b, CASE WHEN r = 1 THEN 'ACCEPTED' ELSE 'PROPOSED' END AS status, "
       "CASE WHEN r > 1 THEN 'TWO_IN_SOURCE' END AS reason FROM k")
def accepted_and_refused(spark, d):
    """Proposals to copies accepted in order: what became of each, with the reason of a refusal."""
    lk = cut_lineage(_copy_links(spark, d, "PROPOSED"))
    dec = lk.select(F.struct("source_a", "iri_a", "source_b", "iri_b").alias("ord"), "id", F.lit("ACCEPT").alias("action"))
    out = L.apply_decisions(lk, dec, _no_identical(spark))
    return out.links.join(out.report.select("id", "reason"), "id").select("source_a", "iri_a", "source_b", "iri_b", "status", "reason")


# The first proposal from a hub to each source is the one that can be confirmed.
RANKED_SQL = LINKS_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY source_a, iri_a, source_b ORDER BY {}) AS r FROM l) "
_LINK_ID_SQL = "sha256(least(source_a || chr(1) || iri_a, source_b || chr(1) || iri_b) || chr(2) || greatest(source_a || chr(1) || iri_a, source_b || chr(1) || iri_b))"


def _in_order(lk):
    return lk.select(F.struct("source_a", "iri_a", "source_b", "iri_b").alias("ord"), "id", F.lit("ACCEPT").alias("action"))


@query("WITH " + RANKED_SQL.format(_LINK_ID_SQL) + "SELECT source_a, iri_a, source_b, iri_b, CASE WHEN r = 1 THEN 'ACCEPTED' ELSE 'PROPOSED' END AS status FROM k")
def accepted_in_bulk(spark, d):
    """Every proposal above a score accepted, best first and by id among equals."""
    out = L.accept_above(cut_lineage(_copy_links(spark, d, "PROPOSED")), _no_identical(spark), 0.95)
    return out.links.select("source_a", "iri_a", "source_b", "iri_b", "status")


@query("WITH " + RANKED_SQL.format("iri_b") + "SELECT 'changed' AS kind, source_a, iri_a, source_b, iri_b FROM k WHERE r = 1 UNION ALL "
       "SELECT 'added', a.source_b, a.iri_b, b.source_b, b.iri_b FROM k a JOIN k b USING (source_a, iri_a) WHERE a.r = 1 AND b.r = 1 AND a.source_b < b.source_b")
def dry_run_of_acceptance(spark, d):
    """What accepting all proposals in order would change, and the links inferred from it."""
    lk, none = cut_lineage(_copy_links(spark, d, "PROPOSED")), _no_identical(spark)
    out = L.dry_run(lk, lambda x: L.apply_decisions(x, _in_order(lk), none), none)
    rows = [out[name].select(F.lit(kind).alias("kind"), "source_a", "iri_a", "source_b", "iri_b") for name, kind in (("changed", "changed"), ("inferred_added", "added"))]
    return rows[0].unionByName(rows[1])


@query("WITH " + RANKED_SQL.format("iri_b") + ", o AS (SELECT max(source_b) AS gone FROM l) SELECT source_a, iri_a, source_b, iri_b, r > 1 AS superseded, "
       "source_a = gone AS orphan_a, source_b = gone AS orphan_b FROM k, o")
def flagged_links(spark, d):
    """Flags of links after acceptance in order, with the quads of one source missing."""
    lk, none = cut_lineage(_copy_links(spark, d, "PROPOSED")), _no_identical(spark)
    out = L.apply_decisions(lk, _in_order(lk), none)
    gone = lk.agg(F.max("source_b")).first()[0]
    flags = L.link_flags(out.links, out.clusters, docs(spark, d).where(F.col("source") != gone))
    return out.links.join(flags, "id").select("source_a", "iri_a", "source_b", "iri_b", "superseded", "orphan_a", "orphan_b")


@query("WITH " + RANKED_SQL.format("iri_b") + "SELECT source_a, iri_a, source_b, iri_b, CASE WHEN r = 1 THEN 'applied' ELSE 'refused' END AS result, CASE WHEN r > 1 THEN 'TWO_IN_SOURCE' END AS reason FROM k "
       "UNION ALL SELECT source_a, iri_a, source_b, iri_b || '#', 'refused', 'NO_STATEMENT' FROM k UNION ALL SELECT source_a, iri_a, source_a, iri_b, 'refused', 'SAME_SOURCE' FROM k")
def manual_requests(spark, d):
    """Links asked for by hand from an empty table: to copies, to entities that are not there, within a source."""
    lk = cut_lineage(_copy_links(spark, d))
    ends = ["source_a", "iri_a", "source_b", "iri_b"]
    asked = lk.select(*ends).unionByName(lk.select("source_a", "iri_a", "source_b", F.concat("iri_b", F.lit("#")).alias("iri_b")))
    asked = asked.unionByName(lk.select("source_a", "iri_a", F.col("source_a").alias("source_b"), "iri_b"))
    # Ends come in either order.
    turned = asked.select(F.struct(*ends).alias("ord"), F.col("source_b").alias("source_a"), F.col("iri_b").alias("iri_a"), F.col("source_a").alias("source_b"), F.col("iri_a").alias("iri_b"))
    out = L.add_manual_links(lk.limit(0), turned, docs(spark, d), _no_identical(spark))
    return out.report.select(*[F.col(f"ord.{c}").alias(c) for c in ends], "result", "reason")


@query("WITH " + LINKS_SQL + "SELECT source_a, iri_a, source_b, iri_b, CASE WHEN hash_even THEN 'REJECTED' ELSE 'PROPOSED' END AS status FROM (SELECT *, iri_b[-1] IN ('0', '2', '4', '6', '8') AS hash_even FROM l)")
def reject_and_undo(spark, d):
    """Accepted links: those to even ids rejected, the others taken back."""
    lk = cut_lineage(_copy_links(spark, d))
    even = F.substring("iri_b", -1, 1).isin("0", "2", "4", "6", "8")
    order = F.struct("source_a", "iri_a", "source_b", "iri_b").alias("ord")
    dec = lk.select(order, "id", F.when(even, "REJECT").otherwise("UNDO").alias("action"))
    return L.apply_decisions(lk, dec, _no_identical(spark)).links.select("source_a", "iri_a", "source_b", "iri_b", "status")


@query("WITH " + LINKS_SQL + ", o AS (SELECT max(source_b) AS gone FROM l) SELECT source_a, iri_a, source_b, iri_b FROM l, o WHERE source_b <> gone AND source_a <> gone")
def remove_orphans(spark, d):
    lk = _copy_links(spark, d)
    gone = lk.agg(F.max("source_b")).first()[0]
    left, _, _ = L.remove_orphans(lk, docs(spark, d).where(F.col("source") != gone))
    return left.select("source_a", "iri_a", "source_b", "iri_b")


@query("WITH " + LINKS_SQL + "SELECT source_a, iri_a, source_b, iri_b, CASE WHEN source_a < 'src5' THEN 'seen ' || iri_b END AS note FROM l")
def annotate_links(spark, d):
    lk = _copy_links(spark, d)
    notes = lk.select("id", F.when(F.col("source_a") < "src5", F.concat(F.lit(" seen "), "iri_b")).otherwise("  ").alias("note"))
    return L.annotate(lk, notes).select("source_a", "iri_a", "source_b", "iri_b", "note")


@query("WITH " + LINKS_SQL + "SELECT source_a, iri_a, source_b, iri_b, 'urn:t:Document' AS types_a FROM l")
def filled_snapshots(spark, d):
    out = L.fill_snapshots(_copy_links(spark, d), docs(spark, d))
    return out.select("source_a", "iri_a", "source_b", "iri_b", F.array_join("types_a", "|").alias("types_a"))


# --- updates, files -------------------------------------------------------------------------


@query(SQ + f"SELECT s, p, o FROM q WHERE source = 'crm' UNION ALL SELECT DISTINCT s, '{P}note', 'checked' FROM q WHERE source = 'crm' AND p = '{P}segment' AND o = 'BUILDING' "
       f"UNION ALL SELECT DISTINCT s, 'http://purl.org/dc/terms/modified', '2026-01-01T00:00:00Z' FROM q WHERE source = 'crm' AND p = '{P}segment' AND o = 'BUILDING'")
def add_values(spark, d):
    q = star(spark, d)
    ch = q.where((F.col("p") == P + "segment") & (F.col("o") == "BUILDING")).select("s", F.lit(P + "note").alias("p"), F.lit("checked").alias("o"))
    return U.add_values(q, ch, "crm", "2026-01-01T00:00:00Z").where("source = 'crm'").select("s", "p", "o")


@query(f"SELECT 'urn:part:' || p_partkey AS s, '{P}text' AS p, 'a\"b\\c' || chr(9) || p_name || chr(10) || 'é' AS o, CASE WHEN p_partkey % 2 = 0 THEN 'fr' END AS o_lang FROM part")
def nquads_round_trip(spark, d):
    """Texts with every kind of escape written as lines and read back."""
    none = F.lit(None).cast("string")
    q = read(spark, d, "part").select(
        F.lit("x").alias("source"), F.lit("urn:datasource:x").alias("graph"), F.lit("data").alias("graph_kind"), F.concat(F.lit("urn:part:"), "p_partkey").alias("s"), F.lit("iri").alias("s_kind"),
        F.lit(P + "text").alias("p"), F.concat(F.lit('a"b\\c\t'), "p_name", F.lit("\né")).alias("o"), F.lit("literal").alias("o_kind"),
        F.when(F.col("p_partkey") % 2 != 0, F.lit(XSD + "string")).alias("o_datatype"), F.when(F.col("p_partkey") % 2 == 0, F.lit("fr")).otherwise(none).alias("o_lang"))
    path = f"{shared_folder(spark).rstrip('/')}/quadweave/lines-{uuid.uuid4().hex}"
    S.export_triples(q, "x", path)
    return S.read_nquads(spark, path, "x").select("s", "p", "o", "o_lang")


@query(f"SELECT 'urn:part:' || p_partkey AS s, CASE WHEN k = 1 THEN '{RDF_TYPE}' ELSE 'urn:size' END AS p, CASE WHEN k = 1 THEN 'urn:t:Part' ELSE p_size::VARCHAR END AS o, CASE WHEN k = 2 THEN '{XSD}integer' END AS o_datatype FROM part, (VALUES (1), (2)) v(k)")
def csv_round_trip(spark, d):
    rows = read(spark, d, "part").selectExpr("concat(' urn:part:', p_partkey) as entity", "stack(2, 'rdf:type', 'urn:t:Part', 'iri', 'urn:size', cast(p_size as string), 'number') as (property, value, typevalue)")
    path = f"{shared_folder(spark).rstrip('/')}/quadweave/csv-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True)
    return S.csv_to_quads(S.read_entity_csv(spark, path), "x")[0].select("s", "p", "o", "o_datatype")


# --- files of quads and links ---------------------------------------------------------------


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/quadweave/{name}-{uuid.uuid4().hex}"


@query("SELECT 'line ' || p_partkey || ' is no statement' AS line FROM part WHERE p_partkey % 10 = 0")
def import_warnings(spark, d):
    """Statements of which every tenth is malformed: the malformed lines, all of them."""
    path = _folder(spark, "report")
    read(spark, d, "part").select(F.expr("CASE WHEN p_partkey % 10 = 0 THEN concat('line ', p_partkey, ' is no statement') ELSE concat('<urn:p:', p_partkey, '> <urn:n> \"', p_name, '\" .') END").alias("value")).write.text(path)
    return S.import_report(S.stage_nquads(spark, path))[1]


@query(SQ + "SELECT source, s, p, o FROM q WHERE source IN ('crm', 'geo')")
def restored_quads(spark, d):
    path = _folder(spark, "graphs")
    S.export_quads(star(spark, d), ["urn:datasource:crm", "urn:datasource:geo"], path)
    return S.restore_quads(spark, path).select("source", "s", "p", "o")


@query("WITH " + LINKS_SQL + "SELECT source_a, iri_a, source_b, iri_b FROM l WHERE source_a <> 'src0'")
def reloaded_links(spark, d):
    """Links saved and loaded; those without a status are dropped."""
    path = _folder(spark, "links")
    S.save_links(_copy_links(spark, d).withColumn("status", F.when(F.col("source_a") != "src0", F.col("status"))), path)
    return S.load_links(spark, path).select("source_a", "iri_a", "source_b", "iri_b")


@query("WITH " + LINKS_SQL + "SELECT DISTINCT a.iri AS s, b.iri AS o FROM n a JOIN n b USING (c) WHERE a.iri <> b.iri")
def same_as_graph(spark, d):
    c = C.build_clusters(_copy_links(spark, d), _no_identical(spark))
    return S.write_same_as(docs(spark, d), c).where("graph_kind = 'matching'").select("s", "o")


@query("SELECT DISTINCT s, p, o FROM (" + quads_sql(ONTOLOGY) + ")")
def ontology_loaded_once(spark, d):
    once = S.load_ontology_once(star(spark, d), onto(spark, d))
    return S.load_ontology_once(once, onto(spark, d).limit(5)).where("graph_kind = 'ontology'").select("s", "p", "o")


@query("WITH n AS (SELECT DISTINCT regexp_extract(url, '^(.*[#/])', 1) AS namespace FROM pages) SELECT namespace, 'ns' || row_number() OVER (ORDER BY namespace) AS prefix FROM n UNION ALL SELECT '" + FOAF + "', 'foaf'")
def namespace_prefixes(spark, d):
    n = read(spark, d, "pages").select(I.namespace_of("url").alias("namespace"))
    return I.prefixes_for(n.unionByName(n.limit(1).select(F.lit(FOAF).alias("namespace"))))


# --- ontology details -----------------------------------------------------------------------

INVERSES = [("part", "ontology", "''", "concat('urn:k:p', p_partkey)", [(OWL + "inverseOf", "concat('urn:k:q', p_size)", "iri", None)])]
RESTRICTIONS = [
    ("nation", "ontology", "''", "concat('urn:r:', n_nationkey)", [
        (RDF_TYPE, f"'{OWL}Restriction'", "iri", None), (OWL + "onProperty", "'urn:prop'", "iri", None),
        (OWL + "minCardinality", "'1'", "literal", "integer"), (OWL + "maxCardinality", "cast(n_regionkey + 1 as string)", "literal", "integer")]),
    ("nation", "ontology", "''", "concat('urn:k:n', n_nationkey)", [(SUBCLASS_OF, "concat('urn:r:', n_nationkey)", "iri", None)]),
]
# Every part's list runs from its own cell to the end of its block of fifty.
LISTS = [
    ("part", "ontology", "''", "concat('urn:cell:', p_partkey)", [
        (RDF + "first", "concat('urn:m:', p_partkey)", "iri", None),
        (RDF + "rest", f"CASE WHEN p_partkey % 50 = 49 THEN '{RDF}nil' ELSE concat('urn:cell:', p_partkey + 1) END", "iri", None)]),
    ("part", "ontology", "''", "concat('urn:u:', p_partkey)", [(OWL + "unionOf", "concat('urn:cell:', p_partkey)", "iri", None)]),
]


@query("SELECT DISTINCT 'urn:k:p' || p_partkey AS property, 'urn:k:q' || p_size AS inverse FROM part UNION SELECT DISTINCT 'urn:k:q' || p_size, 'urn:k:p' || p_partkey FROM part")
def inverse_properties(spark, d):
    return X.inverse_properties(quads_of(spark, d, INVERSES))


@query("SELECT 'urn:prop' AS property, 'urn:k:n' || n_nationkey AS class, 1 AS min, (n_regionkey + 1)::INT AS max FROM nation")
def restrictions(spark, d):
    return X.extract_restrictions(quads_of(spark, d, RESTRICTIONS)).select("property", "class", "min", "max")


@query("SELECT 'urn:u:' || a.p_partkey AS node, (b.p_partkey - a.p_partkey)::INT AS pos, 'urn:m:' || b.p_partkey AS member FROM part a JOIN part b ON b.p_partkey >= a.p_partkey AND b.p_partkey // 50 = a.p_partkey // 50")
def flattened_lists(spark, d):
    return X.flatten_lists(quads_of(spark, d, LISTS)).select("node", F.col("pos")[0].alias("pos"), "member")


# --- linked dates, names, texts -------------------------------------------------------------

SPANS = [("orders", "data", "'o'", "concat('urn:o:', o_orderkey)", [
    (RICO + "beginningDate", "cast(cast(o_orderdate as date) as string)", "literal", "date"), (RICO + "endDate", "cast(cast(o_orderdate as date) + 10 as string)", "literal", "date")])]


@query("SELECT 'urn:o:' || o_orderkey AS iri, CAST(o_orderdate::DATE AS VARCHAR) AS first_day, CAST(o_orderdate::DATE + 10 AS VARCHAR) AS last_day FROM orders")
def linked_dates(spark, d):
    t = Pr.linked_date(quads_of(spark, d, SPANS))
    return t.select("iri", F.col("date.start").cast("string").alias("first_day"), F.col("date.end").cast("string").alias("last_day"))


@query("SELECT n_nationkey AS text_id, 'urn:n:' || n_nationkey AS iri, n_name AS label FROM nation UNION ALL SELECT n_nationkey, 'urn:gone:' || n_regionkey, 'urn:gone:' || n_regionkey FROM nation")
def entities_in_text(spark, d):
    t = read(spark, d, "nation").select(F.col("n_nationkey").alias("text_id"), F.expr("concat('see <urn:n:', n_nationkey, '> or <urn:gone:', n_regionkey, '> of <urn:t:Nation>, <urn:n:', n_nationkey, '>')").alias("text"))
    return Q.entities_in_text(t, star(spark, d), ["urn:t:"])


NAMES_SQL = "n AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS k, " + TOKENS.format("p_name") + " AS w FROM part), "
SIMILAR = "1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))"


@query("WITH " + NAMES_SQL + "p AS (SELECT a.p_name AS x, b.p_name AS y, a.w AS aw, b.w AS bw FROM n a JOIN n b ON a.k = b.k) SELECT x, y, aw = bw OR (len(aw) = len(bw) AND len(aw) > 0 AND len(list_filter(list_zip(aw, bw), lambda z: "
       + SIMILAR.format(a="z[1]", b="z[2]") + " < 0.75)) = 0) AS same FROM p")
def same_names(spark, d):
    n = read(spark, d, "part").select("p_name").distinct().withColumn("k", F.substring_index("p_name", " ", 1)).withColumn("w", T.tokens("p_name"))
    m = n.select("k", F.col("p_name").alias("x"), F.col("w").alias("aw")).join(n.select("k", F.col("p_name").alias("y"), F.col("w").alias("bw")), "k")
    return m.select("x", "y", T.same_name(F.col("aw"), F.col("bw")).alias("same"))


@query(SQ + ", lb AS (SELECT DISTINCT s, o, " + TOKENS.format("o") + f" AS lw FROM q WHERE p IN ({LABELS})), "
       "qs AS (SELECT n_nationkey AS query_id, list_distinct(" + TOKENS.format("n_name") + ") AS qd, " + TOKENS.format("n_name") + " AS qw FROM nation), "
       "raw AS (SELECT query_id, s, CASE WHEN qw = lw THEN 1.0 WHEN len(list_filter(qd, lambda w: NOT list_contains(lw, w))) = 0 THEN 0.9 ELSE "
       "0.85 * list_sum(list_transform(qd, lambda a: list_max(list_transform(lw, lambda b: " + SIMILAR.format(a="a", b="b") + ")))) / len(qd) END AS r FROM qs, lb WHERE len(qd) > 0 AND len(lw) > 0), "
       "h AS (SELECT query_id, s, floor(max(r) * 100 + 0.5) / 100 AS sc FROM raw WHERE r >= 0.75 GROUP BY query_id, s), "
       "a AS (SELECT query_id, count(*) AS n, count(*) FILTER (sc >= 0.9) AS st, string_agg(s, '|' ORDER BY sc DESC, s) AS c, min_by(s, (-sc, s)) AS b FROM h GROUP BY query_id) "
       "SELECT qs.query_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 OR st = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 OR st = 1 THEN b END AS iri, CASE WHEN NOT (n = 1 OR st = 1) THEN c END AS candidates FROM qs LEFT JOIN a USING (query_id)")
def resolve_names(spark, d):
    q = read(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("text"))
    return Q.resolve_names(star(spark, d), q).select("query_id", "status", "iri", F.array_join("candidates", "|").alias("candidates"))


def _by_kind(q):
    """Quads whose source is the kind of their subject.

    A kind has a row per part: its files are small, what a broadcast makes of them is not.
    """
    kind = q.where(F.col("p") == P + "kind").select("s", F.col("o").alias("k"))
    return q.join(kind.hint("merge"), "s").withColumn("source", F.col("k")).drop("k")


@query("WITH " + NAMES_SQL + "c AS (SELECT a.p_name AS x, b.p_name AS y FROM n a JOIN n b ON len(list_intersect(list_concat(a.w, list_transform(list_filter(a.w, lambda t: len(t) >= 4), lambda t: 'p:' || t[1:4])), list_concat(b.w, list_transform(list_filter(b.w, lambda t: len(t) >= 4), lambda t: 'p:' || t[1:4])))) > 0), "
       "w AS (SELECT x, y, " + PLAIN.format("x") + " AS nx, " + PLAIN.format("y") + " AS ny, " + SORTED.format("x") + " AS sx, " + SORTED.format("y") + " AS sy FROM c), "
       "sc AS (SELECT x, y, floor(greatest(2.0 * " + LCS.format(a="nx", b="ny") + " / (len(nx) + len(ny)), 2.0 * " + LCS.format(a="sx", b="sy") + " / (len(sx) + len(sy)))::DOUBLE * 10000 + 0.5) / 10000.0 AS score FROM w), "
       "e AS (SELECT p_type AS source, 'urn:part:' || p_partkey AS iri, p_name FROM part), "
       "p AS (SELECT a.source AS source_a, a.iri AS iri_a, b.source AS source_b, b.iri AS iri_b, score FROM e a JOIN sc ON sc.x = a.p_name JOIN e b ON b.p_name = sc.y AND a.source < b.source WHERE score >= 0.75), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY source_a, iri_a, source_b ORDER BY score DESC, iri_b) AS ra, row_number() OVER (PARTITION BY source_b, iri_b, source_a ORDER BY score DESC, iri_a) AS rb FROM p) "
       "SELECT source_a, iri_a, source_b, iri_b, score FROM r WHERE ra <= 2 OR rb <= 2")
def match_names(spark, d):
    """Parts of each kind, as one source per kind, matched by name."""
    q = star(spark, d).where("source = 'catalog'")
    run = M.run_all_pairs(_by_kind(q), _no_links(spark), load_config(PART_CONFIG))
    return run.proposals.select("source_a", "iri_a", "source_b", "iri_b", "score")


# --- whole groups, linked entities ----------------------------------------------------------

NEIGHBOUR_CONFIG = {
    "defaults": {"maxProposalsPerEntity": 2},
    "equivalentGroups": [{
        "id": "partner", "groupLabel": "Partner", "equivalentTypes": ["urn:t:Customer", "urn:t:Supplier"], "candidates": "all", "requiredConcepts": ["nation"],
        "properties": {"nation": {"predicates": [P + "nation"], "comparator": "linkedEntity", "weight": 3, "blocking": True}}}],
}


@query("WITH t AS (SELECT n_nationkey AS k, " + PLAIN.format("n_name") + " AS n, " + SORTED.format("n_name") + " AS s FROM nation), "
       "m AS (SELECT a.k AS ka, b.k AS kb, CASE WHEN a.k = b.k THEN 1.0::DOUBLE ELSE floor(0.9::DOUBLE * greatest(2.0 * " + LCS.format(a="a.n", b="b.n") + " / (len(a.n) + len(b.n)), 2.0 * " + LCS.format(a="a.s", b="b.s") + " / (len(a.s) + len(b.s))) * 10000 + 0.5) / 10000.0 END AS score FROM t a, t b), "
       "p AS (SELECT 'urn:c:' || c_custkey AS iri_a, 'urn:s:' || s_suppkey AS iri_b, score FROM customer JOIN m ON ka = c_nationkey JOIN supplier ON kb = s_nationkey WHERE score >= 0.75), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY iri_a ORDER BY score DESC, iri_b) AS ra, row_number() OVER (PARTITION BY iri_b ORDER BY score DESC, iri_a) AS rb FROM p) SELECT iri_a, iri_b, score FROM r WHERE ra <= 2 OR rb <= 2")
def match_neighbours(spark, d):
    """Customers and suppliers by the nation they are linked to: a group compared whole."""
    run = M.run_matching(star(spark, d), _no_links(spark), load_config(NEIGHBOUR_CONFIG), "crm", "erp")
    return run.proposals.select("iri_a", "iri_b", "score")


@query("WITH s AS (SELECT DISTINCT source, source <> 'src1' AS known, make_timestamp(2026, 1, 1 + length(source), 0, 0, 0.0) AS change FROM documents), p AS (SELECT a.source AS source_a, b.source AS source_b, a.known AND b.known AS ok, greatest(a.change, b.change) AS change FROM s a JOIN s b ON a.source < b.source) "
       "SELECT source_a, source_b, CASE WHEN NOT ok THEN '' WHEN source_a = 'src0' THEN 'neverRun' ELSE concat_ws('|', CASE WHEN change > make_timestamp(2026, 1, 5, 12, 0, 0.0) THEN 'dataChanged' END, CASE WHEN source_b < 'src4' THEN 'configurationChanged' END, 'decisionsRevoked') END AS stale FROM p")
def stale_runs(spark, d):
    s = read(spark, d, "documents").select(F.col("source").alias("short_name")).distinct().withColumn("last_change", F.make_timestamp(F.lit(2026), F.lit(1), F.char_length("short_name") + 1, F.lit(0), F.lit(0), F.lit(0)))
    pairs = s.select(F.col("short_name").alias("source_a")).join(s.select(F.col("short_name").alias("source_b")), F.col("source_a") < F.col("source_b"))
    never = F.col("source_a") == "src0"
    pairs = pairs.withColumn("started_at", F.when(~never, F.lit("2026-01-05 12:00:00").cast("timestamp"))).withColumn(
        "configuration_hash", F.when(~never, F.when(F.col("source_b") < "src4", "old").otherwise("new")))
    return L.stale_reasons(pairs, s.where("short_name <> 'src1'"), "new", "2026-02-01 00:00:00").select("source_a", "source_b", F.array_join("stale", "|").alias("stale"))


@query(SQ + f"SELECT p, source, count(DISTINCT s) AS subjects FROM q WHERE source IN ('crm', 'erp') AND p NOT IN ('{RDF_TYPE}', '{P}nation') GROUP BY p, source")
def uncompared_predicates(spark, d):
    usage = A.predicate_usage(star(spark, d), ["urn:t:Customer", "urn:t:Supplier"])
    return A.uncompared_predicates(usage, load_config(NEIGHBOUR_CONFIG).groups[0])


@query("SELECT 'urn:d:' || doc_id AS s, CASE WHEN source <> 'src0' THEN upper(source) END AS source_name FROM documents")
def source_names(spark, d):
    names = read(spark, d, "documents").where("source <> 'src0'").select(F.concat(F.lit("urn:datasource:"), "source").alias("graph"), F.upper("source").alias("short_name")).distinct()
    return Pt.shared_source_label(docs(spark, d).where(F.col("p") == RDF_TYPE), names).select("s", "source_name")


@query("WITH " + LINKS_SQL + ", t AS (SELECT *, source_b < 'src2' AS ran FROM l) SELECT source_a, iri_a, source_b, iri_b, 'PROPOSED' AS status FROM t WHERE NOT ran UNION ALL SELECT source_b, iri_b, source_a, iri_a, 'PROPOSED' FROM t WHERE false "
       "UNION ALL SELECT source_a, 'urn:new', source_b, iri_b, 'PROPOSED' FROM t WHERE ran")
def merged_proposals(spark, d):
    """Links after a run over some pairs of sources: their old proposals go, the run's come."""
    lk = cut_lineage(_copy_links(spark, d, "PROPOSED"))
    ran = lk.where("source_b < 'src2'").select("source_a", "source_b").distinct()
    new = lk.where("source_b < 'src2'").withColumn("iri_a", F.lit("urn:new")).withColumn("id", I.link_id("source_a", "iri_a", "source_b", "iri_b"))
    return M.merge_proposals(lk, new, ran).select("source_a", "iri_a", "source_b", "iri_b", "status")


# --- term search, examples, vocabularies, decisions of earlier runs ------------------------------


TERM_WORDS = ("w AS (SELECT p_partkey, word, max(wt) AS wt FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, 3.0::DOUBLE AS wt FROM part "
              "UNION ALL SELECT p_partkey, lower(p_type), 1.0::DOUBLE FROM part) GROUP BY ALL)")


@query("WITH " + TERM_WORDS + ", qs AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, r_name FROM part JOIN region ON r_regionkey = p_size % 5), "
       "qw AS (SELECT DISTINCT a || ' ' || r_name AS query_id, unnest(list_concat([a], string_split(lower(r_name), ' '))) AS word FROM qs), "
       "cw AS (SELECT r_regionkey, unnest(string_split(lower(r_name), ' ')) AS word FROM region), "
       "cs AS (SELECT query_id, r_regionkey, 3.0::DOUBLE * count(*) AS score FROM qw JOIN cw USING (word) GROUP BY ALL), "
       "hit AS (SELECT query_id, p_partkey, sum(wt) AS score FROM qw JOIN w USING (word) GROUP BY ALL UNION ALL SELECT query_id, p_partkey, score * 0.9 FROM cs JOIN part ON p_size % 5 = r_regionkey) "
       "SELECT query_id, 'urn:k:p' || p_partkey AS property, round(max(score), 6) AS score FROM hit GROUP BY ALL")
def properties_for(spark, d):
    """Properties named by a word of their label, or through their range class."""
    region = read(spark, d, "region").select("r_regionkey", "r_name")
    asked = read(spark, d, "part").select(F.substring_index("p_name", " ", 1).alias("a"), (F.col("p_size") % 5).alias("r_regionkey")).distinct().join(F.broadcast(region), "r_regionkey")
    text = F.concat_ws(" ", "a", "r_name")
    q, o = asked.select(text.alias("query_id"), text.alias("text")).distinct(), onto(spark, d)
    return Q.properties_for(Q.term_index(o), o, q).select("query_id", "property", F.round("score", 6).alias("score"))


@query(HIST + ", b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sm QUALIFY r <= 3), "
       "f AS (SELECT qs.query_id, n.id, n.ts FROM qs, (SELECT id, ts FROM h ORDER BY ts DESC, id LIMIT 6) n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = qs.query_id AND b.id = n.id)) "
       "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY late, r, ts DESC, id) AS rank "
       "FROM (SELECT query_id, id, 0 AS late, r, 0 AS ts FROM b UNION ALL SELECT query_id, id, 1, 0, ts FROM f) QUALIFY rank <= 3")
def question_examples(spark, d):
    """Three examples a question: the most similar past ones, then the most recent."""
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return Q.examples(_history(spark, d), q, 3)


@query(f"SELECT '{RICO}Type' AS type UNION SELECT 'http://www.w3.org/2004/02/skos/core#Concept' UNION SELECT 'urn:t:extra' UNION SELECT 'urn:k:r' || r_regionkey FROM region WHERE r_regionkey % 2 = 1 "
       "UNION SELECT 'urn:k:n' || n_nationkey FROM nation WHERE n_regionkey % 2 = 1 UNION SELECT 'urn:k:c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey % 2 = 1")
def vocabulary_types(spark, d):
    """Types below the schema's type of types: two of the regions with all that is below them."""
    edges = X.extract_hierarchy(onto(spark, d))
    odd = F.col("sub").rlike("^urn:k:r[0-9]*[13579]$")
    edges = edges.withColumn("super", F.when(odd, RICO + "Type").otherwise(F.col("super")))
    return A.vocabulary_types(edges, ["urn:t:extra"]).select("type")


DECIDED = "CASE o_orderkey % 40 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'manual' WHEN 2 THEN 'rejected' ELSE 'open' END"


@query("WITH x AS (SELECT 'c' || o_custkey AS entity, CASE WHEN o_orderkey % 3 <> 0 THEN 's' || (o_orderkey % 97) END AS matched_with, " + DECIDED + " AS status FROM orders), "
       "done AS (SELECT * FROM x WHERE status IN ('confirmed', 'manual')) "
       "SELECT 'a' AS side, 'c' || c_custkey AS entity, NULL AS other FROM customer WHERE 'c' || c_custkey NOT IN (SELECT entity FROM done) "
       "UNION ALL SELECT 'b', 's' || s_suppkey, NULL FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT matched_with FROM done WHERE matched_with IS NOT NULL) "
       "UNION ALL SELECT DISTINCT 'rejected', entity, matched_with FROM x WHERE status = 'rejected' AND matched_with IS NOT NULL")
def prior_decisions(spark, d):
    """Entities that earlier decisions leave to match on both sides, and the pairs that they rule out."""
    a = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity"))
    b = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity"))
    decisions = read(spark, d, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("entity"), F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN concat('s', o_orderkey % 97) END").alias("matched_with"), F.expr(DECIDED).alias("status"))
    left, right, rejected = tabular.apply_prior_decisions(a, b, decisions)
    none = F.lit(None).cast("string").alias("other")
    return left.select(F.lit("a").alias("side"), "entity", none).unionByName(right.select(F.lit("b").alias("side"), "entity", none)).unionByName(
        rejected.select(F.lit("rejected").alias("side"), "entity", F.col("matched_with").alias("other")))


@query("WITH " + LINKS_SQL + ", held AS (SELECT c FROM n WHERE source = (SELECT min(source) FROM documents)), "
       "x AS (SELECT d.source, 'urn:d:' || doc_id AS iri, CASE WHEN doc_id % 7 = 0 THEN 'untyped' WHEN lang = 'de' THEN 'not_in_any_group' "
       "WHEN EXISTS (SELECT 1 FROM n JOIN held USING (c) WHERE n.source = d.source AND n.iri = 'urn:d:' || doc_id) THEN 'already_matched' ELSE 'eligible' END AS reason FROM documents d) "
       "SELECT source, iri, reason, 1 AS entities FROM x WHERE reason = 'eligible' UNION ALL SELECT source, NULL, reason, count(*) FROM x GROUP BY ALL")
def eligible_entities(spark, d):
    """Documents that a run against the first source considers, and how many are left out for what reason."""
    t = read(spark, d, "documents")
    e = t.select("source", F.concat(F.lit("urn:d:"), "doc_id").alias("iri"), (F.col("doc_id") % 7 == 0).alias("untyped"),
                 F.when(F.coalesce(F.col("lang") == "de", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("texts"))).alias("groups"))
    clusters = C.build_clusters(_copy_links(spark, d), _no_identical(spark))
    eligible, counts = L.eligible_entities(e, clusters, t.agg(F.min("source")).first()[0])
    return eligible.select("source", "iri", F.lit("eligible").alias("reason"), F.lit(1).cast("long").alias("entities")).unionByName(
        counts.select("source", F.lit(None).cast("string").alias("iri"), "reason", "entities"))
