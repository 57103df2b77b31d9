"""Fuzzy label search, term search, question history."""

from pyspark.sql import DataFrame, functions as F

from quadweave.functions.iri import local_name
from quadweave.functions.text import collapse_ws, content_words, label_score, normalize, split_local_name, tokens
from quadweave.operators.closures import with_subclasses
from quadweave.operators.patterns import best_label, data_quads, iri_subjects, top_k_per_group
from quadweave.runtime import ROWS_PER_TASK, broadcast_if_small, cut_lineage, dealt_join, skew_safe_join, tasks_for
from quadweave.vocab import LABEL_PREDICATES, OWL, RDF_TYPE, RDFS, RDFS_LABEL, SKOS

MIN_SCORE = 0.75


# A label scores 0.75 only if some word of the query is at least this similar to one of its words:
# all query words occur, or 0.85 x the mean of their best similarities reaches 0.75.
WORD_SCORE = MIN_SCORE / 0.85


def _edits(length):
    """Edits allowed between two words the longer of which has this length."""
    return F.floor((1 - WORD_SCORE) * length + 1e-9).cast("int")


def _reach(length):
    """Edits allowed at most between a word of this length and any other: d <= share x (length + d)."""
    return F.floor(length * ((1 - WORD_SCORE) / WORD_SCORE) + 1e-9).cast("int")


def _segment(length, i):
    """(start, size) of segment ``i`` of a word that is cut into one segment more than it may have edits."""
    cut = lambda k: F.floor(k * length / (_reach(length) + 1)).cast("int")
    return cut(i), cut(i + 1) - cut(i)


def _segment_key(length, i, text):
    return F.concat_ws(":", length.cast("string"), i.cast("string"), text)


def _own_keys(w):
    """Keys of a label word: its segments with their number and the word's length.

    There are more segments than edits, so one of them is left whole in any similar word.
    """
    n = F.char_length(w)

    def key(i):
        start, size = _segment(n, i)
        return _segment_key(n, i, F.substring(w, start + 1, size))

    return F.transform(F.sequence(F.lit(0), _reach(n)), key)


def _partner_keys(w):
    """Keys of every label word within the allowed edits of a query word.

    For each length and segment in reach: the query's letters at the places to which that many edits
    may have moved the segment.
    """
    n = F.char_length(w)

    def of_length(length):
        def of_segment(i):
            start, size = _segment(length, i)
            places = F.filter(F.sequence(start - _reach(length), start + _reach(length)), lambda p: (p >= 0) & (p + size <= n))
            return F.transform(places, lambda p: _segment_key(length, i, F.substring(w, p + 1, size)))

        return F.flatten(F.transform(F.sequence(F.lit(0), _reach(length)), of_segment))

    lengths = F.sequence(F.greatest(n - _reach(n), F.lit(1)), n + _reach(n))
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def similar_words(query_words, label_words) -> DataFrame:
    """(q, w): distinct words of queries and labels similar enough to matter, by an equi-join."""
    q = query_words.select("q").distinct().withColumn("key", F.explode(_partner_keys(F.col("q"))))
    w = label_words.select("w").distinct().withColumn("key", F.explode(_own_keys(F.col("w"))))
    longest = F.greatest(F.char_length("q"), F.char_length("w"))
    return q.join(w, "key").where(F.levenshtein("q", "w") <= _edits(longest)).select("q", "w").distinct()


def search_labels(quads, queries, types=None, k=None, internal_source=None, edges=None) -> DataFrame:
    """Best entities for each query (query_id, text): label score of at least 0.75.

    (query_id, iri, label, score, types, origin, source), best label per entity, ``k`` best per
    query, ties by IRI. Candidates come from shared or similar words, which loses nothing; labels are
    scored once per distinct text. ``edges`` (sub, super) adds the subclasses of ``types``.
    """
    if types is not None and edges is not None:
        types = with_subclasses(types, edges)
    names = iri_subjects(data_quads(quads)).where(F.col("p").isin(LABEL_PREDICATES) & (F.col("o_kind") == "literal")).select(
        F.col("s").alias("iri"), F.col("o").alias("label")).distinct()
    if types is not None:
        t = quads.where(F.col("p") == RDF_TYPE)
        t = t.join(broadcast_if_small(types.select(F.col("type").alias("o")).distinct()), "o", "left_semi") if isinstance(types, DataFrame) else t.where(F.col("o").isin(list(types)))
        names = names.join(t.select(F.col("s").alias("iri")).distinct(), "iri", "left_semi")
    q = queries.select("query_id", F.array_distinct(tokens("text")).alias("qw")).where(F.size("qw") > 0)
    # The words of labels are used for candidates and for scores: written once.
    texts = cut_lineage(names.select("label").distinct().select("label", tokens("label").alias("lw")).where(F.size("lw") > 0))
    q = cut_lineage(q)
    qw = q.select("query_id", F.explode("qw").alias("q"))
    lw = texts.select("label", F.explode(F.array_distinct("lw")).alias("w"))
    # Words first, then the labels containing them: a query meets only labels that may reach 0.75.
    by_word = cut_lineage(qw.join(similar_words(qw, lw), "q").select("query_id", "w").distinct())
    met = skew_safe_join(by_word, lw, ["w"], ["query_id"], ["label"]).select("query_id", "label").distinct()
    scored = met.join(texts, "label").join(q, "query_id").withColumn("raw", label_score(F.col("qw"), F.col("lw"))).where(
        F.col("raw") >= MIN_SCORE).select("query_id", "label", "raw")
    hit = scored.join(names, "label").groupBy("query_id", "iri").agg(
        F.max(F.struct("raw", "label")).alias("b")).select("query_id", "iri", "b.raw", "b.label")
    if k is not None:
        hit = top_k_per_group(hit, ["query_id"], [F.desc("raw"), "iri"], k).drop("rank")
    hit = cut_lineage(hit)
    found = hit.select("iri").distinct()
    facts = data_quads(quads).join(broadcast_if_small(found.withColumnRenamed("iri", "s")), "s", "left_semi")
    inside = F.lit(False) if internal_source is None else F.col("source") == internal_source
    info = facts.groupBy(F.col("s").alias("iri")).agg(
        F.array_sort(F.collect_set(F.when(F.col("p") == RDF_TYPE, F.col("o")))).alias("types"),
        F.when(F.max(inside), "internal").otherwise("external").alias("origin"), F.min("source").alias("source"))
    return hit.join(info, "iri").select("query_id", "iri", "label", (F.floor(F.col("raw") * 100 + 0.5) / 100).alias("score"), "types", "origin", "source")


def resolve_names(quads, names, types=None, edges=None) -> DataFrame:
    """(query_id, status, iri, candidates): the one entity a name denotes, else the candidates.

    Resolved with a single match, or when only the first of all hits scores 0.9 or more.
    """
    hits = search_labels(quads, names, types, edges=edges)
    per = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.9).alias("strong"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("iri").alias("iri")))).alias("c"))
    one = (F.col("n") == 1) | (F.col("strong") == 1)
    return names.select("query_id").join(per, "query_id", "left").select(
        "query_id",
        F.when(F.col("n").isNull(), "none").when(one, "resolved").otherwise("ambiguous").alias("status"),
        F.when(one, F.col("c")[0]["iri"]).alias("iri"),
        F.when(~one, F.transform("c", lambda x: x["iri"])).alias("candidates"))


# --- ontology terms -------------------------------------------------------------------------

# Weight of a word found in a label, else in a definition, else in a scope note.
FIELD_WEIGHTS = {"label": 3.0, "definition": 1.0, "scope": 0.5}


def term_kinds(onto, namespace=None) -> DataFrame:
    """(term, kind): CLASS, OBJECT_PROPERTY or DATATYPE_PROPERTY of the named terms."""
    kinds = {OWL + "Class": "CLASS", OWL + "ObjectProperty": "OBJECT_PROPERTY", OWL + "DatatypeProperty": "DATATYPE_PROPERTY"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    t = onto.where((F.col("p") == RDF_TYPE) & (F.col("s_kind") == "iri") & F.col("o").isin(list(kinds)))
    if namespace:
        t = t.where(F.col("s").startswith(namespace))
    return t.select(F.col("s").alias("term"), F.try_element_at(table, F.col("o")).alias("kind")).distinct()


def term_index(onto, namespace=None) -> DataFrame:
    """(word, term, kind, weight): inverted index of labels, definitions and scope notes."""
    terms = term_kinds(onto, namespace)
    english = F.coalesce("o_lang", F.lit("")).isin("", "en")
    field = (
        F.when(F.col("p") == RDFS_LABEL, "label")
        .when(F.col("p").isin(RDFS + "comment", SKOS + "definition") & english, "definition")
        .when((F.col("p") == SKOS + "scopeNote") & english, "scope")
    )
    text = onto.where("o_kind = 'literal'").select(F.col("s").alias("term"), field.alias("field"), F.col("o").alias("text")).where("field is not null")
    own = terms.select("term", F.lit("label").alias("field"), split_local_name(local_name("term")).alias("text"))
    weight = F.create_map(*[F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv])
    return (
        text.unionByName(own).join(terms, "term")
        .select("term", "kind", "field", F.explode(content_words("text")).alias("word"))
        .groupBy("word", "term", "kind").agg(F.max(F.element_at(weight, F.col("field"))).alias("weight"))
    )


def term_details(onto, namespace=None) -> DataFrame:
    """(term, kind, domains, ranges, inverse, functional): structure of the properties."""
    from quadweave.operators.ontology import inverse_properties, range_members

    t = term_kinds(onto, namespace).where("kind <> 'CLASS'")
    d = range_members(onto, RDFS + "domain").groupBy(F.col("property").alias("term")).agg(F.array_sort(F.collect_set("member")).alias("domains"))
    r = range_members(onto, RDFS + "range").groupBy(F.col("property").alias("term")).agg(F.array_sort(F.collect_set("member")).alias("ranges"))
    inv = inverse_properties(onto).groupBy(F.col("property").alias("term")).agg(F.min("inverse").alias("inverse"))
    fun = onto.where((F.col("p") == RDF_TYPE) & (F.col("o") == OWL + "FunctionalProperty")).select(F.col("s").alias("term"), F.lit(True).alias("f")).distinct()
    return t.join(d, "term", "left").join(r, "term", "left").join(inv, "term", "left").join(fun, "term", "left").select(
        "term", "kind", "domains", "ranges", "inverse", F.coalesce("f", F.lit(False)).alias("functional"))


def _best(rows, keys, value, how, n, target):
    """``rows`` by ``keys`` with one value each, ``n`` rows dealt out to tasks of about ``target``."""
    return rows.repartition(tasks_for(n, target), *keys).groupBy(*keys).agg(how(value).alias(value))


def _scored_terms(index, queries, target):
    """(query_id, term, kind, score) for every term that holds a word of the query, and how many pairs of word and term made it."""
    words = cut_lineage(queries.select("query_id", F.explode(content_words("text")).alias("word")))
    met, n = dealt_join(index, words, ["word"], ["term", "kind"], ["query_id"], target)
    return _best(met.select("query_id", "term", "kind", F.col("weight").alias("score")), ["query_id", "term", "kind"], "score", F.sum, n, target), n


def search_terms(index, queries, k=None, target=ROWS_PER_TASK) -> DataFrame:
    """(query_id, term, kind, score): sum over the query's words of their best field weight.

    Terms that hold a word of a query are found and summed by tasks of about ``target`` pairs, a
    frequent word by several; words that repeat in a query count once.
    """
    out, _ = _scored_terms(cut_lineage(index), queries, target)
    return out if k is None else top_k_per_group(out, ["query_id"], [F.desc("score"), "term"], k).drop("rank")


def properties_for(index, onto, queries, k=None, target=ROWS_PER_TASK) -> DataFrame:
    """(query_id, property, score): property hits, and 0.9 x the score of a range class."""
    from quadweave.operators.ontology import range_members

    index = cut_lineage(index)
    s, n = _scored_terms(index, queries, target)
    s = cut_lineage(s)
    direct = s.where("kind <> 'CLASS'").select("query_id", F.col("term").alias("property"), "score")
    objects = index.where("kind = 'OBJECT_PROPERTY'").select(F.col("term").alias("property")).distinct()
    ranges = cut_lineage(range_members(onto, RDFS + "range").join(objects, "property", "left_semi").select("property", F.col("member").alias("term")))
    # A class may be the range of a third of all properties, and hit by as many queries.
    hits = s.where("kind = 'CLASS'").select("query_id", "term", "score")
    via, more = dealt_join(hits, ranges, ["term"], ["query_id"], ["property"], target)
    rows = direct.unionByName(via.select("query_id", "property", (F.col("score") * 0.9).alias("score")))
    out = _best(rows, ["query_id", "property"], "score", F.max, n + more, target)
    return out if k is None else top_k_per_group(out, ["query_id"], [F.desc("score"), "property"], k).drop("rank")


def phrase_key(col):
    """Column: folded words of a phrase, each in the singular."""
    def singular(w):
        n = F.char_length(w)
        return (
            F.when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
            .when((w.endswith("s") | w.endswith("x")) & (n > 3), F.substring(w, F.lit(1), n - 1))
            .otherwise(w)
        )

    return F.array_join(F.transform(tokens(col), singular), " ")


def resolve_terms(phrases, usage, onto, kinds) -> DataFrame:
    """(query_id, iri): what a phrase names: data usage first (most used), then ontology terms.

    ``phrases`` (query_id, text); ``usage`` (iri, n) are used types or predicates; ``kinds`` are the
    term kinds looked up in the ontology by local name and labels.
    """
    q = phrases.select("query_id", phrase_key("text").alias("key")).where("key <> ''")
    name_key = lambda c: phrase_key(split_local_name(local_name(c)))
    used = usage.select(name_key("iri").alias("key"), F.lit(0).alias("tier"), (-F.col("n")).alias("o"), "iri")
    terms = term_kinds(onto).where(F.col("kind").isin(list(kinds))).select("term")
    by_name = terms.select(name_key("term").alias("key"), F.lit(1).alias("tier"), F.lit(0).cast("long").alias("o"), F.col("term").alias("iri"))
    labels = onto.where((F.col("p") == RDFS_LABEL) & (F.col("o_kind") == "literal")).select(F.col("s").alias("term"), "o").join(terms, "term", "left_semi")
    by_label = labels.select(phrase_key("o").alias("key"), F.lit(1).alias("tier"), F.lit(0).cast("long").alias("o"), F.col("term").alias("iri"))
    known = used.unionByName(by_name).unionByName(by_label)
    best = known.join(q, "key").groupBy("query_id").agg(F.min(F.struct("tier", "o", "iri"))["iri"].alias("iri"))
    return phrases.select("query_id").join(best, "query_id", "left")


# --- history --------------------------------------------------------------------------------


def similar_questions(history, queries, n=None) -> DataFrame:
    """(query_id, id, score): past questions sharing words with each query, best first.

    History columns: id, question, edited, decided, use_count, at. Pairs are formed through shared
    words only; word sets are compared afterwards, once per pair.
    """
    newest = F.lit(history.agg(F.max("at")).first()[0])
    h = history.select("id", "edited", "decided", "use_count", "at", content_words("question").alias("hw"))
    q = queries.select("query_id", content_words("text").alias("qw"))
    met = skew_safe_join(
        h.select("id", F.explode("hw").alias("w")), q.select("query_id", F.explode("qw").alias("w")), ["w"], ["id"], ["query_id"]
    ).groupBy("id", "query_id").agg(F.count(F.lit(1)).alias("common"))
    sized = met.join(h.select("id", "edited", "decided", "use_count", "at", F.size("hw").alias("nh")), "id").join(
        q.select("query_id", F.size("qw").alias("nq")), "query_id")
    s = F.col("common") / (F.col("nh") + F.col("nq") - F.col("common"))
    s = s + F.when(F.col("edited") | F.col("decided"), 0.15).otherwise(0.0) + F.least(F.lit(0.05), 0.01 * F.col("use_count"))
    s = s + F.when(F.col("at") == newest, 0.01).otherwise(0.0)
    out = sized.select("query_id", "id", s.alias("score"))
    return out if n is None else top_k_per_group(out, ["query_id"], [F.desc("score"), "id"], n).drop("rank")


def examples(history, queries, n, fill=None) -> DataFrame:
    """(query_id, id, rank): the ``n`` most similar questions, completed up to ``fill`` with the most recent ones.

    ``fill`` is ``n`` by default.
    """
    sim = top_k_per_group(similar_questions(history, queries), ["query_id"], [F.desc("score"), "id"], n)
    want = n if fill is None else min(n, fill)
    # As many of the most recent questions are enough to complete any list.
    recent = history.orderBy(F.desc("at"), "id").limit(n + want).select("id", "at").collect()
    if not recent:
        return sim.select("query_id", "id", "rank")
    latest = F.explode(F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.at).alias("at")) for r in recent])).alias("r")
    more = queries.select("query_id", latest).select("query_id", "r.id", "r.at").join(sim.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = sim.select("query_id", "id", F.lit(0).alias("late"), F.col("rank").alias("o"), F.lit(None).cast("timestamp").alias("at")).unionByName(
        more.select("query_id", "id", F.lit(1).alias("late"), F.lit(0).alias("o"), F.col("at").cast("timestamp").alias("at")))
    ranked = top_k_per_group(both, ["query_id"], ["late", "o", F.desc("at"), "id"], n)
    return ranked.where((F.col("late") == 0) | (F.col("rank") <= want)).select("query_id", "id", "rank")


def merge_history(history, new) -> DataFrame:
    """History after new runs: the same question and query counts up, others are added.

    ``new``: id, question, query, generated, at. Questions compare by folded words, queries by
    collapsed whitespace; ``edited`` tells whether the query run differs from the generated one.
    """
    q, s = normalize("question"), F.coalesce(collapse_ws("query"), F.lit(""))
    n = new.select("id", F.trim("question").alias("question"), "query", "generated", "at", q.alias("_q"), s.alias("_s")).where("_q is not null and question <> ''")
    edited = F.col("generated").isNotNull() & (collapse_ws("generated") != F.col("_s"))
    runs = n.groupBy("_q", "_s").agg(
        F.min(F.struct("at", "id", "question", "query", edited.alias("edited"))).alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("runs"))
    old = history.withColumn("_q", q).withColumn("_s", s).join(runs.select("_q", "_s", "last", "runs"), ["_q", "_s"], "left")
    kept = old.select("id", "question", "query", "edited", (F.col("use_count") + F.coalesce("runs", F.lit(0))).alias("use_count"), F.greatest("at", F.coalesce("last", "at")).alias("at"))
    fresh = runs.join(old.select("_q", "_s"), ["_q", "_s"], "left_anti").select(
        "first.id", "first.question", "first.query", "first.edited", F.col("runs").alias("use_count"), F.col("last").alias("at"))
    return kept.unionByName(fresh)


def entities_in_text(texts, quads, vocabulary_namespaces) -> DataFrame:
    """(text_id, iri, label): IRIs written as ``<...>`` in texts, outside vocabularies, with their label."""
    found = texts.select("text_id", F.explode(F.array_distinct(F.expr("regexp_extract_all(text, '<([^<>\\\\s]+)>', 1)"))).alias("iri")).where(F.col("iri").contains(":"))
    for ns in vocabulary_namespaces:
        found = found.where(~F.col("iri").startswith(ns))
    own = quads.join(broadcast_if_small(found.select(F.col("iri").alias("s")).distinct()), "s", "left_semi")
    names = best_label(own).select(F.col("s").alias("iri"), "label")
    return found.join(names, "iri", "left").select("text_id", "iri", F.coalesce("label", "iri").alias("label"))
