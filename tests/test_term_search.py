from collections import Counter

from quadweave.operators import search as Q
from quadweave.vocab import OWL, RDFS, RDF_TYPE

ONTO = "s string, s_kind string, p string, o string, o_kind string, o_lang string"


def brute(rows, queries):
    found = Counter()
    for q, text in queries:
        for word in set(text.split()):
            for w, term, kind, weight in rows:
                if w == word:
                    found[q, term, kind] += weight
    return dict(found)


def test_a_word_of_a_third_of_all_terms(spark):
    """Words cut over many tasks give what plain counting gives; repeated words of a query count once."""
    rows = [("river", f"t{i}", "CLASS" if i % 4 else "OBJECT_PROPERTY", 3.0) for i in range(300)]
    rows += [(f"w{i % 50}", f"t{i}", "CLASS" if i % 4 else "OBJECT_PROPERTY", 1.0 + i % 2) for i in range(600)]
    queries = [(f"q{i}", f"river w{i % 50} river") for i in range(40)] + [("none", "mountain"), ("blank", "")]
    index = spark.createDataFrame(rows, "word string, term string, kind string, weight double")
    asked = spark.createDataFrame([*queries, ("null", None)], "query_id string, text string")
    want = brute(rows, queries)
    for target in (7, 10**6):
        got = {(r["query_id"], r["term"], r["kind"]): r["score"] for r in Q.search_terms(index, asked, target=target).collect()}
        assert got == want
    best = Q.search_terms(index, asked, k=3, target=7).collect()
    for q, _ in queries[:5]:
        order = sorted((-s, t) for (x, t, _), s in want.items() if x == q)[:3]
        assert sorted((-r["score"], r["term"]) for r in best if r["query_id"] == q) == order


def test_properties_through_a_frequent_range(spark):
    """A property is hit by itself or, at nine tenths, through its range class; the larger score stays."""
    props = [f"p{i}" for i in range(60)]
    facts = [(p, RDF_TYPE, OWL + "ObjectProperty") for p in props] + [("c", RDF_TYPE, OWL + "Class")]
    facts += [(p, RDFS + "range", "c") for p in props[:40]]
    onto = spark.createDataFrame([(s, "iri", p, o, "iri", None) for s, p, o in facts], ONTO)
    rows = [("place", "c", "CLASS", 3.0)] + [("place", p, "OBJECT_PROPERTY", 1.0) for p in props[30:]] + [("old", props[0], "OBJECT_PROPERTY", 3.0)]
    rows += [("old", p, "OBJECT_PROPERTY", 0.5) for p in props[1:]]
    index = spark.createDataFrame(rows, "word string, term string, kind string, weight double")
    asked = spark.createDataFrame([(f"q{i}", "old place") for i in range(5)], "query_id string, text string")
    want = {}
    for i, p in enumerate(props):
        own = (3.0 if i == 0 else 0.5) + (1.0 if i >= 30 else 0.0)
        want[p] = max(own, 0.9 * 3.0 if i < 40 else 0.0)
    for target in (7, 10**6):
        got = Q.properties_for(index, onto, asked, target=target).collect()
        assert len(got) == 5 * len(props)
        assert all(abs(r["score"] - want[r["property"]]) < 1e-9 for r in got)
    assert len(Q.properties_for(index, onto, asked, k=2, target=7).collect()) == 10
    assert Q.properties_for(index.limit(0), onto, asked).count() == 0


def test_hits_are_dealt_out_by_their_number(spark):
    """One word in 1,000 labels: tasks of about 50 hits, whatever adaptive execution would join."""
    index = spark.range(1000).selectExpr("'ring' AS word", "concat('urn:', id) AS term", "'CLASS' AS kind", "3.0D AS weight")
    asked = spark.createDataFrame([("q", "ring")], "query_id string, text string")
    got = Q.search_terms(index, asked, target=50)
    assert got.count() == 1000 and max(map(len, got.rdd.glom().collect())) < 150
