import random

from pyspark.sql import functions as F

from quadweave.functions import text as T
from quadweave.operators import search as Q
from quadweave.vocab import QUAD_SCHEMA, RICO


def test_label_search_finds_everything_an_exhaustive_scan_finds(spark):
    rnd = random.Random(9)
    base = ["correspondence", "photograph", "internationalization", "dupont", "atelier", "marie", "archives"]

    def word():
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            i = rnd.randrange(len(w))
            rnd.choice([lambda: w.__setitem__(i, "z"), lambda: w.insert(i, "y"), lambda: len(w) > 2 and w.pop(i)])()
        return "".join(w)

    labels = [" ".join(word() for _ in range(rnd.choice([1, 2, 3]))) for _ in range(250)]
    rows = [("s", "g", "data", f"urn:{i}", "iri", RICO + "name", x, "literal", None, None) for i, x in enumerate(labels)]
    quads = spark.createDataFrame(rows, QUAD_SCHEMA)
    queries = spark.createDataFrame([(i, word() + rnd.choice(["", " " + word()])) for i in range(40)], "query_id int, text string")
    q = queries.select("query_id", F.array_distinct(T.tokens("text")).alias("qw"))
    every = quads.select(F.col("s").alias("iri"), T.tokens("o").alias("lw")).crossJoin(q)
    want = {(r.query_id, r.iri) for r in every.where(T.label_score(F.col("qw"), F.col("lw")) >= 0.75).collect()}
    got = {(r.query_id, r.iri) for r in Q.search_labels(quads, queries).collect()}
    assert got == want and len(want) > 40


def test_examples_are_completed_with_recent_questions(spark):
    h = spark.createDataFrame([("a", "list the persons", False, False, 1, 1), ("b", "count places", True, False, 2, 2), ("c", "show maps", False, False, 1, 3)],
                              "id string, question string, edited boolean, decided boolean, use_count int, at long").withColumn("at", F.timestamp_seconds("at"))
    q = spark.createDataFrame([(1, "list persons")], "query_id int, text string")
    rows = [(r.rank, r.id) for r in Q.examples(h, q, 3).orderBy("rank").collect()]
    assert rows == [(1, "a"), (2, "c"), (3, "b")]
