import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadweave.functions import iri as I
from quadweave.functions import text as T
from quadweave.functions.dates import interval_overlaps, parse_partial_date
from quadweave.functions.lcs import indel_ratios
from quadweave.operators import compare


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(col.alias("x")).first().x


def test_similarity(spark):
    ratio = lambda a, b: one(spark, T.indel_ratio(T.normalize("a"), T.normalize("b")), a=a, b=b)
    assert ratio("Marie Lefebvre", "Marie Lefevre") == pytest.approx(0.963, abs=1e-3)
    assert ratio("Musée d'Orsay", "musee d orsay") == 1.0
    assert one(spark, T.token_sort_ratio(F.col("a"), F.col("b")), a="Dupont, Jean", b="Jean Dupont") == 1.0
    assert one(spark, compare.cmp_name(F.col("a"), F.col("b")), a="", b="x") is None
    assert one(spark, compare.cmp_exact(F.col("a"), F.col("b")), a="ÉTÉ", b="ete") == 1.0


def test_lcs_against_dynamic_programming():
    import random

    rnd = random.Random(7)

    def lcs(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            c = [0]
            for j, y in enumerate(b):
                c.append(p[j] + 1 if x == y else max(p[j + 1], c[j]))
            p = c
        return p[-1]

    word = lambda: "".join(rnd.choice("abcé \0") for _ in range(rnd.choice([0, 1, 7, 63, 64, 65, 130])))
    a, b = [word() for _ in range(150)], [word() for _ in range(150)]
    for x, y, r, back in zip(a, b, indel_ratios(a, b), indel_ratios(b, a)):
        total = len(x) + len(y)
        assert r == pytest.approx(1.0 if not total else 1 - (total - 2 * lcs(x, y)) / total)
        assert r == pytest.approx(back) and 0 <= r <= 1


def test_fold_hangul_and_marks(spark):
    import unicodedata

    s = "Ǻḗ 한글 Ünï"
    want = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c)[0] != "M").lower()
    assert one(spark, T.fold("a"), a=s) == want


@pytest.mark.parametrize("text,start,end,exact", [
    ("1975", (1975, 1, 1), (1975, 12, 31), False), ("1975-02", (1975, 2, 1), (1975, 2, 28), False),
    ("1990-01-02T10:00:00Z", (1990, 1, 2), (1990, 1, 2), True), ("1975/1980-06", (1975, 1, 1), (1980, 6, 30), False)])
def test_partial_dates(spark, text, start, end, exact):
    d = one(spark, parse_partial_date("a"), a=text)
    assert (d.start, d.end, d.day_precise) == (dt.date(*start), dt.date(*end), exact)


def test_partial_dates_refused(spark):
    for bad in ("1975-13", "1975-02-30", "abc", "", "1980/1975"):
        assert one(spark, parse_partial_date("a"), a=bad) is None
    a, b = parse_partial_date("a"), parse_partial_date("b")
    assert one(spark, compare.cmp_date(a, b), a="1975", b="1975") == 0.85
    assert one(spark, compare.cmp_date(a, b), a="1975-03-12", b="1975-03-12") == 1.0
    assert one(spark, interval_overlaps(a, b), a="1975", b="1976") is False


def test_iris(spark):
    assert one(spark, I.expand_curie("a"), a="foaf:name") == "http://xmlns.com/foaf/0.1/name"
    assert one(spark, I.compact_iri("a"), a="http://xmlns.com/foaf/0.1/name") == "foaf:name"
    assert one(spark, I.datatype_category("a"), a="http://www.w3.org/2001/XMLSchema#gYear") == "DATETIME"
    assert one(spark, T.slug("a"), a="Été & Co.") == "ete-co"
    assert one(spark, T.split_local_name("a"), a="hasOrHad_part-of") == "has Or Had part of"
    words = lambda c: F.array_distinct(T.tokens(c))
    score = T.label_score(words("a"), T.tokens("b"))
    assert one(spark, score, a="jean dupont", b="Jean Dupont") == 1.0
    assert one(spark, score, a="dupont", b="Jean Dupont") == 0.9
    assert one(spark, score, a="dupond", b="Dupont") == pytest.approx(0.85 * 5 / 6)
    assert one(spark, T.same_name(T.tokens("a"), T.tokens("b")), a="Jean Dupond", b="jean dupont")
