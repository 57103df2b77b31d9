"""Long tables matched through similar values, against every pair compared."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quadweave.operators import tabular
from quadweave.operators.similarity import similar_strings

COLS = "entity string, property string, value string, typevalue string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def percent(a, b):
    n = len(a) + len(b)
    return 100.0 if n == 0 else float(int((1 - (n - 2 * lcs(a, b)) / n) * 100 + 0.5))


def days(raw):
    parts = raw.strip().split("-")
    try:
        if [len(p) for p in parts] == [4]:
            return date(int(parts[0]), 1, 1), date(int(parts[0]), 12, 31)
        if [len(p) for p in parts] == [4, 2]:
            first = date(int(parts[0]), int(parts[1]), 1)
            return first, (first + timedelta(days=31)).replace(day=1) - timedelta(days=1)
        return (date.fromisoformat(raw.strip()),) * 2
    except ValueError:
        return None


def number(raw):
    try:
        return float(raw)
    except ValueError:
        return None


def value_score(kind, x, y):
    if kind == "string":
        return percent(x.lower(), y.lower())
    if kind == "number":
        p, q = number(x), number(y)
        return None if p is None or q is None else 100.0 * (p == q)
    p, q = days(x), days(y)
    if p is None or q is None:
        return None
    if p[0] > q[1] or q[0] > p[1]:
        return 0.0
    return 100.0 if p[0] == p[1] == q[0] == q[1] else 85.0


def cells(rows):
    out = {}
    for e, p, v, k in rows:
        if p != "rdf:type":
            kind, values = out.setdefault(e, {}).setdefault(p, ([], set()))
            kind.append(k)
            if v is not None:
                values.add(v)
    return out


def group_of(rows, groups):
    types = {}
    for e, p, v, _ in rows:
        if p == "rdf:type":
            types.setdefault(e, set()).add(v)
    return {e: next((n for n, g in enumerate(groups) if t <= set(g)), None) for e, t in types.items()}


def every_pair(a, b, groups, threshold, rejected):
    ca, cb, ga, gb = cells(a), cells(b), group_of(a, groups), group_of(b, groups)
    out = {}
    for x in ca:
        for y in cb:
            typed = x in ga and y in gb
            if (x, y) in rejected or typed and (ga[x] is None or gb[y] is None or not set(groups[ga[x]]) & set(groups[gb[y]])):
                continue
            scores = []
            for p in ca[x].keys() & cb[y].keys():
                kind = min(ca[x][p][0])
                if kind in ("string", "number", "date"):
                    found = [value_score(kind, v, w) for v in ca[x][p][1] for w in cb[y][p][1]]
                    found = [s for s in found if s is not None]
                    scores += [max(found)] if found else []
            if scores and sum(scores) / len(scores) >= threshold - 1e-9:
                out[x, y] = sum(scores) / len(scores)
    return out


def random_table(rng, mark, n):
    rows = []
    for i in range(n):
        e = f"{mark}{i}"
        for kind in rng.sample(["T", "U", "V"], rng.choice([0, 1, 1, 2])):
            rows.append((e, "rdf:type", kind, "iri"))
        for p, k in (("name", "string"), ("note", "string"), ("born", "date"), ("size", "number"), ("page", "iri")):
            for _ in range(rng.choice([0, 1, 1, 2])):
                if k == "string":
                    word = rng.choice(["Marie Lefebvre", "aa", "", "Jean Éluard", "abab" * 20, "x"])
                    v = "".join(c for c in word if rng.random() > 0.08) + rng.choice(["", "", "é", "a"])
                elif k == "date":
                    v = rng.choice(["1948", "1948-11", "1948-11-02", "1949-02", "1949-02-28", "soon", "1948-13", " 1949 "])
                else:
                    v = rng.choice(["1", "1.0", "2", "-0.0", "0", "many", "1e0"])
                rows.append((e, p, v if rng.random() > 0.03 else None, k))
    return rows + rows[:3]


@pytest.mark.parametrize("threshold", [60, 92.5])
def test_equal_to_every_pair_compared(spark, threshold):
    rng = random.Random(int(threshold))
    a, b = random_table(rng, "a", 40), random_table(rng, "b", 40)
    groups = [["T"], ["T", "U"], ["V"]]
    rejected = {(f"a{i}", f"b{i}") for i in range(0, 40, 3)}
    r = spark.createDataFrame(sorted(rejected), "entity string, matched_with string")
    got = tabular.match_tables(spark.createDataFrame(a, COLS), spark.createDataFrame(b, COLS), groups, threshold, r).collect()
    want = every_pair(a, b, groups, threshold, rejected)
    assert len(got) == len(want) > 0
    assert {(x.source_entity, x.target_entity): x.score for x in got} == pytest.approx(want)


def test_empty_tables_and_all_pairs(spark):
    a = spark.createDataFrame([("a", "name", "x", "string"), (None, "name", "x", "string"), ("a", None, "x", "string")], COLS)
    none = a.limit(0)
    assert tabular.match_tables(a, none, [["T"]]).count() == 0 == tabular.match_tables(none, a, [["T"]]).count()
    other = spark.createDataFrame([("b", "name", "y", "string")], COLS)
    assert [tuple(r) for r in tabular.match_tables(a, other, [["T"]], 0).collect()] == [("a", "b", 0.0)]
    assert tabular.match_tables(a, other, [["T"]], 1).count() == 0


@pytest.mark.parametrize("level", [0.2, 69, 97])
def test_no_similar_string_is_lost(spark, level):
    rng = random.Random(int(level))
    texts = {"".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))) for _ in range(40)}
    near = {t[: len(t) // 2] + rng.choice(["", "a", "bb"]) + t[len(t) // 2 :] for t in texts}
    frames = [spark.createDataFrame([("s", t, t) for t in sorted(x)], "slot string, v string, t string") for x in (texts, near)]
    got = similar_strings(*frames, spark.createDataFrame([("s", float(level))], "slot string, level double"))
    want = {(x, y): percent(x, y) for x in texts for y in near if percent(x, y) >= level}
    assert {(r.v_a, r.v_b): r.best for r in got.collect()} == want


def test_entities_meet_only_where_numbers_are_equal_that_have_to_be(spark):
    """Names one letter apart at 90 and a number: 10 entities of 5 numbers, each twice, and every pair of the same number."""
    rows = [r for i in range(10) for r in ((f"e{i}", "name", f"Supplier {i}", "string"), (f"e{i}", "size", str(i % 5), "number"))]
    t = spark.createDataFrame(rows, COLS)
    left = t.groupBy("entity", "property").agg(F.min("typevalue").alias("kind"), F.array_sort(F.collect_set("value")).alias("va"))
    right = t.groupBy("entity", "property").agg(F.array_sort(F.collect_set("value")).alias("vb"))
    want = {(f"e{i}", f"e{j}") for i in range(10) for j in range(10) if i % 5 == j % 5}
    assert {tuple(r) for r in tabular._candidates(left, right, t, t, [["T"]], 95).collect()} == want


def test_equal_entities_are_compared_once(spark, monkeypatch):
    rows = [(f"e{i}", "name", f"name {i % 2}", "string") for i in range(12)]
    met, inner = [], tabular._candidates
    monkeypatch.setattr(tabular, "_candidates", lambda *x: met.append(inner(*x)) or met[-1])
    t = spark.createDataFrame(rows, COLS)
    rejected = spark.createDataFrame([("e0", "e2")], "entity string, matched_with string")
    got = tabular.match_tables(t, t, [["T"]], 100, rejected).collect()
    assert met[0].count() == 2
    assert sorted((r.source_entity, r.target_entity) for r in got) == sorted(
        (f"e{i}", f"e{j}") for i in range(12) for j in range(12) if i % 2 == j % 2 and (i, j) != (0, 2))
