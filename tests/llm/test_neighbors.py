import numpy as np
import pytest

from quadweave.llm import neighbors


def brute(vectors, k):
    out = {}
    ok = {i: np.array(v, float) for i, v in vectors.items() if v is not None and len(v) == 70 and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    for q in ok:
        if q % 50 == 0:
            scores = []
            for i, v in ok.items():
                if i != q:
                    a = b = c = 0.0
                    for x, y in zip(ok[q].tolist(), v.tolist()):
                        a, b, c = a + x * y, b + x * x, c + y * y
                    scores.append((-(a / (np.sqrt(b) * np.sqrt(c))), i))
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def frame(spark, vectors):
    rows = [(i, v, "x", "y") for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v string").repartition(4)


def test_search_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 70))
    vectors = {i: (centres[i % 20] + 0.4 * rng.standard_normal(70)).astype("f4").tolist() for i in range(900)}
    same = vectors[1]
    vectors |= {i: same for i in range(300, 420)}  # one vector many times: ties go to the smaller id
    vectors |= {7: None, 8: [0.0] * 70, 9: [float("nan")] * 70, 11: [float("inf")] + [1.0] * 69, 12: [1.0] * 3, 150: [0.0] * 70}
    rows = [*vectors.items(), (None, same)]
    found = {}
    for r in neighbors.nearest(frame(spark, rows)).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(vectors, 5)
    assert found.keys() == want.keys()
    hits = 0
    for q, answers in want.items():
        got = [found[q][k] for k in range(1, len(answers) + 1)]
        hits += len({i for i, _ in got} & {i for i, _ in answers})
        if q in range(300, 420):
            assert got == answers
    assert hits >= 0.98 * sum(map(len, want.values()))


def test_every_row_of_a_repeated_id_counts(spark):
    near, far, query = [1.0, 0.1], [0.0, 1.0], [1.0, 0.0]
    rows = [(50, query), (51, near), (51, far), (51, far), (52, [1.0, 1.0, 1.0]), (100, [2.0, 2.0, 2.0]), (150, far), (150, near)]
    found = {}
    for r in neighbors.nearest(frame(spark, rows)).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 6)))
    assert sorted(found) == [50, 100, 150]
    close = round(1 / np.sqrt(1.01), 6)
    assert sorted(found[50]) == [(1, 51, close), (2, 150, close), (3, 51, 0.0), (4, 51, 0.0), (5, 150, 0.0)]
    assert found[100] == [(1, 52, 1.0)], "vectors of another length meet each other"
    assert len(found[150]) == 10, "each row is a query of its own"
    assert sorted(r[1:] for r in found[150] if r[0] == 1) == [(51, 1.0), (51, 1.0)]


def test_blocks_give_the_same(spark):
    rng = np.random.default_rng(1)
    index = neighbors.build_index(frame(spark, [(i, rng.standard_normal(70).astype("f4").tolist()) for i in range(400)]))
    queries = index.where("id % 50 = 0")
    one = neighbors.search(index, queries).collect()
    many = neighbors.search(index, queries, query_block=3, candidate_block=37).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 40


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(2)
    for dim in (3, 64, 100):
        v, q = rng.standard_normal((500, dim)), rng.standard_normal((20, dim))
        turn = neighbors.rotation(dim)
        assert np.allclose(turn.T @ turn, np.eye(dim))
        est, width = neighbors.estimates(q, *neighbors.codes(v, turn), turn)
        exact = np.array([neighbors.cosines(x, v) for x in q])
        assert (np.abs(est - exact) <= width).mean() > 0.999
        assert np.abs(est - exact).mean() < 0.12 if dim >= 64 else True


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = neighbors.nearest(frame(spark, [(i * 50, [1.0, float(i)]) for i in range(n)])).collect()
    assert len(rows) == n * (n - 1)
