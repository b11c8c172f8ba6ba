import numpy as np
import pytest

from tessera.llm.whitening import op11_whitening, principal_components, whiten


def brute(vectors, most=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(0)
    y = x - s / n
    cov = y.T @ y / n
    values, parts = np.linalg.eigh(cov)
    by = np.argsort(-values)[:most]
    by = [k for k in by if values[k] > 1e-11 * values.max()]
    white = y @ parts[:, by] / np.sqrt(values[by])
    return [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x], white, values[by] / np.trace(cov)


def check(rows, vectors, most=32):
    deviation, white, explained = brute(list(vectors.values()), most)
    got = {r.vec_id: r for r in rows}
    assert set(got) == set(vectors)
    found = np.array([got[k].whitened for k in vectors])
    sign = np.sign((found * white).sum(0))
    assert np.allclose(found * sign, white, atol=1e-6)
    for k, want in zip(vectors, deviation, strict=True):
        assert got[k].deviation == want and got[k].n == len(vectors)
        assert np.allclose(got[k].explained, explained, rtol=1e-9) and got[k].identity_error < 1e-8


def test_against_brute_force_with_odd_rows(spark):
    r = np.random.default_rng(5)
    vectors = {k: (r.normal(size=9) * np.arange(1, 10) + 3).tolist() for k in range(300)}
    odd = [(-1, None), (-2, [1.0, None]), (-3, [float("nan")] * 9), (-4, [float("inf")] * 9), (-5, []), (-6, [2.0**40] * 9), (-7, [1.0, 2.0])]
    table = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as n", "2 as id", "'x' as vector").repartition(5)
    rows = whiten(table).collect()
    alone = [x for x in rows if x.vec_id == -7]  # the only vector of its length: nothing to whiten
    assert len(alone) == 1 and (alone[0].n, alone[0].deviation, alone[0].whitened, alone[0].identity_error) == (1, 0, [], None)
    check([x for x in rows if x.vec_id >= 0], vectors)
    check(whiten(table.filter("vec_id >= 0"), 4).collect(), vectors, 4)
    assert whiten(table.limit(0)).collect() == [] and whiten(table.filter("vec_id = -1")).collect() == []


def test_repeated_rows_null_ids_and_flat_directions(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(40, 3)) @ r.normal(size=(3, 12)) * 1e4  # rank 3, but for the rounding
    rows = [(None, [5.0] * 12)] * 2 + [(7, v.tolist()) for v in np.repeat(base, 2, 0)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 82 and sum(x.vec_id is None for x in got) == 2
    assert got[0].identity_error < 1e-4
    same = whiten(spark.createDataFrame([(k, [1.5, -2.0]) for k in range(4)], "vec_id long, embedding array<float>")).collect()
    assert [(x.n, x.deviation, x.whitened) for x in same] == [(4, 0, [])] * 4
    wide = whiten(spark.createDataFrame([(k, [float(k) * 1e11]) for k in range(3)], "vec_id long, embedding array<double>")).collect()
    assert [x.deviation for x in sorted(wide, key=lambda x: x.vec_id)] == [None, 0, None]  # 3.7e26 does not fit


@pytest.mark.parametrize("kind", ["random", "clustered", "identity", "diagonal", "one", "two"])
def test_components_equal_the_library_s(kind):
    r = np.random.default_rng(7)
    q = np.linalg.qr(r.normal(size=(80, 80)))[0]
    a = {
        "random": lambda: (lambda z: z.T @ z)(r.normal(size=(200, 80))), "clustered": lambda: q @ np.diag([5.0] * 10 + [5 + 1e-9] * 5 + [3.0] * 5 + list(np.linspace(1, 0.1, 60))) @ q.T,
        "identity": lambda: np.eye(40), "diagonal": lambda: np.diag(np.arange(10.0)), "one": lambda: np.array([[2.5]]), "two": lambda: np.array([[2.0, 1.0], [1.0, 2.0]]),
    }[kind]()
    a = (a + a.T) / 2
    values, vectors = principal_components(a)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][: len(values)]
    assert np.allclose(values, want, rtol=1e-12, atol=1e-12 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0]
    assert len(values) == min(32, np.linalg.matrix_rank(a))


def test_query_equals_brute_force(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    rows = op11_whitening(spark, sf).collect()
    deviation, white, explained = brute(list(vectors.values()))
    assert len(rows) == len(vectors) * 32
    found = np.zeros_like(white)
    at = {k: i for i, k in enumerate(vectors)}
    for x in rows:
        found[at[x.vec_id], x.component - 1] = x.whitened
        assert x.deviation == deviation[at[x.vec_id]] and abs(x.explained / explained[x.component - 1] - 1) < 1e-9 and x.identity_error < 1e-9
    assert np.allclose(found * np.sign((found * white).sum(0)), white, atol=1e-7)
