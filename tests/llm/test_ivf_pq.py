import numpy as np

from terseflow.llm import ivf_pq

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    out = {}
    for i, x in rows:
        d = sorted((float(np.sqrt(((np.array(x, np.float32).astype(float) - np.array(y, np.float32).astype(float)) ** 2).sum())), j) for j, y in rows if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)) + 3 * rng.normal(size=(9, 16))[rng.integers(0, 9, 900)]
    rows = [(int(i), v.astype(float).tolist()) for i, v in enumerate(x)]
    found = {}
    for r in ivf_pq.neighbours(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).orderBy("vec_id", "rank").collect():
        found.setdefault(r.vec_id, []).append(r.neighbour_id)
    true = brute(rows, 10)
    assert all(len(v) == 10 for v in found.values()) and len(found) == 900
    assert sum(len(set(found[i]) & set(true[i])) for i in true) / 9000 >= 0.9


def test_edge_cases(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, None, 0), (5, [float("nan"), 1.0], 0), (6, [1.0], 0), (None, [0.0, 0.0], 0), (7, [1.0, None], 0), (8, [], 0)]
    found = sorted((r.vec_id, r.rank, r.neighbour_id, r.distance) for r in ivf_pq.neighbours(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 3, 0.0), (2, 2, 1, 1.0), (3, 1, 2, 0.0), (3, 2, 1, 1.0)]
    assert ivf_pq.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)
    assert ivf_pq.neighbours(one).count() == 0


def test_queries_by_id_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), 0, i) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, `x.y` long")
    found = ivf_pq.neighbours(table, every=100).collect()
    assert {r.vec_id for r in found} == {0, 100, 200} and len(found) == 30


def test_any_finite_vector(spark):
    rows = [(1, [1e12, 0.0], 0), (2, [1e12, 1e9], 0), (3, [-3e38, 3e38], 0), (4, [1e-20, 0.0], 0), (5, [0.0, 0.0], 0)]
    nearest = {r.vec_id: r.neighbour_id for r in ivf_pq.neighbours(spark.createDataFrame(rows, SCHEMA), k=1).collect()}
    assert (nearest[1], nearest[2], nearest[5]) == (2, 1, 4)


def test_ties_and_repeated_ids(spark):
    """Many equal vectors and an id of many rows take no place from others; more lists than one, all of them probed."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 1.0, 0.0, 0.0], 0) for i in range(200, 0, -1)]
    rows += [(1000, [1.0, 1.0, 0.0, float(v)], 0) for v in rng.uniform(0.1, 0.2, 300)]
    rows += [(1001, [1.0, 1.0, 0.5, 0.0], 0)] + [(2000 + i, rng.normal(5, 1, 4).tolist(), 0) for i in range(200)]
    found = {}
    for r in ivf_pq.neighbours(spark.createDataFrame(rows, SCHEMA), k=201, probes=10**6).where("vec_id in (7, 1001)").orderBy("vec_id", "rank").collect():
        found.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert found[7] == [i for i in range(1, 201) if i != 7] + [1000, 1001]
    assert set(found[1001][:201]) == {*range(1, 201), 1000}


def test_a_list_that_holds_half_of_all_rows_is_cut():
    first, home = ivf_pq.cells_of(np.array([10, 500_000, 10, 250_000, 250_000]), 8)
    assert first[2] - first[1] >= 8 and len(home) == first[-1] and set(home) == set(range(8)) and (np.diff(home) >= 0).all()
