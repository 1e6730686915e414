"""Element-wise pools by brute force."""

from quillstrand import catalogue
from quillstrand.operators import relations


def test_all_places(spark):
    rows = [("a", 2, [1.0, -5.0, 3.0]), ("a", 1, [4.0, 2.0, -3.0]), ("a", 3, [-2.0, 0.0, 6.0]), ("b", 9, [7.0, 8.0, 9.0])]
    made = {r["g"]: r for r in relations.pool(spark.createDataFrame(rows, "g string, k int, v array<float>"), "g", "v", "k").collect()}
    for g in "ab":
        vectors = [v for _, v in sorted((k, v) for n, k, v in rows if n == g)]
        across = list(zip(*vectors))
        want = {"mean": [sum(x) / len(x) for x in across], "max": [max(x) for x in across], "min": [min(x) for x in across], "cls": vectors[0], "final": vectors[-1]}
        assert {n: made[g][n] for n in relations.POOLS} == want


def test_query_shows_all_places(spark):
    got = catalogue.queries()["pool_vectors"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["label"], r["dim"]) for r in got} == {(k, i) for k in range(10) for i in range(64)}
