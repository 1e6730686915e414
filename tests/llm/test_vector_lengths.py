"""Vectors of very many lengths, and of double precision."""

from quillstrand.llm import embedding_dedup


def test_no_length_is_left_out(spark, monkeypatch):
    seen, none = [], spark.sql("select 1L as rep, 1L as links, 1L as root where false")

    def links(classes, dims, threshold):
        seen.append(dims)
        return none

    monkeypatch.setattr(embedding_dedup, "_links_of", links)
    df = spark.range(1, 1006).selectExpr("explode(array(id, -id)) as vec_id", "id").selectExpr("vec_id", "transform(sequence(1, id), i -> cast(if(i = 1, vec_id, 1) as float)) as embedding")
    assert embedding_dedup.near_vectors(df).count() == 2010
    assert sorted(seen) == list(range(1, 1006))


def test_doubles_stay_doubles(spark):
    # 1e-300 is zero as a float, and its vector would link with nothing.
    a, b = [1.0, 0.0], [1.0, 1e-9]
    rows = [(1, a), (2, b), (3, [1e-300, 0.0]), (4, [0.0, 1.0])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == {1: 2, 2: 2, 3: 2, 4: 0}
    assert {k: r["component_id"] for k, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4}
