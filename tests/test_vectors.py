"""Queries on vectors and parts against their SQL, on tables made for the case."""

import duckdb

from voxelia import registry


def against_sql(spark, folder, table, rows, schema, *names):
    """Whether each query gives the rows of its SQL over one made table."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    for name in names:
        df = registry.QUERIES[name](spark, str(folder))
        columns = ", ".join(sorted(df.columns))
        want = con.execute(f"SELECT {columns} FROM ({registry.SQL[name]})").fetchall()
        assert want and sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) == sorted(want, key=repr), name


def test_prefix_match_without_pairs(spark, tmp_path):
    """Sizes of few and of many parts, and parts without a size or a name: those without a size come last."""
    sizes = [None, 1, 1, 1, 4, 4, 9, 30]
    rows = [(k, None if k % 17 == 3 else ("rust", "blue", "rosy")[k * k % 3] + str(k), 77 if k == 100 else None if k % 5 == 4 else sizes[k * 7 % 8]) for k in range(400)]
    against_sql(spark, tmp_path, "part", rows, "p_partkey long, p_name string, p_size int", "prefix_match_ap")


def test_cells_of_scans_are_dealt_out(spark, monkeypatch):
    """Patients in one file are one task's rows, but not their cells."""
    from pyspark.sql import functions as F

    from voxelia.plans import rasters

    monkeypatch.setattr(rasters, "TASK_CELLS", 500, raising=False)
    cells = rasters.made_cells(spark.range(100).select(F.col("id").alias("pid")).coalesce(1), 1, 1, 10, 10)
    assert cells.count() == 10000 and max(r["count"] for r in cells.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 2500


def test_precision_with_few_relevant_rows(spark, tmp_path):
    """Labels with no other row, with all their rows among the ten nearest, and with none of them there; no sort of all pairs."""
    rows = [(k, [float((k * k * 7 + j * 5) % 23 + 1 + (k % 50 == 0 and j == k // 50)) for j in range(64)], 100 + k if k == 50 else k // 50 % 3 + (3 if k % 50 < 2 else 7 if k == 149 else 0)) for k in range(260)]
    against_sql(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int", "retrieval_precision_at_10")
    plan = registry.QUERIES["retrieval_precision_at_10"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "sim" not in plan or "MapInPandas" in plan


def test_ranking_in_ranges(spark, tmp_path, monkeypatch):
    """Copies of one vector over several parts and ranges, missing labels, ids and vectors; no sort of all pairs in the JVM."""
    from voxelia.operators import ranking

    for name, size in (("QUERIES", 2), ("PART", 40), ("RANGE", 90), ("SAMPLE", 60)):
        monkeypatch.setattr(ranking, name, size)
    vector = lambda k: [float((k * k * 7 + j * 5) % 23 + (k % 50 == 0 and j == k // 50) - 9) for j in range(64)]
    rows = [(k, vector(1 if 60 < k < 170 else k) if k % 41 else None if k % 82 else [0.0] * 64, None if k % 29 == 7 else k * k % 5) for k in range(400)]
    against_sql(spark, tmp_path, "embeddings", rows + [(None, vector(1000), 1)], "vec_id long, embedding array<float>, label int", "full_ranking", "retrieval_average_precision")
    emb = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    runs = ranking.runs(emb.where("vec_id % 50 = 0"), emb)
    held = runs.groupBy("q", "range").agg({"n": "sum"}).collect()
    assert len(held) > 8 and max(r["sum(n)"] for r in held) <= 150
    assert "row_number" not in registry.QUERIES["full_ranking"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_those_of_sums_in_order():
    import numpy as np

    from voxelia.operators import ranking

    g = np.random.default_rng(3)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (g.normal(size=(100, 64)), g.normal(size=(3000, 64))))
    sums = np.zeros((100, 3000))
    for i in range(64):
        sums += a[:, i, None] * b[:, i]
    v = sums * 1e12
    assert (ranking.places(a, b.T) == ranking.MIDDLE - np.trunc(v + np.copysign(0.5, v))).all()


def clustered(spark, folder):
    """200 rows in four directions, the label of every fiftieth being its own."""
    rows = [(k, [float(j == k % 4) + (k * 3 + j * 5) % 7 / 100 for j in range(64)], 10 + k if k % 50 == 0 else k % 4) for k in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


def test_votes_of_every_fifth_row(spark, tmp_path):
    clustered(spark, tmp_path)
    assert sorted(r.q for r in registry.QUERIES["knn_weighted_vote"](spark, str(tmp_path)).collect()) == list(range(0, 200, 5))


def test_accuracy_over_every_fifth_row(spark, tmp_path):
    """Four of the 40 queries have a label of their own, which no neighbour can give."""
    clustered(spark, tmp_path)
    assert [tuple(r) for r in registry.QUERIES["knn_accuracy"](spark, str(tmp_path)).where("k < 100").orderBy("k").collect()] == [(10, 90.0, 90.0), (20, 90.0, 90.0)]


def test_ranking_of_every_twenty_fifth_row(spark, tmp_path):
    clustered(spark, tmp_path)
    found = registry.QUERIES["full_ranking"](spark, str(tmp_path)).groupBy("q").count().collect()
    assert sorted(map(tuple, found)) == [(q, 200) for q in range(0, 200, 25)]


def test_average_precision_of_every_twenty_fifth_row(spark, tmp_path):
    """Those with a label of their own have no relevant row."""
    clustered(spark, tmp_path)
    assert sorted(r.q for r in registry.QUERIES["retrieval_average_precision"](spark, str(tmp_path)).collect()) == [25, 75, 125, 175]


def test_precision_of_every_twenty_fifth_row(spark, tmp_path):
    clustered(spark, tmp_path)
    assert sorted(r.q for r in registry.QUERIES["retrieval_precision_at_10"](spark, str(tmp_path)).collect()) == [25, 75, 125, 175]


def test_ratio_of_every_twentieth_row(spark, tmp_path):
    """Every second query is reported, and those whose nearest row is a copy."""
    import numpy as np

    x = np.random.default_rng(5).normal(size=(200, 64))
    x[61] = x[60]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.q for r in registry.QUERIES["ratio_test"](spark, str(tmp_path)).collect()}
    assert found >= {0, 40, 60, 80, 120, 160} and all(q % 20 == 0 for q in found)


def test_ranking_shuffles_no_similarity(spark, tmp_path, monkeypatch):
    """Ranges held a few at a time give SQL's rows; of the plan only queries are shuffled."""
    import numpy as np

    from voxelia.operators import ranking

    for name, size in (("QUERIES", 3), ("PART", 40), ("RANGE", 90), ("SAMPLE", 60), ("HELD", 400)):
        monkeypatch.setattr(ranking, name, size, raising=False)
    x = np.random.default_rng(8).normal(size=(500, 64)).astype(np.float32)
    x[100:200] = x[25]
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)]
    against_sql(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int", "full_ranking", "retrieval_average_precision")
    plan = registry.QUERIES["full_ranking"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "FlatMapGroups" not in plan and not {"data", "junk"} & set(plan.replace("#", " ").split())
