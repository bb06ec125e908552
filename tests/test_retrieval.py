import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.errors import InvalidArgument
from tidemark.functions import text
from tidemark.operators import fulltext, fusion, graph, lifecycle, timeseries, vector
from tidemark.plans import catalogue
from tidemark.sources.external import read_files, write_files
from tidemark.streaming.maintenance import IndexFollower, downsample_stream


def test_nearest(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 1.0])], "vec_id long, e array<float>")
    assert [(r.vec_id, r.distance) for r in vector.nearest(df, "e", [0, 0], 3).collect()] == [(1, 0.0), (3, 1.0), (5, 1.0)]
    assert [r.vec_id for r in vector.nearest(df, "e", [3, 4], 2, "cosine").collect()] == [2, 3]  # a vector without length has no cosine
    assert [r.vec_id for r in vector.nearest(df, "e", [3, 4], 1, "ip").collect()] == [2]
    assert [r.vec_id for r in vector.nearest(df, "e", [0, 0], 1, where=F.col("vec_id") > 1).collect()] == [3]
    with pytest.raises(InvalidArgument):
        vector.nearest(df, "e", [0], 1, "hamming")


def test_cells(spark):
    rows = [(k, [math.cos(k / 7), math.sin(k / 7), k % 5 / 5]) for k in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>")
    cells = vector.Cells.fit(df, "e", cells=6)
    assigned = cells.assign(df, "e")
    assert assigned.count() == 201 and assigned.filter("cell IS NULL").count() == 0
    exact = [r.vec_id for r in vector.nearest(df, "e", rows[3][1], 5).collect()]
    assert [r.vec_id for r in cells.nearest(assigned, "e", rows[3][1], 5, 6).collect()] == exact
    assert len(set(exact) & {r.vec_id for r in cells.nearest(assigned, "e", rows[3][1], 5, 3).collect()}) >= 4
    assert vector.Cells.fit(df.limit(0), "e").centroids == ()


DOCS = [(1, "a b a c"), (2, "b c"), (3, None), (4, "D a")]


def test_fulltext(spark):
    df = spark.createDataFrame(DOCS, "id long, t string")
    found = {(r.term, r.doc): (r.tf, r.positions) for r in fulltext.postings(df, "id", "t").collect()}
    assert found["a", 1] == (2, [0, 2]) and found["d", 4] == (1, [0]) and len(found) == 7
    assert {r.term: r.df for r in fulltext.document_frequency(df, "t").collect()} == {"a": 2, "b": 2, "c": 2, "d": 1}
    scores = {r.id: r.score for r in fulltext.bm25(df, "id", "t", ["a"]).collect()}
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    assert set(scores) == {1, 4} and math.isclose(scores[1], idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / 2)))
    assert [r.id for r in fulltext.bm25(df, "id", "t", ["zzz"]).collect()] == []
    assert df.filter(fulltext.matches(F.col("t"), ["a", "c"], every=True)).count() == 1
    stem = text.stemmed(text.without(text.words, frozenset({"the"})))
    assert spark.range(1).select(stem(F.lit("The linked links sing"))).first()[0] == ["link", "link", "sing"]


def test_fusion(spark):
    one = spark.createDataFrame([(1, 9.0), (2, 5.0)], "id long, s double")
    two = spark.createDataFrame([(2, 0.1), (3, 0.2)], "id long, d double")
    fused = {r.id: r.score for r in fusion.reciprocal_ranks([(one, "s", False), (two, "d", True)], "id", 10).collect()}
    assert fused == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})
    assert [r.id for r in fusion.intersect(spark.range(5), [one, two], "id").collect()] == [2]
    assert fusion.explain([("text", one), ("vector", two)]).count("Physical Plan") == 2


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.reach(edges, starts, 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node: r.depth for r in graph.reach(edges, starts, 1, directed=False).collect()} == {"a": 0, "b": 1, "c": 1}


def test_time_series_and_life_cycle(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(id) AS ts, id FROM range(10)")
    assert timeseries.in_range(df, "ts", "2024-01-03", "2024-01-05").count() == 2
    assert timeseries.retain(df, "ts", "2024-01-10", 2).count() == 3
    timeseries.write_by_day(df, "ts", str(tmp_path / "days"))
    back = spark.read.parquet(str(tmp_path / "days"))
    assert back.count() == 10 and "PartitionFilters: [isnotnull(day" in back.filter("day = date '2024-01-02'")._jdf.queryExecution().toString()
    assert spark.range(1).select(lifecycle.strength(F.lit(1), F.lit(0), 1.0), lifecycle.tier(F.lit(2), 3, 1)).first() == (pytest.approx(math.log(2)), "warm")


def test_external_files(spark, tmp_path):
    df = spark.range(3).selectExpr("id", "cast(id AS string) AS s", "id AS _tid")
    for kind in ("parquet", "csv", "json", "orc"):
        write_files(df, str(tmp_path / kind), kind)
        back = read_files(spark, str(tmp_path / kind), kind, schema="id long, s string")
        assert sorted(map(tuple, back.collect())) == [(0, "0"), (1, "1"), (2, "2")]
    with pytest.raises(InvalidArgument):
        read_files(spark, "x", "csv")


def test_index_follows_the_log(spark, root, tmp_path):
    e = Engine(spark, root)
    e.exec("CREATE TABLE t (k INT)")
    e.exec("INSERT INTO t VALUES (1), (2), (2)")
    follower = IndexFollower(e, "t", "k", str(tmp_path / "index"))
    assert follower.lag() == e.version and follower.lookup(2).count() == 2  # nothing applied: a plain scan
    follower.start().awaitTermination()
    assert follower.lag() == 0
    e.exec("INSERT INTO t VALUES (2)")
    e.exec("DELETE FROM t WHERE k = 1")
    assert follower.lag() == 2 and follower.lookup(2).count() == 3 and follower.lookup(1).count() == 0
    follower.start().awaitTermination()
    assert follower.lag() == 0 and follower.lookup(2).count() == 3


def test_stream_downsampling(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts, id AS v FROM range(10)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, v long").parquet(str(tmp_path / "in"))
    out = downsample_stream(stream, "ts", "6 hours", "1 hour", [], [F.sum("v").alias("v")])
    query = out.writeStream.format("memory").queryName("down").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.v for r in spark.table("down").collect()) == [15, 30]


def test_pushdown(spark):
    from tidemark.plans import catalogue

    plan = catalogue.QUERIES["q13_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), LessThan(o_custkey,100)]" in plan and "TakeOrderedAndProject" in plan
    assert "o_orderdate" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_neighbours_of_each_stated_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], 0) for k in range(1500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["q51_vec_cells_neighbours"](spark, str(tmp_path)).collect()
    total = 0
    for q in range(0, 1500, 100):
        exact = [i for _, i in sorted((math.dist(rows[q][1], v), i) for i, v, _ in rows)[:10]]
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == 10 and all(r.distance == pytest.approx(math.dist(rows[q][1], rows[r.vec_id][1])) for r in mine)
        hits = len({r.vec_id for r in mine} & set(exact))
        assert {r.recall for r in mine} == {hits / 10}
        total += hits
    assert total >= 9 * 15 and len(got) == 150
    source = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    some = vector.nearest_of_each(source, "embedding", source.filter("vec_id < 7"), 3, block=3).collect()  # several blocks
    assert {(r.query_id, r.vec_id) for r in some} == {(q, i) for q in range(7) for _, i in sorted((math.dist(rows[q][1], v), i) for i, v, _ in rows)[:3]}


def test_hard_filter_comes_before_the_nearest(spark, tmp_path):
    first, more = 1 << 20, 30  # rows that are allowed lie behind more than a million that are not
    allowed = (F.col("id") == 0) | (F.col("id") > first)
    rows = spark.range(first + more + 1)
    vectors = rows.select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"), F.when(allowed, 1).otherwise(9).alias("label"))
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows.filter(allowed).select(F.col("id").alias("doc_id"), F.lit("nothing").alias("text"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in catalogue.QUERIES["q40_hybrid"](spark, str(tmp_path)).collect()] == [0, *range(first + 1, first + 20)]
