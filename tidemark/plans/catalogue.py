"""The registered queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import types
from tidemark.engine import Engine
from tidemark.operators import fulltext, fusion, graph, lifecycle, timeseries, vector
from tidemark.plans import lowering
from tidemark.plans.lowering import Predicate
from tidemark.plans.sqlparse import parse
from tidemark.types import Column

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> Engine:
    """An engine in a new folder under the shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    return Engine(spark, f"{root.rstrip('/')}/tidemark-store-{uuid.uuid4().hex}")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def statement(name: str, text: str, sql: str) -> None:
    """A query of the dialect over one of the driver's tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tree = parse(text)
        return lowering.select(_table(spark, sf_dir, tree.table), tree, ordered=False)[1]

    QUERIES[name], SQL[name] = run, sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q40_hybrid"](spark, sf_dir)


# --- scans, projection, filters, order, limit

statement("q01_scan_all", "SELECT * FROM nation", "SELECT * FROM nation")
statement("q02_project", "SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, c_name FROM customer")
statement("q03_eq_int", "SELECT * FROM orders WHERE o_orderkey = 7", "SELECT * FROM orders WHERE o_orderkey = 7")
statement("q04_eq_text", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
statement("q05_lt_int", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 3", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 3")
statement("q06_gt_int", "SELECT p_partkey, p_size FROM part WHERE p_size > 40", "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
statement("q07_gt_text", "SELECT c_name FROM customer WHERE c_name > 'Customer#000000500'", "SELECT c_name FROM customer WHERE c_name > 'Customer#000000500'")
statement("q08_lt_ts", "SELECT event_id, user_id FROM events WHERE ts < 1704844800000000", "SELECT event_id, user_id FROM events WHERE ts < make_timestamp(1704844800000000)")
statement("q09_order_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice LIMIT 100", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey LIMIT 100")
statement("q10_order_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 100", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
statement("q12_limit", "SELECT o_orderkey FROM orders LIMIT 25", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
statement("q13_topk", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey < 100 ORDER BY o_totalprice DESC LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey < 100 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
statement("q14_limit0", "SELECT o_orderkey, o_custkey FROM orders LIMIT 0", "SELECT o_orderkey, o_custkey FROM orders LIMIT 0")


@query("q11_order_nulls", "SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE toxic END AS toxic FROM labels ORDER BY toxic NULLS FIRST, doc_id LIMIT 200")
def order_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _scratch(spark)
    e.create_table("t", [Column("doc_id", types.INT8), Column("toxic", types.INT4)])
    rows = _table(spark, sf_dir, "labels").orderBy("doc_id")
    e.load("t", rows.select("doc_id", F.when(F.col("toxic") == 0, 0).alias("toxic")))
    return e.exec("SELECT doc_id, toxic FROM t ORDER BY toxic LIMIT 200")


# --- inserts, updates, deletes

ROWS = "(1, 'a'), (2, 'it''s'), (NULL, 'c'), (-4, NULL)"


@query("q15_insert_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'it''s'), (NULL, 'c'), (-4, NULL)) AS t(id, name)")
def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _scratch(spark)
    e.exec("CREATE TABLE t (id INT, name TEXT)")
    e.exec(f"INSERT INTO t VALUES {ROWS}")
    return e.exec("SELECT * FROM t")


@query("q16_insert_collist", "SELECT * FROM (VALUES (CAST(NULL AS BIGINT), 'x', 3), (NULL, 'y', 4)) AS t(a, b, c)")
def insert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _scratch(spark)
    e.exec("CREATE TABLE t (a BIGINT, b TEXT, c INT)")
    e.exec("INSERT INTO t (c, B, c) VALUES (1, 'x', 3), (2, 'y', 4)")
    return e.exec("SELECT * FROM t")


CUSTOMER = [Column("c_custkey", types.INT8), Column("c_name", types.TEXT), Column("c_nationkey", types.INT4), Column("c_mktsegment", types.TEXT)]
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> Engine:
    e = _scratch(spark)
    e.create_table("customer", CUSTOMER)
    e.load("customer", _table(spark, sf_dir, "customer"))
    return e


@query("q17_update_where", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_name END AS c_name, c_nationkey, c_mktsegment FROM customer")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    e.exec("UPDATE customer SET c_name = 'MOVED' WHERE c_nationkey = 3")
    return e.exec("SELECT * FROM customer")


@query("q18_delete_where", f"{CUSTOMER_SQL} WHERE NOT c_custkey > 700")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    e.exec("DELETE FROM customer WHERE c_custkey > 700")
    return e.exec("SELECT * FROM customer")


@query("q19_update_all", "SELECT c_custkey, c_name, CAST(9 AS INTEGER) AS c_nationkey, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def update_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    e.exec("UPDATE customer SET c_nationkey = 9, c_mktsegment = NULL")
    return e.exec("SELECT * FROM customer")


# --- indexes

ORDERS = [Column("o_orderkey", types.INT8), Column("o_custkey", types.INT8), Column("o_orderstatus", types.TEXT)]


def _orders(spark: SparkSession, sf_dir: str) -> Engine:
    e = _scratch(spark)
    e.create_table("orders", ORDERS)
    e.load("orders", _table(spark, sf_dir, "orders"))
    e.create_index("orders", "o_custkey")
    return e


@query("q20_index_point", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7")
def index_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).rows_by_index("orders", "o_custkey", 7, 8)


@query("q21_index_dups", "SELECT l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey < 500 GROUP BY l_orderkey")
def index_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _scratch(spark)
    e.create_table("lineitem", [Column("l_orderkey", types.INT8), Column("l_linenumber", types.INT4)])
    e.load("lineitem", _table(spark, sf_dir, "lineitem"))
    e.create_index("lineitem", "l_orderkey")
    return e.range_scan("lineitem", "l_orderkey", None, 500).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("q22_index_range_half_open", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey >= 10 AND o_custkey < 20")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).rows_by_index("orders", "o_custkey", 10, 20)


@query("q23_index_order", "SELECT key, row_number() OVER (ORDER BY key, o_orderkey) AS place FROM (SELECT o_custkey AS key, o_orderkey FROM orders WHERE o_custkey < 30)")
def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _orders(spark, sf_dir).range_scan("orders", "o_custkey", None, 30)
    return found.select("key", F.row_number().over(Window.orderBy("key", "_tid")).cast("long").alias("place"))


@query("q24_index_nulls_skipped", "SELECT count(*) FILTER (toxic = 0) AS entries, count(*) AS n_rows FROM labels")
def index_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _scratch(spark)
    e.create_table("t", [Column("doc_id", types.INT8), Column("toxic", types.INT4)])
    e.load("t", _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, 0).alias("toxic")))
    e.create_index("t", "toxic")
    entries, rows = e.index_scan("t", "toxic").agg(F.count(F.lit(1)).alias("entries")), e.scan("t").agg(F.count(F.lit(1)).alias("n_rows"))
    return entries.select("entries", F.lit(rows.first()[0]).alias("n_rows"))


@query("q25_index_after_dml", "SELECT o_orderkey, CASE WHEN o_custkey = 5 THEN 6 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders WHERE o_custkey > 1 AND o_custkey < 7")
def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    e.exec("UPDATE orders SET o_custkey = 6 WHERE o_custkey = 5")
    e.exec("DELETE FROM orders WHERE o_custkey < 2")
    return e.rows_by_index("orders", "o_custkey", None, 7)


# --- transactions and versions


@query("q26_txn_own_writes", f"{CUSTOMER_SQL} WHERE c_custkey < 50 UNION ALL SELECT -1, 'own', NULL, NULL")
def own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    with e.begin() as txn:
        e.exec("DELETE FROM customer WHERE c_custkey > 49", txn)
        e.exec("INSERT INTO customer (c_custkey, c_name) VALUES (-1, 'own')", txn)
        return e.exec("SELECT * FROM customer", txn)


@query("q27_snapshot_time_travel", CUSTOMER_SQL)
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    version = e.version
    e.exec("DELETE FROM customer")
    return e.scan("customer", version=version)


@query("q28_abort_invisible", CUSTOMER_SQL)
def abort_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    txn = e.begin()
    e.exec("UPDATE customer SET c_name = 'gone'", txn)
    txn.abort()
    return e.exec("SELECT * FROM customer")


# --- catalogue and compaction


@query("q29_catalog_class", "SELECT * FROM (VALUES ('customer', 'r', 4), ('customer_c_custkey_idx', 'i', 1), ('old', 'd', 1), ('pg_am', 'r', 2), ('pg_attribute', 'r', 7), ('pg_class', 'r', 6), ('pg_index', 'r', 5), ('pg_rust_relpages', 'r', 4), ('pg_type', 'r', 3)) AS t(relname, relkind, relnatts)")
def catalog_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _scratch(spark)
    e.create_table("customer", CUSTOMER)
    e.create_index("customer", "c_custkey")
    e.create_table("old", [Column("x", types.UUID)])
    e.drop_table("old")
    return e.catalog("pg_class").select("relname", "relkind", "relnatts")


@query("q30_catalog_attr", "SELECT * FROM (VALUES ('c_custkey', 20, 8, 1), ('c_name', 25, -1, 2), ('c_nationkey', 23, 4, 3), ('c_mktsegment', 25, -1, 4)) AS t(attname, atttypid, attlen, attnum)")
def catalog_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _scratch(spark)
    oid = e.create_table("customer", CUSTOMER)
    found = e.catalog("pg_attribute").filter(F.col("attrelid") == oid)
    return found.select("attname", F.col("atttypid").cast("int").alias("atttypid"), "attlen", "attnum")


@query("q31_dead_tuples", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def dead_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    e.exec("UPDATE customer SET c_name = 'MOVED' WHERE c_nationkey = 3")
    return e.dead_tuples("customer").select("c_custkey", "c_name")


@query("q47_vacuum", "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 100")
def vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _customers(spark, sf_dir)
    e.delete_where("customer", Predicate("c_custkey", ">", 99))
    e.vacuum("customer")
    return e.scan("customer").select("c_custkey", "c_name")


# --- vectors


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row."""
    return _table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def _vector_sql(expression: str, where: str = "") -> str:
    return (
        f"SELECT vec_id, round(d, 4) AS distance FROM (SELECT e.vec_id, {expression} AS d FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e,"
        f" (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) p {where}) ORDER BY d, vec_id LIMIT 10"
    )


def _nearest(metric: str, where: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = vector.nearest(_table(spark, sf_dir, "embeddings"), "embedding", _probe(spark, sf_dir), 10, metric, where=F.expr(where) if where else None)
        return found.select("vec_id", F.round("distance", 4).alias("distance"))

    return run


query("q32_vec_l2", _vector_sql("list_distance(v, q)"))(_nearest("l2"))
query("q33_vec_cosine", _vector_sql("list_cosine_distance(v, q)"))(_nearest("cosine"))
query("q34_vec_ip", _vector_sql("-list_inner_product(v, q)"))(_nearest("ip"))
query("q35_vec_filtered", _vector_sql("list_distance(v, q)", "WHERE e.label < 5"))(_nearest("l2", "label < 5"))



@query("q50_vec_cells", "SELECT 8 AS n_queries, true AS recall_reached")
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of the cell index against exact search, over eight queries: 0.9 or more. These vectors hardly cluster,
    so most cells are probed."""
    rows = _table(spark, sf_dir, "embeddings")
    cells = vector.Cells.fit(rows, "embedding")
    assigned = cells.assign(rows, "embedding")
    probes = [r["embedding"] for r in rows.filter("vec_id < 8").orderBy("vec_id").collect()]  # the stated query set
    hits = 0
    for probe in probes:
        exact = {r["vec_id"] for r in vector.nearest(rows, "embedding", probe, 10).collect()}
        hits += len(exact & {r["vec_id"] for r in cells.nearest(assigned, "embedding", probe, 10, 13).collect()})
    return spark.range(1).select(F.lit(len(probes)).alias("n_queries"), F.lit(hits >= 9 * len(probes)).alias("recall_reached"))


@query("q51_vec_cells_neighbours")
def vector_cells_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten neighbours by the cell index of every row whose id is divisible by 100, with the share of the exact ten that
    its query found. No SQL: what the cells leave out can't be said in it."""
    rows = _table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 100 = 0")
    cells = vector.Cells.fit(rows, "embedding")
    found = vector.nearest_of_each(cells.assign(rows, "embedding"), "embedding", asked, 10, cells, 13)
    exact = vector.nearest_of_each(rows, "embedding", asked, 10)
    hits = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return found.join(hits, "query_id").select("query_id", "vec_id", "distance", "recall")


# --- full text

TERMS = ["the", "of", "ertion"]
TOKENS_SQL = "SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS t FROM documents"
BM25_SQL = f"""
WITH d AS ({TOKENS_SQL}), s AS (SELECT doc_id, len(t) AS n, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{k}" for k, w in enumerate(TERMS))} FROM d),
c AS (SELECT count(*) AS n, avg(n) AS a, {", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(TERMS)))} FROM s)
SELECT doc_id, {" + ".join(f"ln(1 + (c.n - d{k} + 0.5) / (d{k} + 0.5)) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * s.n / c.a))" for k in range(len(TERMS)))} AS score
FROM s, c WHERE {" OR ".join(f"f{k} > 0" for k in range(len(TERMS)))}
"""


@query("q36_term_df", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM ({TOKENS_SQL})) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.document_frequency(_table(spark, sf_dir, "documents"), "text")


@query("q37_bm25", f"SELECT doc_id, round(score, 4) AS score FROM ({BM25_SQL}) ORDER BY round(score, 4) DESC, doc_id LIMIT 20")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fulltext.bm25(_table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return scored.select("doc_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("q48_postings", f"SELECT term, doc_id AS doc, count(*) AS tf, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM ({TOKENS_SQL})) WHERE term IN ('ertion', 'the') GROUP BY term, doc_id")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fulltext.postings(_table(spark, sf_dir, "documents"), "doc_id", "text").filter(F.col("term").isin("ertion", "the"))
    return found.select("term", "doc", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


# --- fusion


@query("q38_fuse_filter", f"SELECT doc_id, lang FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM ({TOKENS_SQL}) WHERE list_contains(t, 'ertion')) AND doc_id IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def fuse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    texts = docs.filter(fulltext.matches(F.col("text"), ["ertion"])).select("doc_id")
    vectors = _table(spark, sf_dir, "embeddings").filter("label < 5").select(F.col("vec_id").alias("doc_id"))
    return fusion.intersect(docs.filter("lang = 'en'"), [texts, vectors], "doc_id").select("doc_id", "lang")


def _rrf_sql(docs: str, vectors: str) -> str:
    return f"""
WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM ({BM25_SQL}) {docs} ORDER BY r LIMIT 50),
v AS (SELECT doc_id, row_number() OVER (ORDER BY d, doc_id) AS r FROM (SELECT e.vec_id AS doc_id, round(list_distance(e.v, p.q), 6) AS d FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e,
  (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) p) {vectors} ORDER BY r LIMIT 50)
SELECT doc_id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM v) GROUP BY doc_id ORDER BY round(sum(1.0 / (60 + r)), 6) DESC, doc_id LIMIT 20
"""


def _rrf(spark: SparkSession, sf_dir: str, allowed: DataFrame | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    texts = fulltext.bm25(docs, "doc_id", "text", TERMS).withColumn("score", F.round("score", 6))
    rows = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    if allowed is not None:  # the hard filter comes before ranking
        texts, rows = (x.join(allowed, "doc_id", "left_semi") for x in (texts, rows))
    vectors = vector.nearest(rows, "embedding", _probe(spark, sf_dir), None, "l2").select("doc_id", F.round("distance", 6).alias("distance"))
    paths = [(texts.orderBy(F.desc("score"), "doc_id").limit(50), "score", False), (vectors.orderBy("distance", "doc_id").limit(50), "distance", True)]
    fused = fusion.reciprocal_ranks(paths, "doc_id", 1 << 20)
    return fused.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("q39_rrf", _rrf_sql("", ""))
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rrf(spark, sf_dir)


ALLOWED = "WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id IN (SELECT vec_id FROM embeddings WHERE label < 8)"


@query("q40_hybrid", _rrf_sql(ALLOWED, ALLOWED))
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hard filter on language and label, then text and vector ranks fused."""
    labelled = _table(spark, sf_dir, "embeddings").filter("label < 8").select(F.col("vec_id").alias("doc_id"))
    allowed = fusion.intersect(_table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"), [labelled], "doc_id")
    return _rrf(spark, sf_dir, allowed)


# --- time series, graph, life cycle


@query("q41_ts_range", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def ts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.in_range(_table(spark, sf_dir, "events"), "ts", "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("event_id", "value")


@query("q42_ts_downsample", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS bucket, event_type, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS top FROM events GROUP BY ALL")
def ts_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = timeseries.downsample(events, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("top")])
    return found.withColumn("bucket", F.unix_seconds("bucket"))


@query("q43_ttl", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.retain(_table(spark, sf_dir, "events"), "ts", "2024-01-30 00:00:00", 7).select("event_id")


GRAPH_SQL = """
WITH RECURSIVE e AS (
  SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
w AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.node WHERE w.depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node
"""


@query("q44_graph_3hop", GRAPH_SQL)
def graph_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    to_nation = _table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    to_region = _table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    starts = spark.range(1).select(F.lit("c1").alias("node"))
    return graph.reach(to_nation.unionAll(to_region), starts, 3, directed=False)


@query("q45_forgetting", "SELECT user_id, round(s, 6) AS strength, CASE WHEN s >= 3 THEN 'hot' WHEN s >= 1 THEN 'warm' ELSE 'cold' END AS tier FROM (SELECT user_id, ln(1 + count(*)) * exp(-0.1 * date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01')) AS s FROM events GROUP BY user_id)")
def forgetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    age = F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("last"))
    scored = used.withColumn("s", lifecycle.strength(F.col("n"), age, 0.1))
    return scored.select("user_id", F.round("s", 6).alias("strength"), lifecycle.tier(F.col("s"), 3, 1).alias("tier"))


@query("q46_rls", "SELECT event_id, event_type FROM events WHERE user_id = 42")
def row_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.secured(_table(spark, sf_dir, "events"), 42, "user_id").select("event_id", "event_type")


@query("q49_quota", "SELECT user_id, count(*) AS n_rows FROM events GROUP BY user_id HAVING count(*) > 60")
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.over_quota(_table(spark, sf_dir, "events"), 60, "user_id")
