"""System tables and the commit log as DataFrames. Their size is that of the metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import types
from tidemark.errors import TableNotFound
from tidemark.sources.table import State

# Object ids of the system tables and access methods, and the columns of the system tables.
SYSTEM_OIDS = {"pg_class": 1259, "pg_attribute": 1249, "pg_type": 1247, "pg_am": 2601, "pg_index": 2610, "pg_rust_relpages": 9021}
HEAP, BTREE = 2, 403
COLUMNS = {
    "pg_class": "oid long, relname string, relkind string, relnatts int, reltoastrelid long, relam long",
    "pg_attribute": "attrelid long, attname string, atttypid long, attlen int, attnum int, attnotnull int, attnullable int",
    "pg_type": "oid long, typname string, typlen int",
    "pg_am": "oid long, amname string",
    "pg_index": "indexrelid long, indrelid long, indnatts int, indisunique int, indisprimary int",
    "pg_rust_relpages": "rel_oid long, first_page long, last_page long, page_count long",
}


def _system_columns(name: str) -> list[tuple[str, str]]:
    kind = {"long": types.INT8, "int": types.INT4, "string": types.TEXT}
    return [(c.split()[0], kind[c.split()[1]]) for c in COLUMNS[name].split(", ")]


def system_table(spark: SparkSession, state: State, name: str) -> DataFrame:
    if name not in COLUMNS:
        raise TableNotFound(name)
    rows: list[tuple] = []
    tables = list(state.tables.values())
    if name == "pg_class":
        rows = [(oid, n, "r", len(_system_columns(n)), None, HEAP) for n, oid in SYSTEM_OIDS.items()]
        rows += [(t.oid, t.name, "d" if t.dropped else "r", len(t.columns), 0, HEAP) for t in tables]
        rows += [(i.oid, i.name, "i", 1, 0, BTREE) for t in tables for i in t.indexes]
    elif name == "pg_attribute":
        listed = [(oid, _system_columns(n)) for n, oid in SYSTEM_OIDS.items()] + [(t.oid, [(c.name, c.type) for c in t.columns]) for t in tables if not t.dropped]
        rows = [(oid, n, *types.OIDS[kind], k, 0, 1) for oid, columns in listed for k, (n, kind) in enumerate(columns, 1)]
    elif name == "pg_type":
        rows = [(oid, kind, width) for kind, (oid, width) in types.OIDS.items()]
    elif name == "pg_am":
        rows = [(HEAP, "heap"), (BTREE, "btree")]
    elif name == "pg_index":
        rows = [(i.oid, t.oid, 1, 0, 0) for t in tables for i in t.indexes]
    else:  # files stand for pages
        rows = [(t.oid, 0, max(0, len(t.files) - 1), len(t.files)) for t in tables if not t.dropped]
    return spark.createDataFrame(rows, COLUMNS[name])


def log_frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    rows = [(e["version"], e["xid"], k, a["do"], a["oid"], a.get("path")) for e in entries for k, a in enumerate(e["actions"])]
    return spark.createDataFrame(rows, "version long, xid long, place int, action string, oid long, path string")
