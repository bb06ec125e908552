"""The engine: statements and a typed interface over versioned tables, with snapshots, transactions and locks.

A transaction pins one version. Its writes are staged as files and become visible to others when one log entry names
them; own staged files join the transaction's scans from its next statement on. UPDATE and DELETE write their targets
to a file before anything else reads it, so a statement never meets its own rows. A row that another transaction
changed after the snapshot raises TupleConcurrentlyUpdated; the first to commit wins.

Row locks are kept for up to ``ROW_LOCKS`` rows a statement; a statement with more targets takes the whole table
exclusively, so that lock memory stays bounded whatever the table's size."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalog, locks, types
from tidemark.errors import (
    DeadlockVictim, IndexExists, IndexNotFound, InvalidArgument, InvalidPredicate, TableExists, TableNotFound, TupleConcurrentlyUpdated, TupleNotFound, Unsupported,
)
from tidemark.plans import lowering
from tidemark.plans.lowering import TID, Predicate
from tidemark.plans.sqlparse import Condition, Control, CreateIndex, CreateTable, Delete, Insert, Select, Update, parse
from tidemark.sources import table as store
from tidemark.sources.commit_log import CommitLog
from tidemark.sources.table import Index, State, Table
from tidemark.types import Column

ROW_LOCKS = 10_000
NO_TRACE = "0" * 32


@dataclass
class _Staged:
    """What a transaction has written to one table."""

    files: list[tuple[str, int]] = field(default_factory=list)  # folder, next row id
    deletions: list[str] = field(default_factory=list)
    index_files: list[tuple[int, str]] = field(default_factory=list)


class Transaction:
    """A handle: commits or aborts once. As a context manager it commits at the end and aborts on an error; a handle
    that is dropped aborts."""

    def __init__(self, engine: Engine, xid: int, state: State):
        self.engine, self.xid, self.state = engine, xid, state
        self.command, self.open = 0, True
        self.staged: dict[int, _Staged] = {}

    def advance_command(self) -> int:
        """Later statements see what earlier ones wrote."""
        self.command += 1
        return self.command

    def table(self, name: str) -> Table:
        """The table as this transaction sees it: its snapshot and its own staged files."""
        found = self.state.named(name)
        if found is None:
            raise TableNotFound(name)
        own = self.staged.get(found.oid)
        if own is None:
            return found
        return replace(
            found, files=(*found.files, *(p for p, _ in own.files)), deletions=(*found.deletions, *((p, self.xid) for p in own.deletions)),
            indexes=tuple(replace(i, files=(*i.files, *(p for k, p in own.index_files if k == i.oid))) for i in found.indexes),
        )

    def commit(self) -> None:
        self.engine._commit(self)

    def abort(self) -> None:
        self.engine._abort(self)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.commit() if kind is None else self.abort()

    def __del__(self):
        if self.open:
            with contextlib.suppress(Exception):  # the session may have ended before
                self.abort()


class Engine:
    """A store in one folder. One process owns a folder at a time."""

    def __init__(self, spark: SparkSession, root: str, deadlock_tick: float = 0.1):
        self.spark, self.root, self.id = spark, root.rstrip("/"), uuid.uuid4().hex
        self.locks = locks.LockManager(deadlock_tick)
        self._log = CommitLog(spark, self.root)
        self._mutex = threading.RLock()
        self._active: dict[int, int] = {}  # transaction, its snapshot's version
        self._tids: dict[int, int] = {}
        self._bulk: dict[int, threading.RLock] = {}
        start, saved, entries = self._log.load()
        state = State.from_json(saved) if saved else State()
        self._states = {state.version: state}
        for entry in entries:
            state = state.after(entry)
            self._states[state.version] = state
        self._state, self._next_xid, self._next_oid = state, state.next_xid, state.next_oid

    # --- transactions

    def begin(self) -> Transaction:
        with self._mutex:
            xid, self._next_xid = self._next_xid, self._next_xid + 1
            self._active[xid] = self._state.version
            return Transaction(self, xid, self._state)

    def _own(self, txn: Transaction) -> None:
        if txn.engine is not self:
            raise InvalidArgument("the transaction belongs to another engine")
        if not txn.open:
            raise InvalidArgument("the transaction has ended")

    def _commit(self, txn: Transaction) -> None:
        self._own(txn)
        try:
            if txn.staged:
                self._check_conflicts(txn)
                self._publish(txn.xid, [a for oid, own in txn.staged.items() for a in self._actions(oid, own)], txn)
        finally:
            self._end(txn)

    @staticmethod
    def _actions(oid: int, own: _Staged) -> list[dict]:
        return (
            [{"do": "add", "oid": oid, "path": p, "next_tid": n} for p, n in own.files]
            + [{"do": "delete", "oid": oid, "path": p} for p in own.deletions]
            + [{"do": "add_index", "oid": oid, "index": k, "path": p} for k, p in own.index_files]
        )

    def _publish(self, xid: int, actions: list[dict], txn: Transaction | None = None) -> None:
        with self._mutex:
            if txn is not None:
                for oid in txn.staged:
                    if self._state.tables[oid].dropped:
                        raise TableNotFound(self._state.tables[oid].name)
            entry = {"xid": xid, "actions": actions}
            version = self._state.version + 1
            if not self._log.publish(version, entry):
                raise Unsupported("another process writes to this store")
            self._state = self._state.after(entry | {"version": version})
            self._states[version] = self._state

    def _abort(self, txn: Transaction) -> None:
        if txn.open:
            self._end(txn)
            for own in txn.staged.values():  # these are in no entry
                self._delete_folders([p for p, _ in own.files] + own.deletions + [p for _, p in own.index_files])

    def _end(self, txn: Transaction) -> None:
        txn.open = False
        with self._mutex:
            self._active.pop(txn.xid, None)
        self.locks.release_all(txn.xid)

    def _check_conflicts(self, txn: Transaction) -> None:
        """First committer wins: no row that this transaction deletes may have been deleted since its snapshot."""
        for oid, own in txn.staged.items():
            if own.deletions:
                mine = store.deleted_ids(self.spark, tuple((p, txn.xid) for p in own.deletions))
                self._refuse_changed(txn, oid, mine)

    def _refuse_changed(self, txn: Transaction, oid: int, ids: DataFrame) -> None:
        before, now = txn.state.tables[oid], self._state.tables[oid]
        known = set(before.deletions)
        later = tuple(d for d in now.deletions if d not in known)
        if later and ids.join(store.deleted_ids(self.spark, later), TID, "left_semi").limit(1).count():
            raise TupleConcurrentlyUpdated(f"a row of {now.name} was changed after this transaction's snapshot")

    def active_xids(self) -> list[int]:
        with self._mutex:
            return sorted(self._active)

    # --- statements

    def exec(self, sql: str, txn: Transaction | None = None) -> DataFrame | int | None:
        """Runs one statement: a DataFrame for SELECT, a count for INSERT, UPDATE and DELETE, None for definitions."""
        statement = parse(sql)
        if isinstance(statement, Control):
            raise Unsupported("transactions begin with Engine.begin()")
        if txn is not None:
            self._own(txn)
            if isinstance(statement, (CreateTable, CreateIndex)):
                raise Unsupported("definitions don't run inside a transaction")
            return self._run(statement, txn)
        if isinstance(statement, CreateTable):
            self.create_table(statement.table, [Column(n, t) for n, t in statement.columns])
            return None
        if isinstance(statement, CreateIndex):
            self.create_index(statement.table, statement.column)
            return None
        if isinstance(statement, Select) and statement.lock is None:
            return lowering.select(self._frame(statement.table), statement, ordered=False)[1]
        with self.begin() as own:
            return self._run(statement, own)

    def _run(self, statement, txn: Transaction) -> DataFrame | int:
        table = txn.table(statement.table)
        plain = isinstance(statement, Select) and statement.lock is None
        self._lock_table(txn, table, locks.ACCESS_SHARE if plain else locks.ROW_EXCLUSIVE)
        txn.advance_command()
        if isinstance(statement, Select):
            rows, picked = lowering.select(store.frame(self.spark, table), statement, ordered=not plain)
            if statement.lock:
                self._lock_rows(txn, table, rows, statement.lock)
            return picked
        if isinstance(statement, Insert):
            return self._insert(txn, table, [self._row(table, statement.columns, r) for r in statement.rows])
        if isinstance(statement, Update):
            sets = {}
            for name, value in statement.sets:  # the last of repeated columns counts
                column = self._column(table, name)
                sets[column.name] = types.bind_literal(value, column.type)
            return self._update(txn, table, statement.where, sets)
        if isinstance(statement, Delete):
            return self._delete(txn, table, statement.where)
        raise Unsupported(type(statement).__name__)

    @staticmethod
    def _column(table: Table, name: str) -> Column:
        for column in table.columns:
            if column.name == name.lower():
                return column
        raise InvalidPredicate(f"no column {name!r} in {table.name}")

    def _row(self, table: Table, names: Sequence[str] | None, values: Sequence) -> tuple:
        """A row of literals, in the table's order; columns not named are null, of repeated names the last counts."""
        columns = [self._column(table, n) for n in names] if names is not None else list(table.columns)
        if len(columns) != len(values):
            raise InvalidArgument(f"{len(columns)} columns, {len(values)} values")
        given = {c.name: types.bind_literal(v, c.type) for c, v in zip(columns, values, strict=True)}
        return tuple(given.get(c.name) for c in table.columns)

    # --- locks

    def _lock_table(self, txn: Transaction, table: Table, mode: str) -> None:
        try:
            self.locks.acquire(txn.xid, (table.oid,), mode)
        except DeadlockVictim:
            txn.abort()
            raise
        if self._state.tables[table.oid].dropped:  # it may have gone while this waited
            raise TableNotFound(table.name)

    def _lock_rows(self, txn: Transaction, table: Table, rows: DataFrame, mode: str) -> None:
        """Locks the rows in their order; refuses rows that others changed since the snapshot."""
        ids = [r[0] for r in rows.select(TID).limit(ROW_LOCKS + 1).collect()]
        if len(ids) > ROW_LOCKS:
            self._lock_table(txn, table, locks.EXCLUSIVE)
        else:
            try:
                for tid in ids:
                    self.locks.acquire(txn.xid, (table.oid, tid), mode)
            except DeadlockVictim:
                txn.abort()
                raise
        if self._state.version != txn.state.version:
            self._refuse_changed(txn, table.oid, rows.select(TID))

    # --- writing

    def _folder(self, table: Table, kind: str) -> str:
        return f"{self.root}/data/{table.oid}/{kind}-{uuid.uuid4().hex}"

    def _take_tids(self, table: Table, count: int) -> int:
        with self._mutex:
            first = max(self._tids.get(table.oid, 0), self._state.tables[table.oid].next_tid)
            self._tids[table.oid] = first + count
            return first

    def _stage_rows(self, txn: Transaction, table: Table, rows: DataFrame, ids: int | None = None) -> None:
        """``rows`` has the table's columns in order; row ids ascend with the partitions. ``ids``: the number of rows, if they are
        few and in one partition; else the next id is read from the files' statistics, and bulk writes to a table queue."""
        if ids is None:
            with self._mutex:
                queue = self._bulk.setdefault(table.oid, threading.RLock())
            with queue:
                path = self._write_rows(txn, table, rows, self._take_tids(table, 0))
                top = store.read(self.spark, table.schema, (path,)).agg(F.max(TID)).first()[0]
                after = self._take_tids(table, 0) if top is None else top + 1
                with self._mutex:
                    self._tids[table.oid] = after
        else:
            with self._mutex:
                queue = self._bulk.setdefault(table.oid, threading.RLock())
            with queue:
                first = self._take_tids(table, ids)
            path, after = self._write_rows(txn, table, rows, first), first + ids
        own = txn.staged.setdefault(table.oid, _Staged())
        own.files.append((path, after))
        written = store.read(self.spark, table.schema, (path,))
        for index in table.indexes:
            to = self._folder(table, "index")
            self._sorted_entries(written, index.column).write.parquet(to)
            own.index_files.append((index.oid, to))

    def _write_rows(self, txn: Transaction, table: Table, rows: DataFrame, first: int) -> str:
        full = rows.select(
            *[F.col(f"`{c.name}`") for c in table.columns], (F.lit(first) + F.monotonically_increasing_id()).alias(TID), F.lit(txn.xid).cast("long").alias("_xmin"),
            F.lit(txn.command).cast("int").alias("_cid"), F.lit(0).cast("long").alias("_agent_id") if "_agent_id" not in rows.columns else F.col("_agent_id"),
            F.lit(NO_TRACE).alias("_trace_id") if "_trace_id" not in rows.columns else F.col("_trace_id"),
        )
        path = self._folder(table, "rows")
        full.write.parquet(path)
        return path

    @staticmethod
    def _sorted_entries(rows: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
        entries = rows.select(F.col(f"`{column}`").alias("_key"), TID).filter(F.col("_key").isNotNull())
        if partitions:
            entries = entries.repartitionByRange(partitions, "_key", TID)  # the row id splits a key that very many rows share
        return entries.sortWithinPartitions("_key", TID)

    def _insert(self, txn: Transaction, table: Table, rows: list[tuple]) -> int:
        schema = [c.field for c in table.columns]
        made = self.spark.createDataFrame(rows, types.T.StructType(schema)).coalesce(1)
        self._stage_rows(txn, table, made, len(rows))
        return len(rows)

    def _update(self, txn: Transaction, table: Table, where: Condition | Predicate | None, sets: dict) -> int:
        rows = lowering.filtered(store.frame(self.spark, table), where)
        return self._replace(txn, table, rows, sets)

    def _replace(self, txn: Transaction, table: Table, rows: DataFrame, sets: dict) -> int:
        path = self._write_targets(txn, table, rows)
        targets = store.read(self.spark, table.schema, (path,))
        count = targets.count()
        if count:
            kinds = {c.name: c.field.dataType for c in table.columns}
            changed = targets.withColumns({n: F.lit(v).cast(kinds[n]) for n, v in sets.items()})
            self._stage_rows(txn, table, changed)
            txn.staged[table.oid].deletions.append(path)
        return count

    def _write_targets(self, txn: Transaction, table: Table, rows: DataFrame) -> str:
        path = self._folder(table, "targets")
        rows.write.parquet(path)
        self._lock_rows(txn, table, self.spark.read.schema(rows.schema).parquet(path), locks.UPDATE)
        return path

    def _delete(self, txn: Transaction, table: Table, where: Condition | Predicate | None) -> int:
        rows = lowering.filtered(store.frame(self.spark, table), where).select(TID)
        path = self._write_targets(txn, table, rows)
        count = self.spark.read.schema(rows.schema).parquet(path).count()
        if count:
            txn.staged.setdefault(table.oid, _Staged()).deletions.append(path)
        return count

    # --- typed interface

    def _auto(self, txn: Transaction | None, name: str, mode: str, action):
        if txn is not None:
            self._own(txn)
            table = txn.table(name)
            self._lock_table(txn, table, mode)
            txn.advance_command()
            return action(txn, table)
        with self.begin() as own:
            return self._auto(own, name, mode, action)

    def create_table(self, name: str, columns: Sequence[Column]) -> int:
        if not name or not columns:
            raise InvalidArgument("a table needs a name and columns")
        folded = [Column(c.name.lower(), c.type) for c in columns]
        if len({c.name for c in folded}) != len(folded) or any(c.name.startswith("_") for c in folded):
            raise InvalidArgument("column names are distinct and don't begin with an underscore")
        with self._mutex:
            if self._state.named(name):
                raise TableExists(name)
            oid, self._next_oid = self._next_oid, self._next_oid + 1
            xid, self._next_xid = self._next_xid, self._next_xid + 1
            self._publish(xid, [{"do": "create_table", "oid": oid, "name": name.lower(), "columns": [{"name": c.name, "type": c.type} for c in folded]}])
            return oid

    def drop_table(self, name: str) -> None:
        with self.begin() as txn:
            table = txn.table(name)
            self._lock_table(txn, table, locks.ACCESS_EXCLUSIVE)
            self._publish(txn.xid, [{"do": "drop_table", "oid": table.oid}])
            self._active.pop(txn.xid, None)
            self.reclaim(table.oid)

    def create_index(self, name: str, column: str) -> int:
        """A range-partitioned, sorted projection (key, row id) of all committed rows; waits for writers and holds them off."""
        with self.begin() as txn:
            self._lock_table(txn, txn.table(name), locks.EXCLUSIVE)
            table = self._state.tables[txn.table(name).oid]  # with all that was committed before the lock was granted
            found = self._column(table, column)
            if found.type not in types.INDEXABLE:
                raise InvalidArgument(f"{found.type} can't be indexed")
            if table.index_on(found.name):
                raise IndexExists(f"{table.name}_{found.name}_idx")
            with self._mutex:
                oid, self._next_oid = self._next_oid, self._next_oid + 1
            path = self._folder(table, "index")
            self._sorted_entries(store.frame(self.spark, table), found.name, int(self.spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
            self._publish(txn.xid, [{"do": "create_index", "oid": table.oid, "index": oid, "name": f"{table.name}_{found.name}_idx", "column": found.name, "files": [path]}])
            return oid

    def insert(self, name: str, rows: Iterable[Sequence], txn: Transaction | None = None) -> int:
        """Typed rows in the table's column order."""
        rows = list(rows)

        def action(own: Transaction, table: Table) -> int:
            made = []
            for row in rows:
                if len(row) != len(table.columns):
                    raise InvalidArgument(f"{len(table.columns)} columns, {len(row)} values")
                made.append(tuple(types.check_value(v, c.type) for v, c in zip(row, table.columns, strict=True)))
            return self._insert(own, table, made) if made else 0

        return self._auto(txn, name, locks.ROW_EXCLUSIVE, action)

    def load(self, name: str, rows: DataFrame, txn: Transaction | None = None) -> None:
        """Bulk insert of a DataFrame with the table's columns by name; it may carry _agent_id and _trace_id."""

        def action(own: Transaction, table: Table) -> None:
            lower = {c.lower(): c for c in rows.columns}
            if missing := [c.name for c in table.columns if c.name not in lower]:
                raise InvalidArgument(f"no columns {missing}")
            hidden = [c for c in ("_agent_id", "_trace_id") if c in rows.columns]
            cast = [F.col(f"`{lower[c.name]}`").cast(c.field.dataType).alias(c.name) for c in table.columns]
            self._stage_rows(own, table, rows.select(*cast, *hidden))

        self._auto(txn, name, locks.ROW_EXCLUSIVE, action)

    def _frame(self, name: str, txn: Transaction | None = None, version: int | None = None) -> DataFrame:
        if txn is not None:
            return store.frame(self.spark, txn.table(name))
        state = self._state if version is None else self._states.get(version)
        if state is None:
            raise InvalidArgument(f"no version {version}")
        table = state.named(name)
        if table is None:
            raise TableNotFound(name)
        return store.frame(self.spark, table)

    def scan(self, name: str, where: Predicate | None = None, txn: Transaction | None = None, version: int | None = None, hidden: bool = False) -> DataFrame:
        """Visible rows; of an older version if asked. ``hidden``: with row id and provenance."""
        rows = lowering.filtered(self._frame(name, txn, version), where)
        return rows if hidden else rows.select(*lowering.visible(rows))

    def read_tid(self, name: str, tid: int) -> DataFrame:
        """Every committed version under this row id, visible or not."""
        table = self._state.named(name)
        if table is None:
            raise TableNotFound(name)
        return store.read(self.spark, table.schema, table.files).filter(F.col(TID) == tid)

    def update(self, name: str, tid: int, values: Sequence, txn: Transaction | None = None) -> int:
        """Replaces the row with this id; returns its new id."""

        def action(own: Transaction, table: Table) -> int:
            if len(values) != len(table.columns):
                raise InvalidArgument(f"{len(table.columns)} columns, {len(values)} values")
            sets = {c.name: types.check_value(v, c.type) for v, c in zip(values, table.columns, strict=True)}
            if not self._replace(own, table, store.frame(self.spark, table).filter(F.col(TID) == tid), sets):
                raise TupleNotFound(f"row {tid} of {name}")
            path, _ = own.staged[table.oid].files[-1]
            return store.read(self.spark, table.schema, (path,)).select(TID).first()[0]

        return self._auto(txn, name, locks.ROW_EXCLUSIVE, action)

    def delete(self, name: str, tid: int, txn: Transaction | None = None) -> None:
        def action(own: Transaction, table: Table) -> None:
            path = self._write_targets(own, table, store.frame(self.spark, table).filter(F.col(TID) == tid).select(TID))
            if not self.spark.read.parquet(path).count():
                raise TupleNotFound(f"row {tid} of {name}")
            own.staged.setdefault(table.oid, _Staged()).deletions.append(path)

        self._auto(txn, name, locks.ROW_EXCLUSIVE, action)

    def update_where(self, name: str, where: Predicate | None, sets: dict, txn: Transaction | None = None) -> int:
        def action(own: Transaction, table: Table) -> int:
            checked = {self._column(table, n).name: types.check_value(v, self._column(table, n).type) for n, v in sets.items()}
            return self._update(own, table, where, checked)

        return self._auto(txn, name, locks.ROW_EXCLUSIVE, action)

    def delete_where(self, name: str, where: Predicate | None, txn: Transaction | None = None) -> int:
        return self._auto(txn, name, locks.ROW_EXCLUSIVE, lambda own, table: self._delete(own, table, where))

    # --- indexes

    def _index(self, name: str, column: str, txn: Transaction | None = None) -> tuple[Table, Index]:
        table = txn.table(name) if txn else self._state.named(name)
        if table is None:
            raise TableNotFound(name)
        index = table.index_on(column)
        if index is None:
            raise IndexNotFound(f"{name}({column})")
        return table, index

    def index_scan(self, name: str, column: str, txn: Transaction | None = None) -> DataFrame:
        """(key, _tid) in key order; nulls aren't in an index."""
        return store.index_frame(self.spark, *self._index(name, column, txn)).select(F.col("_key").alias("key"), TID).orderBy("key", TID)

    def lookup_all(self, name: str, column: str, key, txn: Transaction | None = None) -> DataFrame:
        """Row ids with this key, ascending."""
        entries = store.index_frame(self.spark, *self._index(name, column, txn))
        return entries.filter(F.col("_key") == F.lit(key)).select(TID).orderBy(TID)

    def index_lookup(self, name: str, column: str, key, txn: Transaction | None = None) -> int | None:
        """The first visible row's id."""
        found = self.lookup_all(name, column, key, txn).first()
        return found[0] if found else None

    def range_scan(self, name: str, column: str, start=None, end=None, txn: Transaction | None = None) -> DataFrame:
        """(key, _tid) with start <= key < end, in key order; a bound of None is open."""
        entries = store.index_frame(self.spark, *self._index(name, column, txn))
        if start is not None:
            entries = entries.filter(F.col("_key") >= F.lit(start))
        if end is not None:
            entries = entries.filter(F.col("_key") < F.lit(end))
        return entries.select(F.col("_key").alias("key"), TID).orderBy("key", TID)

    def rows_by_index(self, name: str, column: str, start=None, end=None, txn: Transaction | None = None) -> DataFrame:
        """Whole rows through the index: a semi-join of the table with the pruned projection."""
        table, _ = self._index(name, column, txn)
        ids = self.range_scan(name, column, start, end, txn).select(TID)
        return store.frame(self.spark, table).join(ids, TID, "left_semi").select(*[c.name for c in table.columns])

    def index_differences(self, name: str, column: str) -> DataFrame:
        """Entries that table and index don't share: none in a sound store."""
        table, index = self._index(name, column)
        heap = store.frame(self.spark, table).select(F.col(f"`{index.column}`").alias("_key"), TID).filter("_key IS NOT NULL")
        entries = store.index_frame(self.spark, table, index)
        missing = heap.exceptAll(entries).withColumn("side", F.lit("missing in index"))
        return missing.unionAll(entries.exceptAll(heap).withColumn("side", F.lit("missing in table")))

    # --- the rest

    def describe_table(self, name: str) -> list[Column]:
        table = self._state.named(name)
        if table is None:
            raise TableNotFound(name)
        return list(table.columns)

    def indexes(self, name: str) -> list[tuple[str, str]]:
        """(index name, column)"""
        table = self._state.named(name)
        if table is None:
            raise TableNotFound(name)
        return [(i.name, i.column) for i in table.indexes]

    @property
    def version(self) -> int:
        return self._state.version

    def catalog(self, table: str) -> DataFrame:
        """One of the system tables as a DataFrame."""
        return catalog.system_table(self.spark, self._state, table)

    def log(self) -> DataFrame:
        """The commit log, one row per action."""
        return catalog.log_frame(self.spark, self._log.load()[2])

    def lock_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.locks.states(), "oid long, tid long, xid long, mode string, granted boolean")

    def wait_edges(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.locks.wait_edges()), "waiter long, holder long")

    def dead_tuples(self, name: str) -> DataFrame:
        """Row versions that deletions have made invisible to all: feed of compaction."""
        table = self._state.named(name)
        if table is None:
            raise TableNotFound(name)
        return store.dead_rows(self.spark, table)

    def vacuum(self, name: str, keep_versions: bool = False) -> None:
        """Rewrites a table's visible rows and indexes as few files without deletions; row ids stay. The folders that no open
        snapshot names are deleted, unless ``keep_versions`` leaves older versions readable."""
        with self.begin() as txn:
            self._lock_table(txn, txn.table(name), locks.ACCESS_EXCLUSIVE)
            table = self._state.tables[txn.table(name).oid]
            path = self._folder(table, "rows")
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            store.frame(self.spark, table).repartitionByRange(parts, TID).sortWithinPartitions(TID).write.parquet(path)
            rows, made = store.read(self.spark, table.schema, (path,)), {}
            for index in table.indexes:
                made[str(index.oid)] = self._folder(table, "index")
                self._sorted_entries(rows, index.column, parts).write.parquet(made[str(index.oid)])
            self._publish(txn.xid, [{"do": "compact", "oid": table.oid, "path": path, "indexes": made}])
            if not keep_versions:
                self._active.pop(txn.xid, None)  # its own snapshot is the version before
                self.reclaim(table.oid)

    def _delete_folders(self, paths: Iterable[str]) -> None:
        for name in paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def reclaim(self, oid: int) -> list[str]:
        """Deletes a table's folders that neither the present version nor the snapshot of an open transaction names, and forgets
        the versions before those: they can't be read any more. The caller keeps writers of this table off. Returns the folders."""
        with self._mutex:
            least = min([*self._active.values(), self._state.version])
            self._states = {v: state for v, state in self._states.items() if v >= least}
            pinned = {v: self._states[v] for v in self._active.values() if v in self._states} | {self._state.version: self._state}
            self._states = pinned
        live = set()
        for state in pinned.values():
            if (table := state.tables.get(oid)) is not None:
                live |= {*table.files, *(p for p, _ in table.deletions), *(p for i in table.indexes for p in i.files)}
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{oid}")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        kept = {p.rsplit("/", 1)[1] for p in live}
        gone = sorted(f"{self.root}/data/{oid}/{s.getPath().getName()}" for s in files.listStatus(folder) if s.getPath().getName() not in kept)
        self._delete_folders(gone)
        return gone

    def checkpoint(self) -> None:
        """Folds the log up to now into one file, from which the next opening starts."""
        with self._mutex:
            self._log.checkpoint(self._state.version, self._state.to_json())

    def sql_passthrough(self, sql: str) -> DataFrame:
        """Extension: any Spark SQL over the current version of all tables, joins and aggregates included."""
        for table in self._state.tables.values():
            if not table.dropped:
                rows = store.frame(self.spark, table)
                rows.select(*lowering.visible(rows)).createOrReplaceTempView(table.name)
        return self.spark.sql(sql)
