import datetime as dt
import subprocess
import sys
import uuid

import pytest

from tidemark import errors as E
from tidemark.engine import Engine
from tidemark.plans.lowering import Predicate
from tidemark.types import BYTEA, INT4, INT8, TEXT, TIMESTAMPTZ, UUID, Column


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def people(spark, root):
    e = Engine(spark, root)
    e.exec("CREATE TABLE People (ID INT, Name TEXT)")
    e.exec("INSERT INTO people VALUES (1, 'a'), (2, NULL), (NULL, 'c'), (3, 'B')")
    return e


def test_statements(people):
    e = people
    assert rows(e.exec("SELECT NAME, id FROM PEOPLE WHERE Id < 3")) == [("a", 1), (None, 2)]
    assert rows(e.exec("SELECT id FROM people ORDER BY id")) == [(None,), (1,), (2,), (3,)]
    assert rows(e.exec("SELECT id FROM people ORDER BY id DESC")) == [(3,), (2,), (1,), (None,)]
    assert rows(e.exec("SELECT id FROM people ORDER BY name LIMIT 3")) == [(2,), (3,), (1,)]  # null, then bytes
    assert rows(e.exec("SELECT id, id FROM people LIMIT 2")) == [(1, 1), (2, 2)]
    assert rows(e.exec("SELECT * FROM people LIMIT 0")) == []
    assert e.exec("UPDATE people SET name = 'x', name = 'y' WHERE id > 1") == 2
    assert e.exec("DELETE FROM people WHERE name = 'a'") == 1
    assert e.exec("DELETE FROM people WHERE name = 'nobody'") == 0
    assert sorted(rows(e.exec("SELECT * FROM people")), key=str) == [(2, "y"), (3, "y"), (None, "c")]


def test_updated_rows_come_last(people):
    people.exec("UPDATE people SET name = 'z' WHERE id = 1")
    assert rows(people.exec("SELECT id FROM people")) == [(2,), (None,), (3,), (1,)]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("SELECT * FROM nothing", E.TableNotFound), ("SELECT nope FROM people", E.InvalidPredicate), ("SELECT * FROM people ORDER BY nope", E.InvalidPredicate),
        ("SELECT * FROM people WHERE nope = 1", E.InvalidPredicate), ("SELECT * FROM people WHERE id = NULL", E.InvalidPredicate), ("SELECT * FROM people WHERE id = 'x'", E.InvalidPredicate),
        ("SELECT * FROM people WHERE id = 3000000000", E.InvalidPredicate), ("SELECT _tid FROM people", E.InvalidPredicate), ("INSERT INTO people VALUES (3000000000, 'x')", E.InvalidArgument),
        ("INSERT INTO people VALUES ('x', 1)", E.InvalidArgument), ("INSERT INTO people VALUES (1)", E.InvalidArgument), ("INSERT INTO people (id) VALUES (1, 2)", E.InvalidArgument),
        ("UPDATE people SET id = 'x'", E.InvalidArgument), ("CREATE TABLE people (a INT)", E.TableExists), ("CREATE TABLE t (a INT, A TEXT)", E.InvalidArgument), ("BEGIN", E.Unsupported), ("COMMIT", E.Unsupported),
        ("CREATE INDEX ON people (nope)", E.InvalidPredicate),
    ],
)
def test_errors_change_nothing(people, text, error):
    version = people.version
    with pytest.raises(error):
        people.exec(text)
    assert people.version == version and people.active_xids() == []


def test_six_types(spark, root):
    e = Engine(spark, root)
    e.create_table("t", [Column("i", INT4), Column("b", INT8), Column("s", TEXT), Column("y", BYTEA), Column("ts", TIMESTAMPTZ), Column("u", UUID)])
    when, key = dt.datetime(2024, 1, 2, 3, 4, 5, 678901, dt.timezone.utc), uuid.UUID(int=7)
    e.insert("t", [(-(1 << 31), (1 << 63) - 1, "é", b"\xff\x00", when, key), (None,) * 6])
    e.exec("INSERT INTO t (y, ts) VALUES ('é', 1704164645678901)")
    assert [(r.i, r.b, r.s, bytes(r.y) if r.y else None, r.u) for r in e.exec("SELECT * FROM t").collect()] == [
        (-(1 << 31), (1 << 63) - 1, "é", b"\xff\x00", str(key)), (None,) * 5, (None, None, None, "é".encode(), None),
    ]
    assert e.exec("SELECT ts FROM t WHERE ts < 1704164645678902").count() == 2
    assert e.scan("t", Predicate("y", ">", b"\xfe")).count() == 1 and e.scan("t", Predicate("u", "=", key)).count() == 1
    for text in ("SELECT * FROM t WHERE y = 'x'", "SELECT * FROM t WHERE u = 'x'"):
        with pytest.raises(E.InvalidPredicate):
            e.exec(text)
    with pytest.raises(E.InvalidPredicate):
        e.scan("t", Predicate("i", "=", "x"))
    with pytest.raises(E.InvalidArgument):
        e.insert("t", [(1, 2, 3, 4, 5, 6)])


def test_typed_update_and_delete(people):
    tid = people.scan("people", Predicate("id", "=", 2), hidden=True).first()["_tid"]
    new = people.update("people", tid, (20, "t"))
    assert new != tid and people.scan("people", Predicate("id", "=", 20), hidden=True).first()["_tid"] == new
    assert people.read_tid("people", tid).count() == 1  # superseded, but there
    people.delete("people", new)
    for call in (lambda: people.delete("people", new), lambda: people.update("people", tid, (1, "x"))):
        with pytest.raises(E.TupleNotFound):
            call()
    assert people.scan("people").count() == 3


def test_index(people):
    e = people
    e.exec("CREATE INDEX ON people (id)")
    with pytest.raises(E.IndexExists):
        e.exec("CREATE INDEX ON people (id)")
    e.exec("INSERT INTO people VALUES (2, 'again')")
    assert e.indexes("people") == [("people_id_idx", "id")]
    assert e.lookup_all("people", "id", 2).count() == 2
    assert [r.key for r in e.range_scan("people", "id", 1, 3).collect()] == [1, 2, 2]
    e.exec("UPDATE people SET name = 'same key' WHERE id = 2")
    e.exec("DELETE FROM people WHERE id = 1")
    assert [r.key for r in e.index_scan("people", "id").collect()] == [2, 2, 3]
    assert e.index_lookup("people", "id", 1) is None
    assert e.index_differences("people", "id").count() == 0
    txn = e.begin()
    e.exec("INSERT INTO people VALUES (9, 'own')", txn)
    assert e.index_lookup("people", "id", 9, txn) is not None and e.index_lookup("people", "id", 9) is None
    txn.abort()
    assert e.index_lookup("people", "id", 9) is None
    with pytest.raises(E.IndexNotFound):
        e.index_lookup("people", "name", "x")


def test_transaction_visibility(people):
    e = people
    one, two = e.begin(), e.begin()
    assert e.exec("INSERT INTO people VALUES (7, 'one')", one) == 1
    assert e.exec("SELECT * FROM people", one).count() == 5  # own writes
    assert e.exec("SELECT * FROM people", two).count() == 4 and e.exec("SELECT * FROM people").count() == 4
    one.commit()
    assert e.exec("SELECT * FROM people", two).count() == 4  # its snapshot is older
    assert e.exec("SELECT * FROM people").count() == 5
    two.abort()
    with pytest.raises(E.InvalidArgument):
        e.exec("SELECT * FROM people", two)


def test_update_meets_no_own_rows(people):
    txn = people.begin()
    for n in range(3):
        assert people.exec("UPDATE people SET name = 'again' WHERE id > 0", txn) == 3
    txn.commit()
    assert people.scan("people").count() == 4


def test_first_committer_wins(people):
    e = people
    one, two = e.begin(), e.begin()
    e.exec("UPDATE people SET name = 'one' WHERE id = 1", one)
    one.commit()
    with pytest.raises(E.TupleConcurrentlyUpdated):
        e.exec("UPDATE people SET name = 'two' WHERE id = 1", two)
    two.abort()
    three = e.begin()
    assert e.exec("UPDATE people SET name = 'three' WHERE id = 1", three) == 1
    three.commit()


def test_handles(people, spark, tmp_path):
    other = Engine(spark, str(tmp_path / "other"))
    txn = other.begin()
    with pytest.raises(E.InvalidArgument):
        people.exec("SELECT * FROM people", txn)
    txn.abort()
    txn = people.begin()
    for text in ("CREATE TABLE t (a INT)", "CREATE INDEX ON people (id)"):
        with pytest.raises(E.Unsupported):
            people.exec(text, txn)
    people.exec("DELETE FROM people", txn)
    del txn  # a dropped handle aborts
    assert people.scan("people").count() == 4 and people.active_xids() == []
    with pytest.raises(RuntimeError), people.begin() as txn:
        people.exec("DELETE FROM people", txn)
        raise RuntimeError
    assert people.scan("people").count() == 4


def test_reopen_time_travel_vacuum_checkpoint(people, spark, root):
    e, version = people, people.version
    e.exec("CREATE INDEX ON people (id)")
    e.exec("DELETE FROM people WHERE id = 1")
    assert e.scan("people", version=version).count() == 4
    assert [r._xmax > r._xmin for r in e.dead_tuples("people").collect()] == [True]
    e.vacuum("people")
    assert e.dead_tuples("people").count() == 0 and e.index_differences("people", "id").count() == 0
    e.checkpoint()
    e.exec("INSERT INTO people VALUES (5, 'late')")
    again = Engine(spark, root)
    assert sorted(rows(again.scan("people")), key=str) == sorted(rows(e.scan("people")), key=str)
    assert again.version == e.version and again.describe_table("people") == e.describe_table("people")


def test_drop(people, spark, root):
    people.drop_table("people")
    with pytest.raises(E.TableNotFound):
        people.scan("people")
    people.exec("CREATE TABLE people (x INT)")
    assert people.scan("people").count() == 0 and Engine(spark, root).scan("people").columns == ["x"]


def test_unpublished_files_are_invisible(people, spark, root):
    """A process that dies between staging and publishing leaves nothing behind."""
    txn = people.begin()
    people.exec("INSERT INTO people VALUES (8, 'lost')", txn)
    again = Engine(spark, root)
    assert again.scan("people").count() == 4
    again.exec("INSERT INTO people VALUES (9, 'kept')")
    assert Engine(spark, root).scan("people").count() == 5
    with pytest.raises(E.Unsupported):
        txn.commit()  # the folder has another owner now


KILLED = """
import os, sys
from tidemark.sources.commit_log import CommitLog
class Jvm: pass
log = CommitLog.__new__(CommitLog)
log._local = log.folder = sys.argv[1]
os.makedirs(log._local, exist_ok=True)
log.publish(1, {"xid": 3, "actions": []})
os.link = lambda *a: os._exit(9)
log.publish(2, {"xid": 4, "actions": []})
"""


def test_killed_before_publishing(tmp_path):
    from tidemark.sources.commit_log import CommitLog

    folder = str(tmp_path / "log")
    assert subprocess.run([sys.executable, "-c", KILLED, folder], cwd=".").returncode == 9
    log = CommitLog.__new__(CommitLog)
    log._local = log.folder = folder
    assert [e["version"] for e in log.load()[2]] == [1]
    assert log.publish(2, {"xid": 5, "actions": []}) and not log.publish(2, {"xid": 6, "actions": []})


def test_a_hole_in_the_log_is_corruption(tmp_path):
    from tidemark.sources.commit_log import CommitLog

    log = CommitLog.__new__(CommitLog)
    log._local = log.folder = str(tmp_path)
    log.publish(1, {"xid": 3, "actions": []})
    log.publish(3, {"xid": 4, "actions": []})
    with pytest.raises(E.Corrupted):
        log.load()


def test_catalog(people):
    people.exec("CREATE INDEX ON people (name)")
    classes = {r.relname: (r.oid, r.relkind) for r in people.catalog("pg_class").collect()}
    assert classes["people"] == (16384, "r") and classes["people_name_idx"][1] == "i" and classes["pg_class"] == (1259, "r")
    assert [(r.attname, r.attnum) for r in people.catalog("pg_attribute").filter("attrelid = 16384").collect()] == [("id", 1), ("name", 2)]
    assert people.catalog("pg_type").count() == 6 and people.catalog("pg_index").first().indrelid == 16384
    assert [r.action for r in people.log().collect()] == ["create_table", "add", "create_index"]


def test_passthrough(people):
    assert people.sql_passthrough("SELECT count(*), count(id) FROM people").first() == (4, 3)


def test_provenance(spark, root):
    e = Engine(spark, root)
    e.create_table("t", [Column("x", INT8)])
    e.load("t", spark.range(3).selectExpr("id AS x", "id % 2 AS _agent_id"))
    assert rows(e.scan("t", hidden=True).filter("_agent_id = 1").select("x")) == [(1,)]
    assert e.scan("t").columns == ["x"]


def test_space_comes_back_but_for_open_snapshots(spark, root):
    import os

    e = Engine(spark, root)
    e.exec("CREATE TABLE t (id INT, v INT)")
    e.exec("INSERT INTO t VALUES (1, 1), (2, 2)")
    reader = e.begin()
    e.exec("DELETE FROM t WHERE id = 1")
    oid = e._state.named("t").oid
    e.vacuum("t")
    assert [r.id for r in e.scan("t", txn=reader).orderBy("id").collect()] == [1, 2]  # its folders are still there
    reader.commit()
    e.vacuum("t")
    assert len(os.listdir(f"{root}/data/{oid}")) == 1 and [r.id for r in e.scan("t").collect()] == [2]


def test_plain_selects_are_not_sorted(spark, root):
    e = Engine(spark, root)
    e.exec("CREATE TABLE t (id INT)")
    e.exec("INSERT INTO t VALUES (2), (1)")
    plan = lambda text: e.exec(text)._jdf.queryExecution().toString()
    assert "Sort" not in plan("SELECT * FROM t WHERE id > 0") and "Sort" in plan("SELECT * FROM t ORDER BY id")


def test_log_entries_are_renamed_into_place(spark, root):
    from tidemark.sources.commit_log import CommitLog

    log = CommitLog(spark, root)
    log._local = None  # as on a filesystem that only Spark reaches
    assert log.put("000000000001.json", '{"version": 1}') and not log.put("000000000001.json", '{"version": 2}')
    assert [n for n in log.names() if n.endswith(".json")] == ["000000000001.json"] and log._read("000000000001.json") == '{"version": 1}'
    assert not [n for n in log.names() if n.startswith(".") and not n.endswith(".crc")]
