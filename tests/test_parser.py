import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.errors import ParseError
from tidemark.plans.sqlparse import Condition, Control, CreateIndex, CreateTable, Delete, Insert, Select, Update, parse


def test_select_in_full():
    assert parse("SELECT A, b FROM T WHERE c > -5 ORDER BY d DESC LIMIT 3 FOR UPDATE;") == Select("t", ("a", "b"), Condition("c", ">", -5), ("d", True), 3, "update")


def test_select_defaults():
    assert parse("select * from t") == Select("t", None)
    assert parse("select * from t order by a asc") == Select("t", None, None, ("a", False))
    assert parse("select * from t for share").lock == "share"


def test_insert_update_delete():
    assert parse("INSERT INTO t (a, a) VALUES (1, 'it''s'), (NULL, '')") == Insert("t", ("a", "a"), ((1, "it's"), (None, "")))
    assert parse("UPDATE t SET a = 1, b = NULL WHERE c = 'x'") == Update("t", (("a", 1), ("b", None)), Condition("c", "=", "x"))
    assert parse("DELETE FROM t") == Delete("t")


def test_definitions_and_control():
    assert parse("CREATE TABLE t (a INTEGER, b VARCHAR, c UUID)") == CreateTable("t", (("a", "int4"), ("b", "text"), ("c", "uuid")))
    assert parse("CREATE INDEX ON t (a)") == CreateIndex("t", "a")
    assert parse("BEGIN") == Control("begin")


@pytest.mark.parametrize(
    "text",
    [
        "", ";", ";;", "SELEC * FROM t", "SELECT * WHERE id = 1", "SELECT * FROM t; SELECT * FROM t", "SELECT * FROM t;;", "SELECT * FROM t FOR", "SELECT * FROM t FOR NO KEY UPDATE",
        "SELECT * FROM t WHERE a <= 1", "SELECT * FROM t WHERE a <> 1", "SELECT * FROM t LIMIT -1", "SELECT * FROM t -- note", "SELECT a.b FROM t", "SELECT 1.5 FROM t", "SELECT * FROM t WHERE a = 1.5",
        "SELECT * FROM t WHERE a = 'open", "CREATE TABLE t (a FLOAT)", "CREATE TABLE t ()", "CREATE INDEX ON t (a, b)", 'SELECT "a" FROM t', "INSERT INTO t VALUES ()", "SELECT * FROM t WHERE a = 99999999999999999999",
        "SELECT * FROM a JOIN b", "SELECT * FROM t WHERE a = 1 AND b = 2", "SELECT count(*) FROM t", "UPDATE t SET a = a + 1", "SELECT * FROM 1t",
    ],
)
def test_refused(text):
    with pytest.raises(ParseError):
        parse(text)


@given(st.text(), st.integers(-(1 << 63), (1 << 63) - 1))
def test_literals_round_trip(text, number):
    quoted = text.replace("'", "''")
    assert parse(f"INSERT INTO t VALUES ('{quoted}', {number})").rows == ((text, number),)


@given(st.text())
def test_any_text_parses_or_is_refused(text):
    try:
        parse(text)
    except ParseError:
        pass
