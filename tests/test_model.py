"""Random changes against a dictionary."""

import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.engine import Engine

CHANGE = st.one_of(
    st.tuples(st.just("insert"), st.integers(0, 5), st.integers(0, 3)),
    st.tuples(st.just("update"), st.integers(0, 5), st.integers(0, 3)),
    st.tuples(st.just("delete"), st.integers(0, 5), st.just(0)),
    st.tuples(st.sampled_from(["commit", "abort"]), st.just(0), st.just(0)),
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(CHANGE, min_size=3, max_size=8))
def test_changes_match_a_list(spark, tmp_path, changes):
    e = Engine(spark, str(tmp_path / uuid.uuid4().hex))
    e.exec("CREATE TABLE t (k INT, v INT)")
    e.exec("CREATE INDEX ON t (k)")
    kept, now, txn = [], [], e.begin()
    for what, k, v in changes:
        if what == "insert":
            e.exec(f"INSERT INTO t VALUES ({k}, {v})", txn)
            now = [*now, (k, v)]
        elif what == "update":
            assert e.exec(f"UPDATE t SET v = {v} WHERE k = {k}", txn) == sum(x[0] == k for x in now)
            now = [(a, v if a == k else b) for a, b in now]
        elif what == "delete":
            assert e.exec(f"DELETE FROM t WHERE k = {k}", txn) == sum(x[0] == k for x in now)
            now = [x for x in now if x[0] != k]
        else:
            txn.commit() if what == "commit" else txn.abort()
            kept = now = now if what == "commit" else kept
            txn = e.begin()
    assert sorted(map(tuple, e.exec("SELECT * FROM t", txn).collect())) == sorted(now)
    txn.abort()
    assert sorted(map(tuple, e.exec("SELECT * FROM t").collect())) == sorted(kept)
    assert [r.key for r in e.index_scan("t", "k").collect()] == sorted(k for k, _ in kept)
    assert e.index_differences("t", "k").count() == 0
