import threading
import time

import pytest

from tidemark.engine import Engine
from tidemark.errors import DeadlockVictim, LockError, TupleConcurrentlyUpdated
from tidemark.locks import ACCESS_EXCLUSIVE, ACCESS_SHARE, EXCLUSIVE, ROW_EXCLUSIVE, SHARE, STRENGTH, UPDATE, LockManager


def start(f, *args):
    out = {}

    def run():
        try:
            out["value"] = f(*args)
        except Exception as e:  # noqa: BLE001
            out["error"] = e

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread, out


ALLOWED = {(ACCESS_SHARE, ACCESS_SHARE), (ACCESS_SHARE, ROW_EXCLUSIVE), (ACCESS_SHARE, EXCLUSIVE), (ROW_EXCLUSIVE, ROW_EXCLUSIVE)}


@pytest.mark.parametrize("held", STRENGTH)
@pytest.mark.parametrize("asked", STRENGTH)
def test_matrix(held, asked):
    m = LockManager()
    m.acquire(1, (1,), held)
    assert m.try_acquire(2, (1,), asked) == ((held, asked) in ALLOWED or (asked, held) in ALLOWED)


def test_first_come_first_served():
    m = LockManager(0.02)
    m.acquire(1, (1,), ACCESS_SHARE)
    second, _ = start(m.acquire, 2, (1,), ACCESS_EXCLUSIVE)
    time.sleep(0.1)
    assert not m.try_acquire(3, (1,), ACCESS_SHARE)  # compatible, but behind the queue
    m.release_all(1)
    second.join(5)
    assert m.held_by(2) == [((1,), ACCESS_EXCLUSIVE)]


def test_shares_coexist_and_upgrade_waits():
    m = LockManager(0.02)
    m.acquire(1, (1, 5), SHARE)
    m.acquire(2, (1, 5), SHARE)
    upgrade, out = start(m.acquire, 1, (1, 5), UPDATE)
    time.sleep(0.1)
    assert upgrade.is_alive()
    m.release_all(2)
    upgrade.join(5)
    assert out == {"value": True} and m.held_by(1) == [((1, 5), UPDATE)]
    assert m.acquire(1, (1, 5), SHARE) is False and m.held_by(1) == [((1, 5), UPDATE)]  # no downgrade


def test_youngest_dies():
    m = LockManager(0.02)
    for x in (1, 2, 3):
        m.acquire(x, (x,), EXCLUSIVE)
    threads = [start(m.acquire, x, (x % 3 + 1,), EXCLUSIVE) for x in (1, 2, 3)]
    threads[2][0].join(5)
    assert isinstance(threads[2][1]["error"], DeadlockVictim)
    m.release_all(3)
    threads[1][0].join(5)
    assert threads[1][1] == {"value": True}
    m.release_all(2)
    threads[0][0].join(5)
    assert threads[0][1] == {"value": True}


def test_waits_without_a_cycle_harm_nobody():
    m = LockManager(0.02)
    m.acquire(1, (1,), EXCLUSIVE)
    threads = [start(m.acquire, x, (1,), EXCLUSIVE) for x in (2, 3, 4)]
    time.sleep(0.2)
    assert all("error" not in out for _, out in threads)
    for x in (1, 2, 3, 4):
        m.release_all(x)
        time.sleep(0.05)
    with pytest.raises(LockError):
        m.acquire(9, (1,), EXCLUSIVE)
        m.acquire(8, (1,), EXCLUSIVE, timeout=0.1)


@pytest.fixture
def counter(spark, root):
    e = Engine(spark, root, 0.02)
    e.exec("CREATE TABLE c (id INT, v INT)")
    e.exec("INSERT INTO c VALUES (1, 0), (2, 0)")
    return e


def test_writer_waits_and_then_fails(counter):
    one = counter.begin()
    counter.exec("UPDATE c SET v = 1 WHERE id = 1", one)
    thread, out = start(counter.exec, "UPDATE c SET v = 2 WHERE id = 1")
    time.sleep(2)
    assert thread.is_alive()
    one.commit()
    thread.join(30)
    assert isinstance(out["error"], TupleConcurrentlyUpdated)
    assert counter.exec("SELECT v FROM c WHERE id = 1").first()[0] == 1


def test_writer_waits_and_proceeds_after_abort(counter):
    one = counter.begin()
    counter.exec("SELECT * FROM c WHERE id = 1 FOR UPDATE", one)
    thread, out = start(counter.exec, "UPDATE c SET v = 2 WHERE id = 1")
    time.sleep(2)
    assert thread.is_alive()
    one.abort()
    thread.join(30)
    assert out == {"value": 1}


def test_no_lost_update(counter):
    def add():
        while True:
            try:
                with counter.begin() as txn:
                    value = counter.exec("SELECT v FROM c WHERE id = 2 FOR UPDATE", txn).first()[0]
                    counter.exec(f"UPDATE c SET v = {value + 1} WHERE id = 2", txn)
                return
            except (TupleConcurrentlyUpdated, DeadlockVictim):
                pass

    threads = [start(add)[0] for _ in range(3)]
    for t in threads:
        t.join(90)
    assert counter.exec("SELECT v FROM c WHERE id = 2").first()[0] == 3


def test_shared_readers(counter):
    one, two = counter.begin(), counter.begin()
    assert counter.exec("SELECT * FROM c FOR SHARE", one).count() == counter.exec("SELECT * FROM c FOR SHARE", two).count() == 2
    assert counter.lock_table().filter("mode = 'share' AND granted").count() == 4
    one.abort()
    two.abort()
    assert counter.lock_table().count() == 0


def test_snapshots_under_writers(counter):
    """Every reader sees its own snapshot however many commit meanwhile."""
    readers = [counter.begin() for _ in range(5)]
    for n in range(3):
        counter.exec(f"INSERT INTO c VALUES ({n + 10}, 0)")
    assert {counter.exec("SELECT * FROM c", r).count() for r in readers} == {2}
    for r in readers:
        r.abort()
    assert counter.exec("SELECT * FROM c").count() == 5


def test_a_long_queue_is_searched_quickly():
    """Every waiter waits for all those ahead: a complete graph without a cycle."""
    m = LockManager(0.05)
    m.acquire(0, (1,), EXCLUSIVE)
    threads = [start(m.acquire, k, (1,), EXCLUSIVE)[0] for k in range(1, 101)]
    deadline = time.monotonic() + 30
    while len(m.wait_edges()) < 100 * 101 // 2 and time.monotonic() < deadline:
        time.sleep(0.05)
    began = time.monotonic()
    with m._changed:
        m._break_cycles()
    assert time.monotonic() - began < 1 and not m._victims
    until = time.monotonic() + 30
    while (held := [x for _, _, x, _, granted in m.states() if granted] or m.wait_edges()) and time.monotonic() < until:
        for xid in held if isinstance(held, list) else ():
            m.release_all(xid)
        time.sleep(0.002)
    for thread in threads:
        thread.join(30)
    assert not any(t.is_alive() for t in threads)
