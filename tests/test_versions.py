"""Several writers of one table, and locks."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from logloom.operators import incremental
from logloom.versions import Claims, Lock, Versions

STATE = "path string, touched_ms long, size_bytes long"


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    place = f"file://{tmp_path}/state dir"

    def writer(name):
        table = Versions(spark, place)
        for k in range(5):
            patch = spark.createDataFrame([(f"{name}{k}", k, 1), ("both", k, 2)], STATE)
            table.commit(lambda held, patch=patch: patch if held is None else incremental.upsert(held, patch))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(writer, "abc"))
    table = Versions(spark, place)
    assert table.latest()[0] == 15
    assert sorted(r.path for r in table.table().collect()) == sorted([f"{n}{k}" for n in "abc" for k in range(5)] + ["both"])
    assert table.table(1).count() == 2
    table.forget(keep=3)
    assert table.table(13).count() > 2 and table.table().count() == 16


def test_a_change_of_nothing_makes_no_version(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}")
    assert table.table() is None and table.commit(lambda held: None) is None and table.latest() == (0, {})
    table.commit(lambda held: spark.range(3).select(F.col("id")))
    assert table.commit(lambda held: None).count() == 3 and table.latest()[0] == 1


def test_a_claim_is_made_once(spark, tmp_path):
    claims = Claims(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: claims.claim(1, {"by": k}), range(24)))
    assert sum(won) == 1 and claims.read(1) == {"by": won.index(True)}


def test_lock(spark, tmp_path):
    now = [1000.0]
    a, b = (Lock(spark, f"file://{tmp_path}/lock", clock=lambda: now[0]) for _ in range(2))
    with a.held() as mine:
        assert mine and not b.take()
        now[0] += 299
        assert not b.take() and a.take()  # renewed
        now[0] += 299
        assert not b.take()
        now[0] += 2
        assert b.take() and not a.take()  # given up as gone
    assert not a.take()  # what the new holder has isn't given back by the old one
    b.release()
    assert a.take()
