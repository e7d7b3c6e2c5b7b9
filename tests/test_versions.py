"""Versioned tables: whole commits, restarts, retired parts."""

import os

import pytest

from loomspan.functions import shared
from loomspan.sources.versions import Versions


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    v = Versions(spark, folder)
    assert v.table("a") is None and v.number == 0
    v.put("a", spark.range(3))
    assert Versions(spark, folder).table("a") is None  # not committed
    v.commit(seen=1)
    v.put("a", spark.range(3, 5))
    v.put("b", spark.range(1))
    v.commit()
    again = Versions(spark, folder)
    assert ids(again.table("a")) == [0, 1, 2, 3, 4] and again.values == {"seen": 1} and again.number == 2
    before = again.table("a")
    again.put("a", before, replace=True)
    again.commit(seen=2)
    assert len(again.parts("a")) == 1 and ids(before) == [0, 1, 2, 3, 4]  # readers of the version before go on
    again.put("b", spark.range(1))
    again.commit()
    assert ids(again.table("a")) == [0, 1, 2, 3, 4]
    held = [n for n in os.listdir(tmp_path / "t") if n.startswith("a-")]
    assert held == again.parts("a")


def test_second_writer_is_told(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    one, two = Versions(spark, folder), Versions(spark, folder)
    one.put("a", spark.range(1))
    one.commit()
    two.put("a", spark.range(2))
    with pytest.raises(RuntimeError):
        two.commit()
    assert ids(Versions(spark, folder).table("a")) == [0]


def test_release(spark):
    t = shared.written(spark.range(4), "t", by=None)
    path = t.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    shared.release()
    assert not os.path.exists(path)
