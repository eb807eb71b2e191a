import os

import pytest

from tessella.scratch import ARROW_ROWS, Scratch, arrow_batches, dropping
from tessella.session import shared_dir


def files(root):
    return [f for _, _, names in os.walk(root.removeprefix("file:")) for f in names]


def test_tables_go_when_freed(spark):
    scratch = Scratch(spark)
    a, b = (scratch.keep(spark.range(n)) for n in (3, 5))
    scratch.free(a)
    assert b.count() == 5 and files(f"{scratch.root}/t002") and not files(f"{scratch.root}/t001")
    c = scratch.keep(b.where("id > 2"))
    scratch.only(c)
    assert c.count() == 2 and not files(f"{scratch.root}/t002")
    scratch.drop()
    scratch.drop()
    assert not files(scratch.root)


def test_dropping_leaves_what_was_there_before(spark):
    outer = Scratch(spark)
    with dropping():
        kept = outer.keep(Scratch(spark).keep(spark.range(4)))
        inner = Scratch.opened[-1].root
    assert kept.count() == 4 and not files(inner)
    outer.drop()


def test_settings_come_back(spark):
    before = spark.conf.get(ARROW_ROWS)
    with arrow_batches(spark, 7):
        assert spark.conf.get(ARROW_ROWS) == "7"
    assert spark.conf.get(ARROW_ROWS) == before


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Far:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        shared_dir(Far())
