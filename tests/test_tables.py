import os

import pytest

from gritmill import tables


def test_written_tables_are_deleted(spark):
    tables.drop_written()
    df = tables.written(spark.range(5).toDF("id"), "five")
    path = tables._WRITTEN[-1][1]
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    assert tables.drop_written() == 1 and not os.path.exists(path.removeprefix("file:"))


def test_a_cluster_must_name_its_folder():
    class Nothing:
        def isDefined(self):  # noqa: N802
            return False

    class Fake:
        master = "spark://h:7077"
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

        class _jsc:  # noqa: N801
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Nothing)}))

    fake = Fake()
    fake.sparkContext = fake
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.ensure_shared_dir(fake)
