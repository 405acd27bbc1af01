import os

import pytest

from gristmill import session


class Context:
    master = "spark://host:7077"

    class _jsc:
        @staticmethod
        def sc():
            return Context

    @staticmethod
    def getCheckpointDir():
        return Context

    @staticmethod
    def isEmpty():
        return True


class Session:
    sparkContext = Context

    class conf:
        @staticmethod
        def get(name, default):
            return default


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.shared_folder(Session)


def test_tables_are_deleted_after_use(spark):
    session.clear_tables(spark)
    first = session.cut_lineage(spark.range(10).repartition(3))
    second = session.cut_lineage(first.where("id > 4"), first)
    assert second.count() == 5
    session.clear_tables(spark)
    folder = session.shared_folder(spark).removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("table-")]


def test_small_side_marks_only_counted_rows(spark):
    few = spark.range(5)
    assert session.small_side(few, 2) is few and session.small_side(few, 5) is not few
