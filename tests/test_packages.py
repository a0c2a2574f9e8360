"""Exports: the last row of a key wins, and foreign rows refuse the whole export."""

import pytest

from quernstone.sources.packages import export_objects

COLUMNS = "object_id string, ord long, tenant_id string, silo_id string, source_platform string, title string"


def test_last_row_wins(spark):
    rows = [("d1", 1, "t1", "s0", "Grok", "old"), ("d1", 2, "t1", "s0", None, "new")]
    assert [r.title for r in export_objects(spark.createDataFrame(rows, COLUMNS), "t1", "s0").collect()] == ["new"]


@pytest.mark.parametrize("tenant", ["t2", None])
def test_foreign_row_refuses_all(spark, tenant):
    rows = [("d1", 1, "t1", "s0", None, "a"), ("d2", 2, tenant, "s0", None, "b")]
    with pytest.raises(ValueError):
        export_objects(spark.createDataFrame(rows, COLUMNS), "t1", "s0")
