"""Constraints of queries: which of equal ones comes first, and how much a task holds."""

import math

from quernstone.operators import evidence
from quernstone.plans import catalog, numbering

LINE = "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string"
ORDER = "o_orderkey long, o_orderstatus string, o_orderpriority string"


def tables(spark, path, small, large):
    """lineitem in two files: Spark reads the larger first, but the smaller stands before it."""
    for name, rows in (("a", small), ("b", large)):
        spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{path}/{name}")
    import os
    import shutil

    os.makedirs(f"{path}/lineitem.parquet")
    for name in "ab":
        for x in os.listdir(f"{path}/{name}"):
            if x.startswith("part-"):
                shutil.copy(f"{path}/{name}/{x}", f"{path}/lineitem.parquet/{name}.parquet")
    spark.createDataFrame([(i, "O", "1-URGENT") for i in range(40)], ORDER).coalesce(1).write.parquet(f"{path}/orders.parquet")


def test_the_first_of_equal_spans_is_stored_first(spark, tmp_path):
    small = [(i, 2, "S", "O") for i in range(40)]
    tables(spark, tmp_path, small, [(i, 2, f"L{k}", "F") for i in range(40) for k in range(50)] + [(1, 1, "Z", "O"), (99, 1, "Z", "O")])
    got = {r.envelope_id: (r.evidence_value, r.n_refs, r.revision) for r in catalog.queries()["ctx_retrieve"](spark, str(tmp_path)).collect()}
    assert got == {i: ("Z", 2, 2 + i % 3) if i == 1 else ("S", 1, 2 + i % 3) for i in range(40)}


def test_tasks_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path, [(i, 2, "S", "O") for i in range(40)], [(i, k, "A", "F") for i in range(40) for k in range(20)])
    monkeypatch.setattr(numbering, "TASK_ROWS", 50)
    for key in ("agg_conflicts", "ctx_conflicts", "ctx_completion", "ctx_retrieve"):
        df = catalog.queries()[key](spark, str(tmp_path))
        df.collect()
        assert f", {math.ceil(840 / 50)}" in "".join(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in x), key
    assert evidence.QUERIES.keys() == {"agg_conflicts", "ctx_conflicts", "ctx_completion", "ctx_retrieve"}
