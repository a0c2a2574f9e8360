"""Numbers within groups, published tables and their manifest, revisions, and files in folders."""

import glob
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quernstone.operators import revisions as V
from quernstone.plans import numbering
from quernstone.plans.numbering import numbered
from quernstone.sources import files, published


def test_numbers_within_groups(spark):
    rows = [("hot", i % 50, i) for i in range(3000)] + [(None, 1, 3001), ("b", None, 3002), ("b", 5, 3003)]
    data = spark.createDataFrame(rows, "g string, k int, id int").repartition(7)
    got = numbered(data, ["g"], [F.col("k").desc_nulls_last(), F.col("id")])
    want = defaultdict(list)
    for g, k, i in rows:
        want[g].append((k is None, -(k or 0), i))
    places = {(g, x[2]): n for g, xs in want.items() for n, x in enumerate(sorted(xs))}
    assert {(r.g, r.id): r.number for r in got.collect()} == places
    assert sorted(r.number for r in numbered(data, [], [F.col("id")]).collect()) == list(range(len(rows)))
    assert numbered(data.where("false"), ["g"], [F.col("id")]).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_numbers_deal_rows_once(spark, monkeypatch, few):
    monkeypatch.setattr(numbering, "FEW", few)
    data = spark.range(0, 4000, 1, 5).selectExpr("id", "nullif(id * 7 % 3, 1) AS g", "concat('t', id % 500) AS k")
    got = numbered(data, ["g"], [F.col("k").desc(), "id"])
    want = {}
    for r in sorted(data.collect(), key=lambda r: r.id):
        want.setdefault(r.g, []).append(r)
    want = {r.id: n for rows in want.values() for n, r in enumerate(sorted(rows, key=lambda r: r.k, reverse=True))}
    assert {r.id: r.number for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Written rows have their places; few starts come to them.
    assert "Window" not in plan and ("Exchange hashpartitioning" in plan) == (few == 0)


def test_texts_are_searched_once_for_published_entities(spark, tmp_path, monkeypatch):
    class Seen(Exception):
        pass

    def publish(spark, tables, folder):
        plan = tables["entities"]._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan and "Generate" not in plan
        raise Seen

    monkeypatch.setattr(published, "publish", publish)
    with pytest.raises(Seen):
        published.published_tables(spark, "/root/testdata/sf0.001")


def test_nothing_is_published_without_a_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("t", "s", f"{i:04}") for i in range(1201)] + [("t", "z", "0")], "tenant_id string, silo_id string, id string")
    published.publish(spark, {"one": rows, "none": rows.where("false")}, f"{tmp_path}/a")
    tables = published.published(spark, f"{tmp_path}/a")
    assert {(r.silo_id, r.batch): r["count"] for r in tables["one"].groupBy("silo_id", "batch").count().collect()} == {("s", 0): 500, ("s", 1): 500, ("s", 2): 201, ("z", 0): 1}
    rows.write.parquet(f"{tmp_path}/b/one")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        published.published(spark, f"{tmp_path}/b")


def test_revisions_keep_what_they_do_not_change(spark):
    p = lambda v, s="ok": f"named_struct('value', '{v}', 'status', '{s}')"
    base = spark.sql(f"SELECT 1L AS envelope_id, map('a', {p(1)}, 'b', {p(2)}) AS parameters UNION ALL SELECT 2L, map('a', {p(9)})")
    one = V.first_revisions(base)
    two = V.revise(V.latest(one), spark.sql(f"SELECT 1L AS envelope_id, map('b', {p(3, 'new')}, 'c', {p(4)}) AS changes UNION ALL SELECT 7L, map('b', {p(0)}) UNION ALL SELECT 2L, map_filter(map('x', {p(0)}), (k, v) -> false)"), "first")
    three = V.revise(V.latest(one.unionByName(two)), spark.sql(f"SELECT 1L AS envelope_id, map('a', {p(5)}) AS changes"), "second")
    every = one.unionByName(two).unionByName(three)
    assert sorted((r.envelope_id, r.revision, r.parent_revision or 0, r.lineage) for r in V.shown(every).collect()) == [(1, 1, 0, "created"), (1, 2, 1, "created>first"), (1, 3, 2, "created>first>second"), (2, 1, 0, "created")]
    assert {r.envelope_id: r.parameters for r in V.shown(V.latest(every)).collect()} == {1: "a=5:ok|b=3:new|c=4:ok", 2: "a=9:ok"}


def test_folder_of_awkward_files(spark, tmp_path):
    known = {"a.txt": b"\n  ## Title # \nrest", "deep/er/b.md": "é\n".encode(), "blank.txt": b" \n\t\r\n", "broken.txt": b"ok \xff\xfe", "c.pdf": b"%PDF", "empty.md": b"", "signs.TXT": b"###\n#\n", "name with +%20.txt": b"x" * 200}
    for name, data in known.items():
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(data)
    got = {r.path: (r.title, r.rejected, r.n_bytes) for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("Title #", None, 19), "deep/er/b.md": ("é", None, 3), "blank.txt": (None, "blank", 5), "broken.txt": (None, "not_utf8", 5), "signs.TXT": ("signs.TXT", None, 6), "name with +%20.txt": ("x" * 120, None, 200)}
    assert files.accepted(files.scan_folder(spark, str(tmp_path))).count() == 4


def test_lines_of_a_file_keep_their_order(spark, tmp_path):
    spark.range(200).selectExpr("199 - id AS doc_id", "concat('line ', 199 - id) AS text").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = files.filed(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # The writer sorts by part and file unless rows come so.
    assert plan.index("Sort [part") < plan.index("RepartitionByExpression")
    path = files.folder_of_documents(spark, str(tmp_path))
    (name,) = glob.glob(f"{path}/part=2/file=2/part-*.txt")
    with open(name) as f:
        assert f.read().splitlines() == [f"line {i}" for i in range(20, 30)]


def test_permissive_loading(spark, tmp_path):
    os.makedirs(tmp_path / "one"), os.makedirs(tmp_path / "two")
    (tmp_path / "one" / "a.json").write_text('{"id": 1, "kind": "x"}\n{"id": "no"}\n{"id": 2\n[1]\n{"id": 3, "more": {}}\n{}\n')
    (tmp_path / "two" / "b.json").write_text("nothing\n")
    loaded, rejects, manifest = files.load_permissive(spark, f"{tmp_path}/*", "id long, kind string")
    assert sorted((r.file, r.id) for r in loaded.collect() if r.id) == [("one", 1), ("one", 3)]
    assert {(r.file, r.record) for r in rejects.collect()} >= {("one", '{"id": "no"}'), ("one", '{"id": 2'), ("two", "nothing")}
    assert {r.file: r.found for r in manifest.collect()} == {"one": 6, "two": 1} and all(r.found == r.loaded + r.rejected for r in manifest.collect())
